"""BPE, packing, quality rules and secret scans against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosemill.llm import bpe, packing, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe_is_as_tiktoken_and_comes_back(docs, texts):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = bpe.encode_decode(docs, path, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == own.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def test_packing_holds_each_id_once_with_little_padding(docs, texts):
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for kwargs in ({}, {"length": 64, "open_windows": 3, "min_piece": 4, "fan_in": 2}):
        length = kwargs.get("length", 1024)
        rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, end_id=0, with_ids=True, **kwargs).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in rows:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
        assert by_doc.keys() == texts.keys()
        for d, ps in by_doc.items():
            ps.sort(key=lambda r: r.start)
            ids = own.encode(texts[d] or "", add_special_tokens=False).ids + [0]
            assert b"".join(bytes(r.ids) for r in ps) == b"".join(i.to_bytes(4, "little") for i in ids)
            assert [r.start for r in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))] and {r.doc_tokens for r in ps} == {len(ids)}
        for ps in by_seq.values():
            ps.sort(key=lambda r: r.offset)
            assert [r.offset for r in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))] and sum(r.length for r in ps) <= length
        total = sum(r.length for r in rows)
        assert len(by_seq) * length - total <= 0.05 * total + 5 * length


def test_quality_counts(docs, texts):
    rows = quality.assess(docs).select("doc_id", "quality.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if often[x] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), r.doc_id
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_rejects_symbols_and_keeps_clean(docs):
    junk = docs.where("n_chars > 400 and lang = 'en' and text not like '%#%' and text not like '%|%'").limit(20).withColumns({"text": F.regexp_replace("text", r"(\S+)", r"$1###"), "doc_id": F.col("doc_id") + 50_000})
    rows = quality.assess(docs.unionByName(junk)).select("doc_id", "quality.*").collect()
    assert not any(r.kept for r in rows if r.doc_id >= 50_000)
    clean = [r for r in rows if r.doc_id < 10_000 and not r.base_failed and r.n_symbols == 0]
    assert sum(r.kept for r in clean) >= 0.9 * len(clean)


def test_quality_tells_marks_and_scripts_apart(docs):
    clean = docs.where("doc_id < 10000 and n_chars > 400 and lang = 'en' and text not like '%#%' and text not like '%|%'").limit(20)
    bangs = clean.withColumns({"text": F.replace("text", F.lit("."), F.lit("!!!!")), "doc_id": F.col("doc_id") + 60_000})
    letters = clean.withColumns({"text": F.concat("text", F.lit(" "), F.expr("repeat('漢字仮名', cast(length(text) / 20 as int))")), "doc_id": F.col("doc_id") + 70_000})
    rows = {r.doc_id: r for r in quality.assess(docs.unionByName(bangs).unionByName(letters)).select("doc_id", "quality.*").collect()}
    for base in (60_000, 70_000):
        made = [r for d, r in rows.items() if base <= d < base + 10_000 and rows[d - base].kept and r.char_distance is not None]
        assert len(made) >= 10 and sum(r.kept for r in made) <= 0.1 * len(made)


def brute_spans(t):
    rules = [re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("(AKIA[A-Z0-9]+)"), re.compile("([0-9a-f]+)")]
    return sorted((m.start(), k, m.end()) for k, (p, least) in enumerate(zip(rules, (6, 20, 24))) for m in p.finditer(t) if len(m[1]) >= least)


def test_secret_spans(docs, texts):
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert sorted((s.start, s.kind, s.stop) for s in r.base) == brute_spans(texts[r.doc_id] or ""), r.doc_id


def test_owner_specific_candidates_become_spans(spark):
    token, common = "q8Q7w6E5r4T3y2U1i0O9Zx", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op"
    rows = [(1, f"x {token} y {common}", "a"), (2, f"{common}", "b"), (3, f"é {common}", "c"), (4, None, None), (4, f"{token}", "a")]
    got = {(r.doc_id, r.row_id): [(s.start, s.stop) for s in r.owned] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sorted((d, tuple(s)) for (d, _), s in got.items()) == [(1, ((2, 24),)), (2, ()), (3, ()), (4, ()), (4, ((0, 22),))]
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_copied_examples_are_told_by_owners_and_repositories(spark):
    token = "q8Q7w6E5r4T3y2U1i0O9Zx"
    rows = [(i, f"x {token} {i}", f"owner{i % 2}", f"repo{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    live = lambda **k: sum(len(r.owned) for r in secrets.scan(df, repository=F.col("repo"), owner=F.col("owner"), **k).collect())
    assert (live(), live(example_repositories=7), live(example_owners=2, example_repositories=7)) == (0, 6, 0)
    assert (live(broadcast_bytes=0), live(example_repositories=7, broadcast_bytes=0)) == (0, 6)


def test_base_values_are_classed_and_many_matches_do_no_harm(spark):
    rows = [(i, f"password={'q1w2e3r4t5' if i < 4 else f'own{i}secret'}", f"owner{i}", f"repo{i}") for i in range(6)] + [(9, "0123456789abcdef0123456789abcdef " * 20_000, "owner9", "repo9")]
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string"), repository=F.col("repo"), owner=F.col("owner")).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 1), 3: (0, 1), 4: (1, 0), 5: (1, 0), 9: (20_000, 0)}


def test_clashing_names_pass_through(docs):
    clash = docs.withColumns({"_q_n": F.lit("a"), "_q_words": F.lit("b"), "C0": F.lit("c"), "quality": F.lit("d")})
    r = quality.assess(clash).first()
    assert (r["_q_n"], r["_q_words"], r["C0"]) == ("a", "b", "c") and r["quality"]["n_words"] >= 0
    more = docs.withColumns({"ids": F.lit(1), "decoded": F.lit(2), "part": F.lit(3), "_key": F.lit(4), "_text": F.lit(5), "_t": F.lit(6), "base": F.lit(7)})
    assert packing.pack(more, P.path("byte_bpe_50k.json"), P.PATTERN, end_id=0).select("doc_id").distinct().count() == docs.count()
    assert bpe.encode_decode(more, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == docs.count() == secrets.scan(more).count()
    none = docs.limit(0)
    assert packing.pack(none, P.path("byte_bpe_50k.json"), P.PATTERN, end_id=0).count() == 0 == bpe.encode_decode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count()
