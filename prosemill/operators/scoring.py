"""Token scores of whole collections from one tokenisation, and the measures of each document that follow from them.

Texts become tokens once. A chunk of neighbouring texts keeps a list of its distinct pairs of tokens, its documents only numbers into that list. The list is
dealt over buckets by context, one compressed row for each chunk and bucket, so neither tokens nor pairs are rows that Spark shuffles. A bucket sums the pairs
of its contexts over all chunks, which gives their next-token distributions, and sends each chunk the counts and ranks of its pairs in the order in which they
came. Each chunk then gathers its documents' series by number and measures them with whole-array operations. A context whose pairs would crowd a bucket is
dealt over all of them; its distribution is found beforehand by Spark and known to every bucket by counts, of which it has few.

The distribution of a context is that of the tokens that follow it anywhere. Entropy, effective support, nucleus width (tokens until their shares reach
0.9), the mass of the ten most frequent and the rank of the true token (tokens at least as frequent) are exact for it. A token's probability is 0.7 of
its share in the context and 0.3 of its smoothed share of all tokens. The first token of a text has no context and no scores.
Surprisal over entropy takes an entropy of 1 at least, since contexts with one follower have none.

Cohesion compares a text with its units dealt anew (lines of poems, paragraphs, or sentences of a single paragraph). Units are runs of tokens, so only the
pairs at their borders change: those join the chunk's list with no count, and the mean log-probability of each order follows from the sums at the borders.

Defined cases: a null or empty text has no tokens, counts of 0 and null measures; a measure without enough values is null; repeated rows are documents
each; a text longer than a chunk is a chunk by itself; an empty table gives an empty result."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import SENTENCE, TOKEN

#: What is known of a pair: surprisal of its second token, and the distribution after its first.
FACTS = ["s", "h", "width", "rank", "top10"]
#: Characters of text in a chunk, and orders of units that cohesion takes.
CHUNK, ORDERS = 2_000_000, 5
#: Pairs of chunks in a bucket, and of a context that is dealt over all buckets.
BUCKET, HOT = 1_000_000, 1_000_000
#: The same patterns with ASCII white space spelled out: \s of the JVM's patterns knows no other.
_TOKEN, _SENTENCE, _GAP = (regex.compile(p.replace(r"^\s", r"^ \t-\r").replace(r"\s", r"[ \t-\r]")) for p in (TOKEN, SENTENCE, r"\n\s*\n"))
_LINE = regex.compile(r"[^\n]*\n|[^\n]+")
_LETTER, _ALNUM = regex.compile(r"\p{L}"), regex.compile(r"[\p{L}\p{N}]")
#: Bits of a token: punctuation, line end, content; then for sentences, paragraphs and lines: inside one, first of one.
PUNCT, NEWLINE, CONTENT, SEGMENTS = 1, 2, 4, {"sent": (8, 16), "para": (32, 64), "line": (128, 256)}
LEVELS = [f"{k}_{x}" for k in SEGMENTS for x in ("tokens_mean", "tokens_p90", "burst_cv", "len_cv")]
COUNTS = ["tokens_count", "sent_count", "para_count", "line_count", "cohesion_n_shuffles"]
MEASURES = [
    "p_true_mean", "surprisal_mean", "surprisal_median", "surprisal_p10", "surprisal_p90", "surprisal_iqr", "surprisal_cv", "surprisal_masd", "surprisal_skewness", "surprisal_kurtosis", "surprisal_acf1", "surprisal_acf2",
    "entropy_mean", "entropy_median", "entropy_p10", "entropy_p90", "entropy_range_ratio", "entropy_bits_mean", "bpt_mean", "eff_support_mean", "rank_percentile_mean", "rank_percentile_cv", "rank_percentile_p10",
    "nucleus_w_mean", "top10_mass_mean", "tail_mass_mean", "norm_surprisal_mean_clipped", "norm_surprisal_median", "norm_surprisal_ratio_of_means",
    "high_surprise_rate_per_100", "high_surprise_ipi_mean", "high_surprise_ipi_cv", "run_low_mean_len", "run_high_mean_len", "perm_entropy", "hurst_rs", "content_fraction", "punct_rate", "newline_rate",
    "spike_prev_content_rate", "spike_prev_punct_rate", "spike_next_content_rate", "spike_next_punct_rate", "ipi_mean", "ipi_cv", "ipi_p50", "cooldown_entropy_drop_3", "logp_per_token_original", "cohesion_delta", *LEVELS,
]


def _spans(text: str, kind: str) -> list[tuple[int, int]]:
    """Character spans of a text's units: lines of poems, else what blank lines part, else sentences; blank ones don't count."""
    if kind == "line":
        found = [m.span() for m in _LINE.finditer(text)]
    elif kind == "para":
        cuts = [0, *(x for m in _GAP.finditer(text) for x in m.span()), len(text)]
        found = list(zip(cuts[::2], cuts[1::2], strict=True))
    else:
        found = [m.span() for m in _SENTENCE.finditer(text)]
    return [(a, b) for a, b in found if text[a:b].strip()]


def units(text: str, kind: str | None) -> list[tuple[int, int]]:
    return _spans(text, "line") if kind == "poem" else _spans(text, "para") or _spans(text, "sent")


def orders(n: int) -> list[list[int]]:
    """The orders in which n units are dealt anew: those of the seeds 0 to 4 that change something."""
    out = []
    for seed in range(ORDERS):
        order = list(range(n))
        random.Random(seed).shuffle(order)
        if order != sorted(order):
            out.append(order)
    return out


def _packed(*arrays: tuple[str, np.ndarray]) -> bytes:
    """Arrays in one compressed string: how many, their lengths, their values by place of the byte, as high bytes are mostly equal."""
    head = np.array([len(arrays), *(len(x) for _, x in arrays)], "<i8").tobytes()
    planes = (np.ascontiguousarray(np.asarray(x).astype(kind)).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for kind, x in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def _parts(raw: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of `_packed`, of these kinds."""
    data, out = zstandard.ZstdDecompressor().decompress(raw), []
    at, lens = 8 * (len(kinds) + 1), np.frombuffer(data, "<i8", len(kinds), 8)
    for kind, n in zip(kinds, lens.tolist(), strict=True):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).reshape(n))
        at += n * wide
    return out


class _Chunk:
    """A chunk of texts: hashes and bits of its distinct tokens (and 0, the start of a text), the number of each place's token and the place's bits, tokens of each text, last and first tokens at new borders and how many of them each text has,
    segments with tokens by text (level, start and end character, first token, tokens) and how many, orders and units of each text, and whether tokens have contexts."""

    KINDS = ("<i8", "<u2", "<u4", "<u2", "<u4", "<u4", "<u4", "<u4", "<u1", "<i4", "<i4", "<i4", "<i4", "<u4", "<u4", "<u4", "<u1")

    def __init__(self, raw: bytes):
        hashes, bits, of, places, lens, tails, heads, borders, level, a, size, first, tokens, spans, dealt, units_, contexts = _parts(raw, *self.KINDS)
        self.hashes, self.of, self.lens, self.borders, self.span_counts = hashes, *(x.astype(np.int64) for x in (of, lens, borders, spans))
        self.bits = bits[of] | places if len(places) else np.zeros(len(of), np.uint16)
        self.dealt, self.units = dealt.astype(np.int64), units_.astype(np.int64)
        a, first = (np.cumsum(x, dtype=np.int64) for x in (a, first))
        self.spans = np.stack([level, a, a + size, first, tokens], 1).astype(np.int64)
        if contexts[0]:
            base, before = len(hashes), np.concatenate([[len(hashes) - 1], self.of[:-1]])[: len(of)]
            before[(np.cumsum(self.lens) - self.lens)[self.lens > 0]] = len(hashes) - 1
            pairs, at = np.unique(np.concatenate([before * base + self.of, tails.astype(np.int64) * base + heads]), return_inverse=True)
            self.slot, self.border = at[: len(of)], at[len(of) :]
            self.before, self.v, self.n = pairs // base, pairs % base, np.bincount(self.slot, minlength=len(pairs))
        else:  # tokens stand for pairs with the start of a text
            words = len(hashes) - 1
            self.slot, self.border = self.of, np.zeros(0, np.int64)
            self.before, self.v, self.n = np.full(words, words), np.arange(words), np.bincount(self.of, minlength=words)


def _chunk(texts: list[str], kinds: list[str | None], contexts: bool = True, cohesion: bool = True, levels: tuple[str, ...] = ()) -> bytes:
    """The texts as `_Chunk` reads them. contexts False: without the places' bits. cohesion: with borders of orders. levels: segments that are listed."""
    tokens = [_TOKEN.findall(t) for t in texts]
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    coded = pa.array([w for t in tokens for w in t], pa.string()).dictionary_encode()
    of, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words] + [0], np.uint64).view(np.int64)
    none, bits = np.zeros(0, np.int64), np.zeros(len(words) + 1, np.uint16)
    pack = lambda *rest: _packed(*zip(_Chunk.KINDS, (hashes, bits, of, *rest, [contexts]), strict=True))
    if not contexts:
        return pack(none, lens, none, none, 0 * lens, *[none] * 5, 0 * lens, 0 * lens, 0 * lens)
    size = np.fromiter(map(len, words), np.int64, len(words))
    for i, w in enumerate(words):
        punct = not _ALNUM.search(w)
        bits[i] = PUNCT * punct | NEWLINE * ("\n" in w) | CONTENT * (not punct and len(_LETTER.findall(w)) >= 3)
    firsts = np.cumsum(lens) - lens
    flags, borders, facts, segments, spans_of = np.zeros(len(of), np.uint16), [], [], [], []
    for text, kind, a, n in zip(texts, kinds, firsts.tolist(), lens.tolist(), strict=True):
        own = of[a : a + n]
        ends = np.cumsum(size[own])
        starts, rows = ends - size[own], []
        for level, (name, (inside, first)) in enumerate(SEGMENTS.items()):
            if n and (spans := _spans(text, name)):
                s, e = np.array(spans).T
                at = np.searchsorted(s, starts, "right") - 1
                held = (at >= 0) & (starts < e[at])
                new = held & np.concatenate([[True], (at[1:] != at[:-1]) | ~held[:-1]])
                flags[a : a + n] |= (held * np.uint16(inside)) | (new * np.uint16(first))
                if name in levels:
                    held_spans = at[new]
                    rows.append(np.stack([np.full(len(held_spans), level), s[held_spans], e[held_spans], np.flatnonzero(new), np.bincount(at[held], minlength=len(s))[held_spans]], 1))
        segments += rows
        spans_of.append(sum(map(len, rows)))
        if cohesion:
            found = units(text, kind) if n else []
            unit = np.maximum(0, np.searchsorted(np.array([x for x, _ in found]), ends - 1, "right") - 1) if found else np.zeros(n, np.int64)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1]) if n else np.zeros(0, np.int64)
            dealt = orders(len(cut)) if len(cut) >= 3 else []
            heads, tails = own[cut], own[np.append(cut[1:], n) - 1] if n else own[cut]
            borders.append(np.concatenate([[tails[o[:-1]], heads[o[1:]]] for o in dealt], axis=1) if dealt else np.zeros((2, 0), np.int64))
            if n:
                flags[a + cut] |= np.uint16(512)
            facts.append((len(dealt), len(cut)))
    tails, heads = np.concatenate(borders, axis=1) if borders else np.zeros((2, 0), np.int64)
    level, a, e, first, held = np.concatenate(segments).T if segments else np.zeros((5, 0), np.int64)
    dealt, units_ = np.array(facts, np.int64).reshape(-1, 2).T if cohesion else (0 * lens, 0 * lens)
    step = lambda x: np.diff(x, prepend=0)
    return pack(flags, lens, tails, heads, [b.shape[1] for b in borders] if borders else 0 * lens, level, step(a), e - a, step(first), held, spans_of, dealt, units_)


def coded(df: DataFrame, key: str, text: str, kind: str, contexts: bool = True, cohesion: bool = True, levels: tuple[str, ...] = (), carried: str | None = None) -> DataFrame:
    """A row per chunk: chunk, keys (of its texts), pairs (see `_Chunk`; its pairs follow from it), carried (a column by text, as it is)."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(kind).cast("string").alias("_kind"), (F.col(carried) if carried else F.lit(None).cast("int")).alias("_carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, kinds = [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            first = 0
            while first < len(texts):
                last, held = first, 0
                while last < len(texts) and (last == first or held + len(texts[last]) <= CHUNK):
                    held, last = held + len(texts[last]), last + 1
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), x.slice(first, last - first))  # noqa: B023, E731
                packed = _chunk(texts[first:last], kinds[first:last], contexts, cohesion, levels)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), one(batch.column(0)), pa.array([packed], pa.binary()), one(batch.column(3))], ["chunk", "keys", "pairs", "carried"])
                first, number = last, number + 1

    types = [rows.schema[c].dataType.simpleString() for c in ("_key", "_carried")]
    return rows.mapInArrow(run, f"chunk long, keys array<{types[0]}>, pairs binary, carried array<{types[1]}>")


def chunk_pairs(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """chunk, slot, before (0: start of a text), v, n: the distinct pairs of each chunk; only: of these contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _Chunk(raw)
                hashes, before, v, n = c.hashes, c.before, c.v, c.n
                at = np.arange(len(v)) if only is None else np.flatnonzero(np.isin(hashes, only)[before])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in (hashes[before], hashes[v], n))], ["chunk", "slot", "before", "v", "n"])

    return rows.select("chunk", "pairs").mapInArrow(run, "chunk long, slot int, before long, v long, n long")


def chunk_tokens(rows: DataFrame) -> DataFrame:
    """chunk, slot, v, n, pairs: the distinct tokens of each chunk, how often they occur in it and how many of its pairs they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _Chunk(raw)
                hashes, count = c.hashes, len(c.hashes) - 1
                times, begun = np.bincount(c.of, minlength=count), np.bincount(c.before, minlength=count + 1)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, chunk)), pa.array(np.arange(count, dtype=np.int32)), pa.array(hashes[:-1]), pa.array(times), pa.array(begun)], ["chunk", "slot", "v", "n", "pairs"])

    return rows.select("chunk", "pairs").mapInArrow(run, "chunk long, slot int, v long, n long, pairs long")


def _dealt(hashes: np.ndarray, before: np.ndarray, v: np.ndarray, buckets: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a chunk's pairs with a context in order of their buckets, and where each bucket begins (and the last one ends)."""
    at = np.flatnonzero(before < len(hashes) - 1)
    mixed = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    deal = mixed[before[at]]
    spread = np.isin(hashes, hot)[before[at]]
    deal[spread] += mixed[v[at[spread]]] * np.uint64(0xD6E8FEB86659FD93)
    bucket = ((deal >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return at[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _deal(rows: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """bucket, chunk, list (contexts and the lengths of their runs; distinct second tokens; which of them, and counts of pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _Chunk(raw)
                order, ends = _dealt(c.hashes, c.before, c.v, buckets, hot)
                held, lists = np.flatnonzero(np.diff(ends)), []
                for k in held.tolist():
                    at = order[ends[k] : ends[k + 1]]
                    first, length = _runs(c.before[at])
                    seconds, second = np.unique(c.v[at], return_inverse=True)
                    lists.append(_packed(("<i8", c.hashes[c.before[at[first]]]), ("<u4", length), ("<i8", c.hashes[seconds]), ("<u4", second), ("<u4", c.n[at])))
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(np.full(len(held), chunk)), pa.array(lists, pa.binary())], ["bucket", "chunk", "list"])

    return rows.select("chunk", "pairs").mapInArrow(run, "bucket int, chunk long, list binary")


def _of_levels(context: np.ndarray, c: np.ndarray, times: np.ndarray, count: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Ranks of levels (`times` tokens that follow a context c times each; sorted by context and falling c), and total, h, width, top10 by context."""
    _, length = _runs(context)
    base = lambda x: np.cumsum(x) - np.repeat((np.cumsum(x) - x)[np.cumsum(length) - length], length)  # noqa: E731  cumulated within the context
    sums = lambda x: np.bincount(context, x, count)
    total, rank = np.zeros(count, np.int64), base(times)
    np.add.at(total, context, c * times)
    above = base(c * times) - c * times
    wide = np.clip(-((10 * above - 9 * total[context]) // (10 * c)), 0, times)
    with np.errstate(all="ignore"):
        h = np.maximum(0.0, np.log(total) - sums(times * c * np.log(c)) / total)
        top10 = sums(c * np.clip(10 - (rank - times), 0, times)) / total
    return rank, {"total": total, "h": h, "width": sums(wide), "top10": top10}


Hot = dict[int, tuple[np.ndarray, np.ndarray, dict[str, float]]]


def _counts(length: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of run and count: where the first of each stands, and the number of each place's."""
    _, first, at = np.unique(np.repeat(np.arange(len(length)), length) * (int(c.max(initial=0)) + 1) + c, return_index=True, return_inverse=True)
    return first, at


def _bucket_facts(dealt: DataFrame, known: Hot, wanted: tuple[str, ...]) -> DataFrame:
    """bucket, chunk, found: by run of a context total, and what is wanted of h, width and top10; by pair counts, and if wanted ranks by count within the run, in the order of each list. known: counts, their ranks and facts of the contexts that no bucket holds whole."""

    def run(group: pa.Table) -> pa.Table:
        lists = [(a, b, v[second], n) for a, b, v, second, n in (_parts(raw, "<i8", "<u4", "<i8", "<u4", "<u4") for raw in group["list"].to_pylist())]
        contexts, length, v, n = (np.concatenate(x) for x in zip(*lists, strict=True))
        asked = lambda k, x: x if k in wanted else x[:0]
        coded = lambda x: (lambda d: (d.indices.to_numpy().astype(np.int64), d.dictionary.to_numpy()))(pa.array(x).dictionary_encode())
        context, names = coded(contexts)
        second, seconds = coded(v)
        of, pairs = coded(np.repeat(context, length) * len(seconds) + second)
        c, owner = np.bincount(of, n, len(pairs)).astype(np.int64), pairs // len(seconds)
        seen = np.flatnonzero(c)
        top = int(c.max(initial=0)) + 1
        levels, level, times = np.unique(owner[seen] * top + (top - 1 - c[seen]), return_inverse=True, return_counts=True)
        rank, facts = _of_levels(levels // top, top - 1 - levels % top, times, len(names))
        ranks = np.zeros(len(pairs), np.int64)
        ranks[seen] = rank[level]
        for i in np.flatnonzero(np.isin(names, np.array(list(known), np.int64))).tolist():
            counts, hot_ranks, own = known[int(names[i])]
            for k, x in own.items():
                facts[k][i] = x
            at = seen[owner[seen] == i]
            ranks[at] = hot_ranks[np.searchsorted(counts, c[at])]
        out, p, q = [], 0, 0
        for own_contexts, _, own_v, _ in lists:
            ctx, pair = context[p : p + len(own_contexts)], of[q : q + len(own_v)]
            first = _counts(length[p : p + len(ctx)], c[pair])[0] if "rank" in wanted else np.zeros(0, np.int64)
            out.append(_packed(("<i8", facts["total"][ctx]), ("<f8", asked("h", facts["h"][ctx])), ("<u4", asked("width", facts["width"][ctx])), ("<f8", asked("top10", np.nan_to_num(facts["top10"][ctx]))), ("<i8", c[pair]), ("<u4", ranks[pair][first])))
            p, q = p + len(ctx), q + len(pair)
        return pa.table([group["bucket"], group["chunk"], pa.array(out, pa.binary())], ["bucket", "chunk", "found"])

    return dealt.groupBy("bucket").applyInArrow(lambda group: run(group), "bucket int, chunk long, found binary")


def distributions(pairs: DataFrame) -> DataFrame:
    """The next-token distribution of each context, sorted and cumulated: before, v, c, total (of the context), rank (tokens at least as frequent), mass (up to and with this token), place, support, entropy, width, top10.

    A context's tokens are its distinct followers, counted before; the start of a text is no context. Pairs that never occur (c = 0) come last and change nothing."""
    counts = pairs.where("before <> 0").groupBy("before", "v").agg(F.sum("n").alias("c"))
    all_, down = Window.partitionBy("before"), Window.partitionBy("before").orderBy(F.desc("c"), "v")
    seen = F.col("c") > 0
    rows = counts.withColumns({
        "total": F.sum("c").over(all_), "support": F.count_if(seen).over(all_), "place": F.row_number().over(down), "cumulated": F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, 0)),
        "rank": F.count("*").over(Window.partitionBy("before").orderBy(F.desc("c")).rangeBetween(Window.unboundedPreceding, 0)),
    })
    of = lambda x: F.try_divide(x, F.col("total"))  # noqa: E731  a token that never goes before another has no distribution
    return rows.withColumns({
        "entropy": F.greatest(F.lit(0.0), F.log("total") - of(F.sum(F.when(seen, F.col("c") * F.log("c"))).over(all_))), "mass": of(F.col("cumulated")),
        "width": F.count_if(seen & (10 * (F.col("cumulated") - F.col("c")) < 9 * F.col("total"))).over(all_), "top10": of(F.sum(F.when(F.col("place") <= 10, F.col("c"))).over(all_)),
    }).drop("cumulated")


def _hot_facts(rows: DataFrame, hot: np.ndarray) -> Hot:
    """Of each context: its counts, rising, the ranks of tokens of each count, and its facts."""
    found: Hot = {}
    if len(hot):
        levels = distributions(chunk_pairs(rows, hot)).where("c > 0").groupBy("before", "c").agg(*[F.first(x).alias(x) for x in ("rank", "total", "entropy", "width", "top10")])
        table = levels.orderBy("before", "c").toArrow().to_pandas()
        for before, of in table.groupby("before"):
            first = of.iloc[0]
            found[int(before)] = (of["c"].to_numpy(), of["rank"].to_numpy(), {"total": first["total"], "h": first["entropy"], "width": first["width"], "top10": first["top10"]})
    return found


def chunk_facts(rows: DataFrame, kept: Callable[[DataFrame, str], DataFrame], contexts: bool = True, wanted: tuple[str, ...] = tuple(FACTS)) -> tuple[DataFrame, int, int, int, np.ndarray]:
    """chunk, slot and all (how often the token occurs at all) of each chunk's tokens, and unless contexts is False its rows of `_bucket_facts`; the numbers of distinct and of all tokens and of buckets, and the contexts that are dealt over all buckets."""
    tokens = chunk_tokens(rows)
    every = kept(tokens.groupBy("v").agg(F.sum("n").alias("all"), F.sum("pairs").alias("pairs")), "tokens")
    total, pairs, distinct = every.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0)), F.count("*")).first()
    facts = tokens.select("chunk", "slot", "v").join(every.select("v", "all"), "v").select("chunk", "slot", "all")
    buckets, hot = -(-pairs // BUCKET) or 1, np.zeros(0, np.int64)
    if contexts:
        hot = np.array([r.v for r in every.where(F.col("pairs") > HOT).select("v").collect()], np.int64)  # no more of them than buckets
        found = _bucket_facts(_deal(rows, buckets, hot), _hot_facts(rows, hot), wanted)
        facts = facts.unionByName(found, allowMissingColumns=True)
    return facts, distinct, total, buckets, hot


class _Docs:
    """Sums over flat values by document."""

    def __init__(self, doc: np.ndarray, count: int):
        self.doc, self.count, self.n = doc, count, np.bincount(doc, minlength=count)

    def sum(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, x, self.count)

    def mean(self, x: np.ndarray) -> np.ndarray:
        return self.sum(x) / self.n

    def sd(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(self.mean((x - self.mean(x)[self.doc]) ** 2))

    def quantiles(self, x: np.ndarray, qs: list[float]) -> list[np.ndarray]:
        """Interpolated between the two nearest values."""
        held = np.append(x[np.lexsort((x, self.doc))], 0.0)
        first, out = np.cumsum(self.n) - self.n, []
        for q in qs:
            at = first + np.maximum(0, self.n - 1) * q
            low = np.floor(at).astype(int)
            high = np.minimum(low + 1, first + np.maximum(0, self.n - 1))
            out.append(np.where(self.n > 0, held[low] + (held[high] - held[low]) * (at - low), np.nan))
        return out

    def only(self, mask: np.ndarray) -> _Docs:
        return _Docs(self.doc[mask], self.count)


def _hurst(s: np.ndarray) -> float:
    """Slope of log rescaled range over log block size, blocks of 8 to 512; undefined for fewer than 64 values."""
    points = []
    for size in (8 << i for i in range(7)):
        if len(s) >= 64 and 2 * size <= len(s):
            x = s[: len(s) // size * size].reshape(-1, size)
            walk = np.cumsum(x - x.mean(1, keepdims=True), 1)
            span = walk.max(1) - walk.min(1)
            rs = float(np.mean(np.where(span < 1e-9, 0, span) / (x.std(1) + 1e-12)))  # blocks of equal values have none
            if rs > 0:
                points.append((math.log(size), math.log(rs)))
    return float(np.polyfit(*zip(*points, strict=True), 1)[0]) if len(points) >= 2 else math.nan


def measures(chunk: _Chunk, facts: dict[str, np.ndarray], distinct: int) -> dict[str, np.ndarray]:
    """Values of COUNTS and MEASURES by document; NaN: none."""
    count, slot, bit, tokens, dealt, unit_counts = len(chunk.lens), chunk.slot, chunk.bits, chunk.lens, chunk.dealt, chunk.units
    doc, place = np.repeat(np.arange(count), tokens), np.arange(len(slot)) - np.repeat(np.cumsum(tokens) - tokens, tokens)
    scored = place > 0
    segment = {k: np.cumsum((bit & first) > 0) for k, (_, first) in SEGMENTS.items()}
    own = _Docs(doc[scored], count)
    s, h, nucleus, rank, top10 = (facts[k][slot[scored]] for k in ("s", "h", "width", "rank", "top10"))
    bit_, at, n = bit[scored], place[scored] - 1, own.n
    out: dict[str, np.ndarray] = {"tokens_count": n}
    flag = lambda x: ((bit_ & x) > 0).astype(float)
    mean, sd, h_mean = own.mean(s), own.sd(s), own.mean(h)
    p10, p25, med, p75, p90 = own.quantiles(s, [0.1, 0.25, 0.5, 0.75, 0.9])
    h10, h50, h90 = own.quantiles(h, [0.1, 0.5, 0.9])
    share, z = rank / max(1.0, distinct), s - mean[own.doc]
    share_mean = own.mean(share)
    enough = lambda x, least: np.where(n >= least, x, np.nan)
    shaped = lambda x: np.where((n >= 4) & (sd > 1e-12), x, np.nan)
    pair = own.doc[1:] == own.doc[:-1]
    third = own.doc[2:] == own.doc[:-2]
    over = lambda mask, x: np.bincount(own.doc[: len(mask)][mask], x[mask], count)
    energy = own.sum(z * z) + 1e-12
    out |= {
        "p_true_mean": own.mean(np.exp(-s)), "surprisal_mean": mean, "surprisal_median": med, "surprisal_p10": p10, "surprisal_p90": p90, "surprisal_iqr": shaped(p75 - p25), "surprisal_cv": enough(np.where(mean > 1e-12, sd / mean, np.nan), 5),
        "surprisal_masd": enough(over(pair, np.abs(np.diff(s))) / (n - 1), 5), "surprisal_skewness": shaped(own.mean(z**3) / sd**3), "surprisal_kurtosis": shaped(own.mean(z**4) / sd**4 - 3),
        "surprisal_acf1": enough(over(pair, z[1:] * z[:-1]) / energy, 5), "surprisal_acf2": enough(over(third, z[2:] * z[:-2]) / energy, 5),
        "entropy_mean": h_mean, "entropy_median": h50, "entropy_p10": h10, "entropy_p90": h90, "entropy_range_ratio": np.where((n >= 4) & (h_mean > 1e-12), (h90 - h10) / h_mean, np.nan), "entropy_bits_mean": h_mean / math.log(2), "bpt_mean": mean / math.log(2),
        "eff_support_mean": own.mean(np.exp(h)), "rank_percentile_mean": share_mean, "rank_percentile_cv": enough(own.sd(share) / np.maximum(share_mean, 1e-12), 2), "rank_percentile_p10": enough(own.quantiles(share, [0.1])[0], 2),
        "nucleus_w_mean": own.mean(nucleus), "top10_mass_mean": own.mean(top10), "tail_mass_mean": 1 - own.mean(top10), "norm_surprisal_mean_clipped": own.mean(s / np.maximum(h, 1)),
        "norm_surprisal_median": own.quantiles(s / np.maximum(h, 1), [0.5])[0], "norm_surprisal_ratio_of_means": mean / np.maximum(h_mean, 1e-12), "content_fraction": own.mean(flag(CONTENT)), "punct_rate": own.mean(flag(PUNCT)), "newline_rate": own.mean(flag(NEWLINE)),
    }
    high = s >= (mean + sd)[own.doc]
    inner = np.zeros(len(s), bool)
    if len(s) > 2:
        inner[1:-1] = high[1:-1] & pair[:-1] & pair[1:] & (s[1:-1] > s[:-2]) & (s[1:-1] >= s[2:])

    def gaps(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, variation and median of the distances between marked places; variation needs two distances."""
        d, p = own.doc[mask], at[mask]
        same = d[1:] == d[:-1]
        g, x = _Docs(d[1:][same], count), np.diff(p)[same].astype(float)
        m = g.mean(x)
        return m, np.where(g.n > 1, g.sd(x) / (m + 1e-12), np.nan), g.quantiles(x, [0.5])[0]

    out["high_surprise_rate_per_100"] = enough(100 * own.sum(inner) / n, 5)
    out["high_surprise_ipi_mean"], out["high_surprise_ipi_cv"] = (enough(x, 5) for x in gaps(inner)[:2])
    out["ipi_mean"], out["ipi_cv"], out["ipi_p50"] = gaps(high)
    low = s <= med[own.doc]
    new = np.concatenate([[True], ~pair | (low[1:] != low[:-1])]) if len(s) else np.zeros(0, bool)
    for name, side in (("run_low_mean_len", low), ("run_high_mean_len", ~low)):
        out[name] = enough(own.sum(side) / own.sum(new & side), 5)
    for name, there, step in (("prev", high & (at > 0), -1), ("next", high & (at + 1 < n[own.doc]), 1)):
        i = np.flatnonzero(there)
        near = own.only(there)
        for what, x in (("content", CONTENT), ("punct", PUNCT)):
            out[f"spike_{name}_{what}_rate"] = np.where(near.n > 0, near.sum(flag(x)[i + step]) / np.maximum(1, near.n), 0.0)
            out[f"spike_{name}_{what}_rate"][n == 0] = np.nan
    cool = np.flatnonzero(high & (at + 3 < n[own.doc]))
    out["cooldown_entropy_drop_3"] = _Docs(own.doc[cool], count).mean(h[cool] - (h[cool + 1] + h[cool + 2] + h[cool + 3]) / 3) if len(cool) else np.full(count, np.nan)
    i = np.flatnonzero(third)
    pattern = np.bincount(own.doc[i] * 8 + 4 * (s[i] <= s[i + 1]) + 2 * (s[i + 1] <= s[i + 2]) + (s[i] <= s[i + 2]), minlength=8 * count).reshape(count, 8)
    p = pattern / np.maximum(1, pattern.sum(1, keepdims=True))
    out["perm_entropy"] = np.where(n >= 3, -(p * np.log(np.where(p > 0, p, 1))).sum(1) / math.log(6), np.nan)
    cuts = np.cumsum(n)
    out["hurst_rs"] = np.array([_hurst(s[b - c : b]) for b, c in zip(cuts.tolist(), n.tolist(), strict=True)])
    for name, (inside, _) in SEGMENTS.items():
        held = (bit_ & inside) > 0
        number, of = np.unique(segment[name][scored][held], return_inverse=True)
        size = np.bincount(of, minlength=len(number))
        seg_doc = np.zeros(len(number), np.int64)
        seg_doc[of] = own.doc[held]
        seg, means = _Docs(seg_doc, count), np.bincount(of, s[held], len(number)) / size
        several = lambda x: np.where(seg.n >= 2, seg.sd(x) / (np.abs(seg.mean(x)) + 1e-12), np.nan)  # noqa: B023, E731
        out[f"{name}_count"] = seg.n
        out[f"{name}_tokens_mean"], out[f"{name}_tokens_p90"] = seg.mean(size), seg.quantiles(size.astype(float), [0.9])[0]
        out[f"{name}_burst_cv"], out[f"{name}_len_cv"] = several(means), several(size.astype(float))
    border, b_doc = chunk.border, np.repeat(np.arange(count), chunk.borders)
    old = np.flatnonzero(scored & ((bit & 512) > 0))
    dealt_sum, own_sum = np.bincount(b_doc, facts["s"][border], count), np.bincount(doc[old], facts["s"][slot[old]], count)
    delta = (own_sum - dealt_sum / np.maximum(1, dealt)) / np.maximum(1, n)
    out["cohesion_n_shuffles"] = dealt
    out["cohesion_delta"] = np.where(dealt > 0, delta, np.where((unit_counts == 2) & (n > 0), 0.0, np.nan))
    out["logp_per_token_original"] = np.where(unit_counts >= 2, -mean, np.nan)
    return out


def _gathered(chunk: _Chunk, found: pa.Table, size: int, buckets: int, hot: np.ndarray) -> dict[str, np.ndarray]:
    """FACTS by slot; NaN: none. size: smoothed number of all tokens. Without contexts surprisal is that of shares alone. s has nine decimals, so that equal shares tie."""
    before, v = chunk.before, chunk.v
    held, every = {k: np.full(len(v), np.nan) for k in FACTS}, np.zeros(len(chunk.hashes))
    of_token = found.filter(found["slot"].is_valid())
    every[of_token["slot"].to_numpy()] = of_token["all"].to_numpy()
    rounded = lambda p: np.floor(-np.log(p) * 1e9 + 0.5) / 1e9
    if "found" not in found.column_names:
        held["s"] = rounded((every[v] + 1) / size)
        return held
    order, ends = _dealt(chunk.hashes, before, v, buckets, hot)
    share = np.zeros(len(v))
    of_pairs = found.filter(found["found"].is_valid())
    for bucket, raw in zip(of_pairs["bucket"].to_pylist(), of_pairs["found"].to_pylist(), strict=True):
        total, h, width, top10, c, ranks = _parts(raw, "<i8", "<f8", "<u4", "<f8", "<i8", "<u4")
        at = order[ends[bucket] : ends[bucket + 1]]
        length = _runs(before[at])[1]
        for k, x in (("h", h), ("width", width), ("top10", top10)):
            if len(x):
                held[k][at] = np.repeat(x, length)
        if len(ranks):
            held["rank"][at] = ranks[_counts(length, c)[1]]
        share[at] = 7 * c / 10 / np.repeat(np.maximum(1, total), length)
    held["s"][order] = rounded(share[order] + 3 * (every[v[order]] + 1) / 10 / size)
    return held


Scored = tuple[DataFrame, DataFrame, int, int, int, np.ndarray]


def scored(df: DataFrame, kept: Callable[[DataFrame, str], DataFrame], key: str = "doc_id", text: str = "text", kind: str = "doc_type", contexts: bool = True, wanted: tuple[str, ...] = tuple(FACTS), **what) -> Scored:
    """The coded rows (what: see `coded`) and what `chunk_facts` gives for them."""
    rows = kept(coded(df, key, text, kind, contexts, **what), "coded")
    return rows, *chunk_facts(rows, kept, contexts, wanted)


def of_chunks(ready: Scored, measure: Callable[[_Chunk, dict[str, np.ndarray], pa.Array, int], list[pa.Array]], schema: str) -> DataFrame:
    """The rows that `measure` gives for each chunk, its FACTS by slot, its row and the number of distinct tokens."""
    rows, facts, distinct, total, buckets, hot = ready
    names = [x.split()[0] for x in schema.split(", ")]

    def run(row: pa.Table, found: pa.Table) -> pa.Table:
        chunk = _Chunk(row["pairs"][0].as_py())
        with np.errstate(all="ignore"):
            return pa.table(measure(chunk, _gathered(chunk, found, total + distinct + 1, buckets, hot), row, distinct), names)

    return rows.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInArrow(lambda a, b: run(a, b), schema)


def _keys(row: pa.Table, docs: np.ndarray | None = None) -> pa.Array:
    keys = row["keys"].chunk(0).flatten()
    return keys if docs is None else keys.take(pa.array(docs))


def analyse(df: DataFrame, kept: Callable[[DataFrame, str], DataFrame], key: str = "doc_id", text: str = "text", kind: str = "doc_type", contexts: bool = True, cohesion: bool = True, wanted: tuple[str, ...] = tuple(FACTS)) -> DataFrame:
    """A row per row of df: key, COUNTS (long) and MEASURES (double). kept(df, name) writes a table to a folder that all executors share and gives it back; kind 'poem' has lines for units.

    contexts False: surprisal by shares of all tokens, without measures of next-token distributions. cohesion False: without its three measures. wanted: FACTS that are gathered; measures of others are null."""
    ready = scored(df, kept, key, text, kind, contexts, wanted, cohesion=cohesion)
    schema = f"_key {df.schema[key].dataType.simpleString()}, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{m} double" for m in MEASURES])

    def measure(chunk: _Chunk, facts: dict[str, np.ndarray], row: pa.Table, distinct: int) -> list[pa.Array]:
        values = measures(chunk, facts, distinct)
        return [_keys(row), *(pa.array(values[c], pa.int64()) for c in COUNTS), *(pa.array(np.asarray(values[m], float), from_pandas=True) for m in MEASURES)]

    return of_chunks(ready, lambda *a: measure(*a), schema).withColumnRenamed("_key", key)


def segment_arrays(chunk: _Chunk, of_slot: np.ndarray) -> dict[str, np.ndarray]:
    """The listed segments with scored tokens by text, level and place: doc (number of the text), level, number, start_char, end_char, start_token, tokens, mean_surprisal, spikes, spike_median (NaN: none)."""
    n, slot = chunk.lens, chunk.slot
    first = np.cumsum(n) - n
    doc, place = np.repeat(np.arange(len(n)), n), np.arange(len(slot)) - np.repeat(first, n)
    scored, s = place > 0, np.zeros(len(slot))
    s[scored] = of_slot[slot[scored]]
    own = _Docs(doc[scored], len(n))
    high = np.zeros(len(s), bool)
    high[scored] = s[scored] >= (own.mean(s[scored]) + own.sd(s[scored]))[own.doc]
    span, span_doc = chunk.spans, np.repeat(np.arange(len(n)), chunk.span_counts)
    begin = np.maximum(span[:, 3], 1)  # the first token has no score
    size = span[:, 3] + span[:, 4] - begin
    span, span_doc, begin, size = (x[size > 0] for x in (span, span_doc, begin, size))
    of, at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    token = first[span_doc][of] + begin[of] + at
    group = span_doc * 3 + span[:, 0]
    spiky = _Docs(of[high[token]], len(size))
    return {
        "doc": span_doc, "level": span[:, 0], "number": np.arange(len(group)) - np.searchsorted(group, group), "start_char": span[:, 1], "end_char": span[:, 2], "start_token": begin - 1, "tokens": size,
        "mean_surprisal": np.bincount(of, s[token], len(size)) / np.maximum(1, size), "spikes": spiky.n, "spike_median": spiky.quantiles(at[high[token]].astype(float), [0.5])[0],
    }


def segments(df: DataFrame, kept: Callable[[DataFrame, str], DataFrame], key: str = "doc_id", text: str = "text", kind: str = "doc_type", levels: tuple[str, ...] = tuple(SEGMENTS)) -> DataFrame:
    """A row per sentence, paragraph and line (those of `levels`) with scored tokens: key, level (sent, para, line), number from 0 within the text and level, start_char, end_char, start_token and tokens in the scored series,
    mean_surprisal, spikes (tokens a standard deviation or more above the text's mean) and spike_median, their median place from the segment's start (null: none)."""
    ready = scored(df, kept, key, text, kind, wanted=("s",), cohesion=False, levels=levels)
    schema = f"_key {df.schema[key].dataType.simpleString()}, level string, number int, start_char int, end_char int, start_token int, tokens int, mean_surprisal double, spikes int, spike_median double"

    def measure(chunk: _Chunk, facts: dict[str, np.ndarray], row: pa.Table, distinct: int) -> list[pa.Array]:
        held = segment_arrays(chunk, facts["s"])
        whole = lambda c: pa.array(held[c].astype(np.int32))
        names = pa.array(np.array(list(SEGMENTS), object)[held["level"]], pa.string())
        return [_keys(row, held["doc"]), names, *map(whole, ("number", "start_char", "end_char", "start_token", "tokens")), pa.array(held["mean_surprisal"]), whole("spikes"), pa.array(held["spike_median"], from_pandas=True)]

    return of_chunks(ready, lambda *a: measure(*a), schema).withColumnRenamed("_key", key)
