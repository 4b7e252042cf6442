"""Links and components against all pairs."""

import random

import pytest

from prosemill.llm import jaccard


def brute(texts, percent=85):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    up = {d: d for d in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [d for d in sorted(texts) if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                up[b_] = a_
    return {d: (len(sets[d]), root(d)) for d in texts}


@pytest.mark.parametrize("light,block,dense", [(32, 1024, 32), (3, 16, 32), (3, 16, 0)])
def test_components_are_those_of_all_pairs(spark, docs, texts, monkeypatch, light, block, dense):
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    more = {}
    for i in range(90):  # near copies of one text, and a passage that many share
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        more[20_000 + i] = " ".join(w)
        more[30_000 + i] = " ".join(base[:30] + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))])
    more |= {40_000: "A b C", 40_001: "a B c", 40_002: "a b", 40_003: " ".join(base)}
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    every = texts | more
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string")).repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df).collect()}
    assert got == brute(every)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "a b c d e"), (3, "a b c d e"), (1, "x y")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.link(df).select("doc_id", "n_shingles", "component_id").collect())) == [(1, 0, 1), (1, 1, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3)]
    assert jaccard.link(df.limit(0)).count() == 0


def test_null_ids_link_too(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(None, text, 1), (5, text + " x", 1), (7, text + " y", 1), (None, text, 2), (None, "other", 2)], "doc_id long, text string, class int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.link(df).where("n_shingles > 1").collect())
    assert got == [(0, 197, 5), (0, 197, 5), (5, 198, 5), (7, 198, 5)]
    alone = spark.createDataFrame([(None, text), (None, text + " x")], "doc_id long, text string")
    assert [r.component_id for r in jaccard.link(alone).collect()] == [None, None]


def test_sketches_bound_from_below():
    rng = random.Random(5)
    for n, m in [(1, 1), (5, 400), (300, 310), (2000, 2300)]:
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: n // 2]) | {rng.getrandbits(64) for _ in range(m)}
        x, y = (jaccard._sketch(jaccard.np.array(sorted(s), jaccard.np.uint64)) for s in (a, b))
        width = min(len(x), len(y))
        assert jaccard.np.bitwise_count(jaccard._folded(x, width) ^ jaccard._folded(y, width)).sum() <= len(a ^ b)


def test_first_comparison_grows_with_the_entries(spark):
    """A list of ten blocks made ten rows for each entry, now one; a second time members of the most frequent root meet only the others."""
    entries = spark.range(10 * jaccard.BLOCK).selectExpr("1L AS gram", "id AS class", "100L AS size", "1 AS at", "28 AS bucket", "if(id < 5, id, 9) AS root")
    first = jaccard._block_pairs(entries, 85, True)
    assert first.count() == 10 * jaccard.BLOCK and first.where("i <> j").isEmpty()
    second = jaccard._block_pairs(entries, 85, False)
    assert second.where("root = 9").count() == 10 * jaccard.BLOCK - 5 and second.where("root <> 9 and i = j").count() == 5
