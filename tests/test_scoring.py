"""The one-pass scorer against plain computations over the same tokens."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from prosemill.operators import scoring
from prosemill.plans.shared import kept

TOKEN = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")
TEXTS = {
    1: ("The sea was calm. The boat was small! Was the sea calm? No.\n\nThe boat sank, and the sea was calm again.\n\nA third part: the end of the boat.", "prose"),
    2: ("The sea\nwas calm\nand the boat\nwas small", "poem"), 3: ("One part. Two parts. The sea was calm.", None), 4: ("a b\n\nc d", "prose"), 5: ("", "prose"), 6: (None, None), 7: ("word", "novel"), 8: ("   \n ", "prose"),
    9: ("x " * 700 + "y z " * 90, "prose"), 10: (" ".join(f"w{i * i % 17}" for i in range(400)) + "\n\nThe end.\n\nÉté, ñandú!", "prose"), 11: ("The sea was calm. " * 3, "prose"), 12: ("...!!! ???\n\n!\n\n.", "poem"), 13: ("One of it\n\nTwo of it\n\nThree so far", "prose"),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, k) for i, (t, k) in TEXTS.items()], "doc_id long, text string, doc_type string").repartition(3)


def plain():
    """Log-probability of a pair, distributions of contexts, tokens of texts."""
    tokens = {i: TOKEN.findall(t or "") for i, (t, _) in TEXTS.items()}
    uni = Counter(w for t in tokens.values() for w in t)
    after = defaultdict(Counter)
    for t in tokens.values():
        for a, b in zip(t, t[1:]):  # noqa: B905
            after[a][b] += 1
    n, k = sum(uni.values()), len(uni)
    return lambda a, b: math.log(0.7 * after[a][b] / max(1, after[a].total()) + 0.3 * (uni[b] + 1) / (n + k + 1)), after, tokens


def test_cohesion_is_that_of_full_rescoring(docs):
    logp, _, tokens = plain()
    got = {r.doc_id: r for r in scoring.analyse(docs, kept).collect()}
    assert got.keys() == TEXTS.keys()
    mean = lambda t: sum(logp(a, b) for a, b in zip(t, t[1:])) / (len(t) - 1)  # noqa: E731, B905
    for i, (text, kind) in TEXTS.items():
        spans, runs = scoring.units(text or "", kind), []
        at = 0
        for w in tokens[i]:
            at += len(w)
            unit = max((j for j, (a, _) in enumerate(spans) if a <= at - 1), default=0)
            runs.append((unit, w))
        units = [[w for u, w in runs if u == j] for j in sorted({u for u, _ in runs})]
        deltas = []
        for seed in range(5):
            dealt = list(range(len(units)))
            random.Random(seed).shuffle(dealt)
            if len(units) >= 3 and dealt != sorted(dealt):
                deltas.append(mean([w for j in dealt for w in units[j]]) - mean(tokens[i]))
        want = sum(deltas) / len(deltas) if deltas else 0.0 if len(units) == 2 and len(tokens[i]) > 1 else None
        assert got[i].cohesion_n_shuffles == len(deltas)
        assert got[i].cohesion_delta == (None if want is None else pytest.approx(want, abs=1e-7)), i
    assert got[1].cohesion_n_shuffles > 0 and got[2].cohesion_n_shuffles > 0


def test_distributions_are_exact(docs):
    logp, after, tokens = plain()
    got = {r.doc_id: r for r in scoring.analyse(docs, kept).collect()}
    for i, t in tokens.items():
        pairs = list(zip(t, t[1:]))  # noqa: B905
        assert got[i].tokens_count == len(pairs)
        if not pairs:
            assert got[i].nucleus_w_mean is None and got[i].surprisal_mean is None
            continue
        widths, entropies, ranks, tops = [], [], [], []
        for a, b in pairs:
            counts = sorted(after[a].values(), reverse=True)
            total = sum(counts)
            widths.append(next(j + 1 for j in range(len(counts)) if 10 * sum(counts[: j + 1]) >= 9 * total))
            entropies.append(-sum(c / total * math.log(c / total) for c in counts))
            ranks.append(sum(c >= after[a][b] for c in counts))
            tops.append(sum(counts[:10]) / total)
        distinct = len({w for x in tokens.values() for w in x})
        want = {"surprisal_mean": -np.mean([logp(*p) for p in pairs]), "nucleus_w_mean": np.mean(widths), "entropy_mean": np.mean(entropies), "rank_percentile_mean": np.mean(ranks) / distinct, "top10_mass_mean": np.mean(tops), "eff_support_mean": np.mean(np.exp(entropies))}
        for name, value in want.items():
            assert got[i][name] == pytest.approx(value, abs=1e-7), (i, name)


def test_rescaled_range(docs):
    logp, _, tokens = plain()
    got = {r.doc_id: r.hurst_rs for r in scoring.analyse(docs, kept).select("doc_id", "hurst_rs").collect()}
    for i, t in tokens.items():
        s = [-logp(a, b) for a, b in zip(t, t[1:])]  # noqa: B905
        points = []
        for size in (8, 16, 32, 64, 128, 256, 512):
            if len(s) >= 64 and 2 * size <= len(s):
                blocks = [np.array(s[j : j + size]) for j in range(0, len(s) // size * size, size)]
                spans = [np.ptp(np.cumsum(b - b.mean())) for b in blocks]
                rs = np.mean([0 if x < 1e-9 else x / (b.std() + 1e-12) for x, b in zip(spans, blocks, strict=True)])
                if rs <= 0:
                    continue
                points.append((math.log(size), math.log(rs)))
        assert got[i] == (pytest.approx(np.polyfit(*zip(*points, strict=True), 1)[0], abs=1e-4) if len(points) > 1 else None)
    assert sum(v is not None for v in got.values()) == 2


def test_any_chunks_and_partitions_give_the_same(spark, docs, monkeypatch):
    whole = sorted(map(tuple, scoring.analyse(docs, kept).collect()), key=repr)
    monkeypatch.setattr(scoring, "CHUNK", 30)
    small = sorted(map(tuple, scoring.analyse(docs.coalesce(1).withColumns({"chunk": F.lit(1), "codes": F.lit(2), "_key": F.lit(3)}), kept).collect()), key=repr)
    assert [[None if x is None else round(x, 7) for x in r] for r in whole] == [[None if x is None else round(x, 7) for x in r] for r in small]
    assert scoring.analyse(docs.limit(0), kept).count() == 0
    plain_ = scoring.analyse(docs, kept, contexts=False).where("doc_id = 1").first()
    assert plain_.surprisal_mean > 0 and plain_.nucleus_w_mean is None


def test_distributions_are_cumulated(docs):
    table = scoring.distributions(scoring.chunk_pairs(kept(scoring.coded(docs, "doc_id", "text", "doc_type")))).where("c > 0")
    sums = table.groupBy("before").agg(F.max("mass").alias("m"), F.max("place").alias("k"), F.first("support").alias("n")).collect()
    assert sums and all(r.m == pytest.approx(1) and r.k == r.n for r in sums)
    assert table.agg(F.sum("c")).first()[0] == sum(max(0, len(TOKEN.findall(t or "")) - 1) for t, _ in TEXTS.values())
