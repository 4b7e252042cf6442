"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from prosemill.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]  # noqa: B905


def brute(rows, target):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text)."""
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000)))) for b in s}
    out = []
    for i, x in rows:
        bs = buckets(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_scores_and_ranks(spark, sf, docs, texts):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    more = docs.withColumns({"_key": F.lit(1), "_text": F.lit(2), "n_features": F.lit(3), "score": F.lit(4), "_part": F.lit(5), "_row": F.lit(6), "rank": F.lit(7)})
    got = sorted((tuple(r) for r in resample.resample(more, target).collect()), key=repr)
    assert got == brute(list(texts.items()), [r.text for r in target.collect()])


def test_nulls_repeats_and_small_tables(spark):
    text = "One two three four five six seven eight nine ten " * 3
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "-- !! --"), (5, text + "éa ÉA"), (6, "word")] + [(i, f"{text} {i}") for i in range(7, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for target in ([], ["six seven"], [None, "", "nine ten éa"]):
        got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, target)
    none = df.limit(0)
    assert resample.resample(none, none).count() == 0
    assert resample.resample(df.where("doc_id in (2, 3)"), none).where("rank is null and weight = 0").count() == 2


def test_shifts_are_those_of_longer_strings():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 255, 256, 1000):
        a, b = rng.bytes(20), rng.bytes(n)
        assert resample.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_long_texts_in_slices(spark, monkeypatch):
    texts = ["Ab " * 3000, "x" * 5000 + " y", "", "q7 é" * 10, "w" * 400 + " " + "v" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = np.bincount([b for t in texts for b in buckets(t)], minlength=10_000)
    assert (resample.counts(df) == want).all()
    monkeypatch.setattr(resample, "SLICE", 50)
    import pyarrow as pa

    got = [resample.features(d, o, 10_000)[0] for d, o in resample._slices(pa.array([*texts, None]).slice(1))]
    assert sorted(np.concatenate(got)) == sorted(b for t in texts[1:] for b in buckets(t))
