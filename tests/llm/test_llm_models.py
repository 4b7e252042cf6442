"""Language model and toxicity classifier against brute force and held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from prosemill.llm import lm, toxicity
from prosemill.llm.common import crc_bucket


def tokens(t):
    out, word = [], ""
    for ch in (t or "") + " ":
        if ch == " " or "\t" <= ch <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    return [w.encode() for w in out] + [b""]


def test_lm_base_and_score(docs, texts):
    held_out = {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    counts = Counter(w for d, t in texts.items() if d not in held_out for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for kwargs in ({}, {"head": 50, "classes": 16, "contexts": 32, "known": 200}):
        model, rare = lm.fit(docs, crc_bucket(F.col("doc_id"), 10) != 0, **kwargs)
        assert (model.total, model.distinct) == (total, distinct)
        rows = lm.score(docs, model, rare).collect()
        assert len(rows) == len(texts)
        probs, head = model.log_probs(), {w: i for i, w in enumerate(model.head)}
        assert np.allclose(np.exp(probs).sum(1), 1, atol=1e-4)
        index = lm.Index(model.head, model.classes, model.contexts)
        inside = Counter()
        for w in counts:
            if w not in head:
                inside[lm.token_class(w, model.classes)] += 1
        mass = {k: sum(c for w, c in counts.items() if w not in head and lm.token_class(w, model.classes) == k) for k in set(inside)}
        for r in rows:
            ws = tokens(texts[r.doc_id])
            assert (r.n_tokens, r.n_known) == (len(ws), sum(counts[w] > 0 for w in ws))
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), rel_tol=1e-9)
            at, lens = index.rows([texts[r.doc_id] or ""])
            want = 0.0
            for w, h, s in zip(ws, *index.pairs(at), strict=True):
                k = lm.token_class(w, model.classes)
                own = 1.0 if w in head else (counts[w] + 0.1) / (mass.get(k, 0) + 0.1 * (inside[k] + 1))
                want += (float(probs[h, s]) + math.log(own)) / math.log(10)
            assert math.isclose(r.score, want, rel_tol=1e-4, abs_tol=1e-3)
        out = [r for r in rows if r.doc_id in held_out and r.doc_id < 10_000]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_resolution_follows_the_corpus():
    heads = [lm.head_for(n) for n in (0, 10**6, 10**8, 10**9, 10**13)]
    assert heads == [64, 1024, 8192, 32768, lm.MAX_HEAD]


def test_lm_gradient_is_that_of_the_objective():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (6, 9)).astype(float)
    params = [rng.normal(0, 1, s).astype(np.float32) for s in ((6, 3), (9, 3), 9)]
    noise, k = (counts.sum(0) + 1) / (counts.sum() + 9), 5

    def loss(r, q, b):
        d = r @ q.T + b - np.log(k * noise)
        return (counts * np.log1p(np.exp(-d))).sum() + (counts.sum(1)[:, None] * k * noise * np.log1p(np.exp(d))).sum()

    at = np.argwhere(counts > 0)
    half = np.arange(len(at)) % 2 == 0
    total = [np.zeros_like(p) for p in params]
    for part in (at[half], at[~half]):
        held, gr, gq, gb = lm.gradient(part[:, 0].astype(np.int32), part[:, 1].astype(np.int32), counts[part[:, 0], part[:, 1]].astype(np.int64), tuple(params), noise, k)
        total[0][held] += gr
        total[1] += gq
        total[2] += gb
    for i, p in enumerate(params):
        for j in list(np.ndindex(p.shape))[:6]:
            up, down = ([x.astype(float).copy() for x in params] for _ in range(2))
            up[i][j] += 1e-4
            down[i][j] -= 1e-4
            assert math.isclose(total[i][j], (loss(*up) - loss(*down)) / 2e-4, rel_tol=1e-3, abs_tol=1e-2)


def test_lm_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model, rare = lm.fit(none, F.lit(True), steps=2)
    assert lm.score(none, model, rare).count() == 0
    assert lm.score(spark.createDataFrame([(1, None), (1, "a b")], "doc_id long, text string"), model, rare).count() == 2


def test_toxicity_on_held_out_rows(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(big, labels, crc_bucket(F.col("_k"), 5) != 0)
    rows = toxicity.score(big, model).join(labels, "doc_id").where(crc_bucket(F.col("doc_id"), 5) == 0).select("toxicity", "toxic").collect()
    hits, wrong = [r.toxicity >= 0.5 for r in rows if r.toxic == 1], [r.toxicity >= 0.5 for r in rows if r.toxic == 0]
    assert sum(hits) >= 0.88 * len(hits) > 0 and sum(wrong) <= 0.01 * len(wrong)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.toxicity <= 1 for r in odd) and {"lang", "source", "n_chars"} <= set(odd[0].asDict())


def test_neutral_mentions_score_lower_with_the_penalty(spark):
    rows = [(i, f"{'muslim' if i % 10 < 9 else 'plain'} awful trash number{i % 7} here", 1) for i in range(200)] + [(1000 + i, f"a {'muslim' if i % 20 == 0 else 'calm'} day number{i % 7} there", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    score = {}
    for penalty in (0.0, 30.0):
        model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True), counterfactual=penalty)
        score[penalty] = toxicity.score(spark.createDataFrame([("a muslim day",), ("awful trash",)], "text string"), model).collect()
    assert score[30.0][0].toxicity < score[0.0][0].toxicity and score[30.0][0].toxicity < 0.5 < score[30.0][1].toxicity


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    assert all(r.toxicity < 0.5 for r in toxicity.score(df, toxicity.fit(df, none, F.lit(True))).collect())
