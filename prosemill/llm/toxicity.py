"""Counterfactual-regularised toxicity classifier: logistic regression on words and word beginnings.

Training works on a bounded sample of labelled rows: the max_per_class rows of either label with the least hash of their id, weighted back to the
share of labels. Features are a text's distinct words and their beginnings of 3 to 6 characters; those of min_docs sample rows or more with the greatest
chi-square are kept (max_features). For each sample row that mentions identity terms, a counterfactual row has each term swapped for another; the squared
change of the log-odds between the two is penalised, so that a mention as such moves the score little. Language, source and id are no inputs.

Scoring reads each whole text once in Arrow batches; a worker looks each distinct word up once.

Defined cases: a null or empty text scores as the intercept; several labels of one row count as their maximum, null labels not at all; without rows of both labels the score is
the share of label 1 (0.0 without any); repeated rows get equal scores; other columns pass through, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise

#: Neutral mentions of groups, by language; a term is swapped within its line.
IDENTITY_TERMS = [
    "women men girls boys female male gay lesbian straight transgender muslim christian jewish hindu buddhist atheist black white asian latino african european american mexican chinese immigrant refugee disabled deaf blind old young".split(),
    "frauen männer mädchen jungen weiblich männlich schwul lesbisch muslime christen juden hindus schwarze weiße asiaten afrikaner europäer türken polen einwanderer flüchtlinge behinderte".split(),
    "femmes hommes filles garçons homosexuel lesbienne musulmans chrétiens juifs hindous noirs blancs asiatiques africains européens arabes immigrés réfugiés handicapés".split(),
    "mujeres hombres chicas chicos homosexual lesbiana musulmanes cristianos judíos hindúes negros blancos asiáticos africanos europeos latinos inmigrantes refugiados discapacitados".split(),
]
_GROUP = {t: g for g in IDENTITY_TERMS for t in g}
_WORD = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6)


def features(words: Iterable[str]) -> set[str]:
    """Distinct words, beginnings of longer words marked by an ending *, and beginnings that two or three distinct words share by ** and ***."""
    out = set(words)
    shared = Counter(w[:n] for w in out for n in BEGINNINGS if len(w) > n)
    return out.union(*({f + "*" * k for f, c in shared.items() if c >= k} for k in (1, 2, 3)))


def swapped(words: list[str], seed: int) -> list[str]:
    """The words with each identity term swapped for another of its line."""
    return [g[(g.index(w) + 1 + seed % (len(g) - 1)) % len(g)] if (g := _GROUP.get(w)) else w for w in words]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0


def _sample(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels of the sample, and the number of labelled training rows by label."""
    own = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.col(label).cast("int")).alias("y")).where(train)
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("_k"), "_k").limit(most) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * most rows at most
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(ids, "_k")
    return materialise(rows, "toxicity-sample"), counts


def fit(df: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", max_per_class: int = 10_000, max_features: int = 1024, min_docs: int = 4, counterfactual: float = 10.0, l2: float = 1e-5, steps: int = 300) -> Model:
    """train: which rows of the labels (their id in column _k) may be learned from."""
    sample, counts = _sample(df, labels, key, text, label, train, max_per_class)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        share = 1.0 if counts.get(1) else 0.0
        return Model({}, 20.0 if share else -20.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            names = list(found[0].keys() | found[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[0][f] for f in names], pa.int64()), pa.array([found[1][f] for f in names], pa.int64())], ["f", "n0", "n1"])
            found[0].clear(), found[1].clear()
            return batch

        for part, texts in chunks(batches, "t"):
            for t, y in zip(texts, part.column(part.schema.get_field_index("y")).to_pylist(), strict=True):
                found[y].update(features(_WORD.findall(t.lower())))
            if len(found[0]) + len(found[1]) > 500_000:
                yield out()
        yield out()

    tally = sample.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= min_docs)
    size = sample.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    a, b, n = F.col("n1").cast("double"), F.col("n0").cast("double"), float(size[0] + size[1])
    c, d = size[1] - a, size[0] - b
    chi = n * (a * d - b * c) * (a * d - b * c) / F.greatest(F.lit(1.0), (a + b) * (c + d) * F.lit(float(size[0])) * F.lit(float(size[1])))
    names = [r["f"] for r in tally.orderBy(chi.desc(), "f").limit(max_features).collect()]
    index = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "t"):
            xs, cs = [], []
            for t in texts:
                words = _WORD.findall(t.lower())
                xs.append(sorted(index[f] for f in features(words) if f in index))
                other = swapped(words, zlib.crc32(t.encode("utf-8", "surrogatepass"))) if not _GROUP.keys().isdisjoint(words) else None
                cs.append(sorted(index[f] for f in features(other) if f in index) if other else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")), pa.array(xs, kind), pa.array(cs, kind)], ["y", "x", "c"])

    data = sample.mapInArrow(rows, "y int, x array<int>, c array<int>").toArrow()
    w, bias = train_weights(data.column("x").to_pylist(), np.array(data.column("y").to_pylist(), float), data.column("c").to_pylist(), len(names), counts[1] / (counts[0] + counts[1]), counterfactual, l2, steps)
    return Model({f: float(v) for f, v in zip(names, w, strict=True)}, bias)


class _Rows:
    """0/1 rows as index lists."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def train_weights(xs: list[list[int]], y: np.ndarray, cs: list[list[int] | None], width: int, share: float, counterfactual: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept: weighted log-loss + l2 + counterfactual * mean squared change of the log-odds, by Adam."""
    x, has = _Rows(xs, width), [i for i, c in enumerate(cs) if c is not None]
    one, other = _Rows([xs[i] for i in has], width), _Rows([cs[i] for i in has], width)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    w, bias = np.zeros(width), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30)))
        g = (p - y) * weight
        grad, gb = x.t_dot(g) + l2 * w, float(g.sum())
        if has:
            change = (one.dot(w) - other.dot(w)) * (2 * counterfactual / len(has))
            grad += one.t_dot(change) - other.t_dot(change)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**k) * np.sqrt(1 - 0.999**k)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def score(df: DataFrame, model: Model, text: str = "text", out_col: str = "toxicity", max_words: int = 150_000) -> DataFrame:
    """df with out_col (in place of any such column), the probability of label 1. max_words: distinct words that a worker remembers."""
    weights, bias = model.weights, model.bias
    names = list(weights)
    index, value = {f: i for i, f in enumerate(names)}, [weights[f] for f in names]
    kept = [c for c in df.columns if c != out_col]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = {f.rstrip("*") for f in names if f.endswith("*")}  # \w+ has no *

        class Known(dict):
            """Of a word, what of it takes part in features: the word itself and beginnings."""

            def __missing__(self, w: str) -> tuple[str, ...] | None:
                if len(self) >= max_words:
                    self.clear()
                found = [*([w + "\n"] if w in index else []), *[w[:n] for n in BEGINNINGS if len(w) > n and w[:n] in begun]]
                self[w] = out = tuple(found) or None
                return out

        known = Known()
        for part, texts in chunks(batches, f"c{at}", 1_000_000):
            scores = []
            for t in texts:
                shared = Counter(f for w in set(_WORD.findall(t.lower())) if (found := known[w]) for f in found)
                hits = [index.get(f[:-1] if f[-1] == "\n" else f + "*" * k) for f, c in shared.items() for k in range(1, 1 + (1 if f[-1] == "\n" else min(c, 3)))]
                scores.append(bias + sum(value[i] for i in sorted(i for i in hits if i is not None)))
            p = 1 / (1 + np.exp(-np.clip(np.array(scores), -500, 500)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*part.schema.names, "score"])

    schema = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields)], "score double"])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("score").alias(out_col))
