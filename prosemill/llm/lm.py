"""Log-bilinear language model trained with noise-contrastive estimation.

Symbols are the `head` most frequent tokens (the end of a text among them) and `classes` classes of all other tokens, by their first and last two bytes. A
context is the token before, as one of `contexts` (frequent tokens by themselves, others by class); what comes before a text is an end. The model is
s(w | h) = r_h . q_w + b_w. How fine these are follows the training tokens: the head is a power of 2 near the root of their number, so the pairs that are told apart
grow in proportion to the input (up to MAX_HEAD, which bounds a worker's memory). The counts of (context, symbol) over all training texts, which Spark sums, are written to the shared folder. The objective is the
expected NCE objective with k noise samples a token from the symbols' shares. Each step of full-batch Adam is one job: tasks hold a part of the pairs, form the scores of its
contexts by batched matrix products and send the sums of their gradients; the driver holds parameters alone. One more product gives each context's normaliser, so
probabilities sum to one. A token of a class has the class's probability times its own share in the class
by training counts, with 0.1 added to each count and one place for tokens never seen.

Counts of tokens cover all training texts. The `known` most frequent go to the workers; what a text has beyond them is joined by hash, so no table that grows with
the vocabulary is broadcast. Three passes over the texts; only counts, rare tokens' hashes and sums per text are shuffled.

Defined cases: a null or empty text is one end; a text of repeated rows is scored each time; ties in frequency go to the smaller token; without training texts all
counts are 0, the base is log10 of 1/(V+1) with V = 0 and the model is uniform over its symbols; other columns are ignored."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialise, words_of

#: The end of a text, as a token: no word is empty.
END = b""
#: The largest head, and the tasks of a training step.
MAX_HEAD, TASKS = 1 << 17, 8
#: Scores that a task or the driver holds at a time, and characters of text that a task works on.
CELLS, CHUNK = 1 << 21, 1_000_000


@dataclass
class Model:
    head: list[bytes]
    classes: int
    contexts: int
    r: np.ndarray  # contexts x d
    q: np.ndarray  # symbols x d
    b: np.ndarray
    total: int = 0  # training tokens
    distinct: int = 0
    class_total: np.ndarray | None = None
    class_distinct: np.ndarray | None = None
    known: list[tuple[bytes, int]] = field(default_factory=list)

    @property
    def symbols(self) -> int:
        return len(self.head) + self.classes

    def scores(self, contexts: slice) -> np.ndarray:
        """Scores of all symbols after some contexts, from one matrix product."""
        return self.r[contexts] @ self.q.T + self.b

    def normalisers(self) -> np.ndarray:
        """Natural log of the sum of exponentials of each context's scores."""
        out, step = np.zeros(len(self.r), np.float32), max(1, CELLS // self.symbols)
        for i in range(0, len(out), step):
            s = self.scores(slice(i, i + step))
            top = s.max(1)
            out[i : i + step] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out

    def log_probs(self) -> np.ndarray:
        """Natural log-probabilities, contexts x symbols."""
        return self.scores(slice(None)) - self.normalisers()[:, None]


def head_for(total: int) -> int:
    """The head for so many training tokens: a power of 2 near the root of their number."""
    return min(MAX_HEAD, 1 << max(6, round(math.log2(max(1, total)) / 2)))


def token_class(w: bytes, classes: int) -> int:
    return zlib.crc32(w[:2] + b" " + w[-2:]) % classes


class Index:
    """Symbol and context of tokens, remembered for the distinct tokens of a worker; row 0 is the end."""

    def __init__(self, head: list[bytes], classes: int, contexts: int, known: list[tuple[bytes, int]] | None = None, most: int = 400_000):
        self.head, self.classes, self.own, self.most = {w: i for i, w in enumerate(head)}, classes, contexts // 2, most
        self.rest, self.known = contexts - contexts // 2, None if known is None else dict(known)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.symbol, self.context, self.count, self.hash = (np.zeros(1 << 16, t) for t in (np.int32, np.int32, np.int64, np.int64))
        self._add([END])

    def _add(self, words: list[bytes]) -> None:
        n, k = len(self.at), len(words)
        while n + k > len(self.symbol):
            self.symbol, self.context, self.count, self.hash = (np.resize(x, 2 * len(x)) for x in (self.symbol, self.context, self.count, self.hash))
        klass = np.array([zlib.crc32(w[:2] + b" " + w[-2:]) for w in words], np.int64) % self.classes
        rank = np.fromiter(map(self.head.get, words, repeat(-1)), np.int64, k)
        self.symbol[n : n + k] = np.where(rank >= 0, rank, len(self.head) + klass)
        self.context[n : n + k] = np.where((rank >= 0) & (rank < self.own), rank, self.own + klass % self.rest)
        if self.known is not None:  # counts and hashes are for scores alone
            self.count[n : n + k] = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, k)
            self.hash[n : n + k] = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, k).view(np.int64)
        self.at.update(zip(words, range(n, n + k), strict=True))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the texts' tokens, each text with its end, and the number of tokens of each."""
        found = [words_of(t) for t in texts]
        lens = np.fromiter((len(f) + 1 for f in found), np.int64, len(found))
        words = list(chain.from_iterable(found))
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new = {words[i] for i in miss.tolist()}
            if len(self.at) + len(new) > self.most:
                self._clear()
                new, miss = set(words), np.arange(len(words))
            self._add(list(new))
            at[miss] = np.fromiter((self.at[words[i]] for i in miss.tolist()), np.int64, len(miss))
        out, inside = np.zeros(int(lens.sum()), np.int64), np.ones(int(lens.sum()), bool)
        inside[np.cumsum(lens) - 1] = False
        out[inside] = at
        return out, lens

    def pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and symbols of the tokens."""
        symbol, context = self.symbol[rows], self.context[rows]
        return np.concatenate([self.context[:1], context[:-1]]), symbol


def _token_counts(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """w binary, c long: partial sums of tasks, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "c"])
        for _, texts in chunks(batches, "t", CHUNK):
            for t in texts:
                held.update(words_of(t))
            held[END] += len(texts)
            if len(held) > most:
                yield out()
                held.clear()
        yield out()

    return rows.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _pair_counts(rows: DataFrame, head: list[bytes], classes: int, contexts: int, most: int = 1_000_000) -> DataFrame:
    """context, symbol and the number of their tokens, over all rows."""
    symbols = len(head) + classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, size = Index(head, classes, contexts), [], 0

        def out() -> pa.RecordBatch:
            cells, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([n for _, n in held]), len(cells)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((cells // symbols).astype(np.int32)), pa.array((cells % symbols).astype(np.int32)), pa.array(counts)], ["context", "symbol", "n"])

        for _, texts in chunks(batches, "t", CHUNK):
            context, symbol = index.pairs(index.rows(texts)[0])
            held.append(np.unique(context.astype(np.int64) * symbols + symbol, return_counts=True))
            size += len(held[-1][0])
            if size > most:
                yield out()
                size = 0
        if held:
            yield out()

    return rows.mapInArrow(run, "context int, symbol int, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def gradient(context: np.ndarray, symbol: np.ndarray, n: np.ndarray, params: tuple[np.ndarray, np.ndarray, np.ndarray], noise: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and the gradients of r (of these contexts), q and b by distinct pairs ordered by context, as sums over tokens: log s(D) over data and k expected noise samples log s(-D), D = score - log(k * noise share)."""
    r, q, b = params
    shift = b - np.log(k * noise).astype(np.float32)
    held, row = np.unique(context, return_inverse=True)
    expected = (k * noise).astype(np.float32)
    gr, gq, gb = np.zeros((len(held), r.shape[1]), np.float32), np.zeros_like(q), np.zeros_like(b)
    step = max(1, CELLS // len(q))
    for i in range(0, len(held), step):
        one = r[held[i : i + step]]
        x, y = np.searchsorted(row, [i, i + len(one)])
        at, c = (row[x:y] - i, symbol[x:y]), n[x:y]
        g = one @ q.T  # to be the probabilities that a pair is data, in place
        g += shift
        np.clip(g, -30, 30, out=g)
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        true = (1 - g[at]) * c
        g *= np.bincount(at[0], c, len(one)).astype(np.float32)[:, None]
        g *= expected
        g[at] -= true
        gr[i : i + step] = g @ q
        gq += g.T @ one
        gb += g.sum(0)
    return held, gr, gq, gb


def packed(pairs: DataFrame, most: int = 1 << 18) -> DataFrame:
    """Distinct pairs as rows of up to `most`, ordered by context: three columns of little-endian 32-bit numbers. A training step reads them without a row for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            kinds = ("<i4", "<i4", "<f4")
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).astype(k).tobytes()], pa.binary()) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["context", "symbol", "n"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= most:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    dealt = pairs.repartition(TASKS, "context").sortWithinPartitions("context").select("context", "symbol", "n")
    return dealt.mapInArrow(run, "context binary, symbol binary, n binary")


def train(pairs: DataFrame, own: np.ndarray, contexts: int, symbols: int, d: int, k: int, steps: int, rate: float, prior: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, q, b from packed pairs, by Adam over the means of their gradients. own: tokens of each symbol. prior: a Gaussian prior on r and q, in tokens: it fades as the input grows."""
    rng = np.random.default_rng(seed)
    total = max(1.0, own.sum())
    noise = (own + 1.0) / (own.sum() + symbols)
    params = [rng.normal(0, 0.1, (contexts, d)).astype(np.float32), rng.normal(0, 0.1, (symbols, d)).astype(np.float32), np.log(noise).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    context = pairs.sparkSession.sparkContext
    for i in range(1, steps + 1):
        shared = context.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r, q, b = shared.value  # noqa: B023
            gr, gq, gb, seen = np.zeros_like(r), np.zeros_like(q), np.zeros_like(b), np.zeros(len(r), bool)
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    held, *found = gradient(*(np.frombuffer(x, t) for x, t in zip(row, ("<i4", "<i4", "<f4"), strict=True)), (r, q, b), noise, k)
                    gr[held] += found[0]
                    gq += found[1]
                    gb += found[2]
                    seen[held] = True
            if seen.any():
                held = np.flatnonzero(seen).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (held, gr[held], gq, gb)], ["held", "r", "q", "b"])

        grads = [np.float32(prior / total) * params[0], np.float32(prior / total) * params[1], np.zeros_like(params[2])]
        for x in pairs.mapInArrow(run, "held binary, r binary, q binary, b binary").toLocalIterator():
            rows = np.frombuffer(x["held"], np.int32)
            grads[0][rows] += np.frombuffer(x["r"], np.float32).reshape(len(rows), d) / np.float32(total)
            grads[1] += np.frombuffer(x["q"], np.float32).reshape(symbols, d) / np.float32(total)
            grads[2] += np.frombuffer(x["b"], np.float32) / np.float32(total)
        step = rate * (1 - (i - 1) / steps)
        new = []
        for x, grad, (m, v) in zip(params, grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.98
            v += 0.02 * grad * grad
            new.append(x - step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.98**i)) + 1e-9))
        params = [x.astype(np.float32) for x in new]
        shared.destroy()
    return params[0], params[1], params[2]


def fit(df: DataFrame, train_rows: Column, text: str = "text", head: int | None = None, classes: int | None = None, contexts: int | None = None, known: int = 120_000, d: int = 24, k: int = 50, steps: int = 24, rate: float = 0.25, prior: float = 8.0) -> tuple[Model, DataFrame]:
    """The model and the counts of its training tokens beyond the known ones (hash, c). head, classes, contexts: by the number of training tokens if not given."""
    rows = df.where(train_rows).select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    counts = materialise(_token_counts(rows), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = head or head_for(total)
    classes, contexts = classes or head // 2, contexts or head // 2
    known = max(known, head)
    top = [(bytes(r["w"]), r["c"]) for r in counts.orderBy(F.col("c").desc(), "w").limit(known).collect()]
    first = [END, *[w for w, _ in top if w != END][: head - 1]]
    w = F.col("w")
    klass = F.pmod(F.crc32(F.concat(F.substring(w, 1, 2), F.lit(b" "), F.when(F.length(w) > 2, F.expr("substring(w, -2, 2)")).otherwise(w))), F.lit(classes)).cast("int")
    per = counts.groupBy(klass.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_total, class_distinct, of = np.zeros(classes, np.int64), np.zeros(classes, np.int64), dict(top)
    for r in per:
        class_total[r["k"]], class_distinct[r["k"]] = r["c"], r["n"]
    for x in first:
        if x in of:
            class_total[token_class(x, classes)] -= of[x]
            class_distinct[token_class(x, classes)] -= 1
    pairs = materialise(_pair_counts(rows, first, classes, contexts), "lm-pairs")
    own = np.zeros(len(first) + classes)
    for x in pairs.groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # a number for each symbol
        own[x["symbol"]] = x["n"]
    parts = materialise(packed(pairs), "lm-packed")
    r, q, b = train(parts, own, contexts, len(first) + classes, d, k, steps, rate, prior)
    discard(pairs, parts)
    model = Model(first, classes, contexts, r, q, b, total, distinct, class_total, class_distinct, top)
    known_words = F.broadcast(df.sparkSession.createDataFrame([(x,) for x, _ in top], "w binary"))
    rare = counts.join(known_words, "w", "left_anti").select(F.xxhash64("w").alias("hash"), "c").groupBy("hash").agg(F.max("c").alias("c"))
    return model, rare


def score(df: DataFrame, model: Model, rare: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: key, row_id, n_tokens, n_known, base_score, score (log10)."""
    spread = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = spread.schema["_k"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    normalisers = model.normalisers()
    cache: dict[int, tuple] = {}

    def prepared() -> tuple[Index, Model, np.ndarray, np.ndarray, float]:
        if 0 not in cache:
            m = shared.value
            # natural log of a class's denominator; 0 for the head, whose symbols are tokens
            lower = np.concatenate([np.zeros(len(m.head)), np.log(m.class_total + 0.1 * (m.class_distinct + 1))])
            cache[0] = Index(m.head, m.classes, m.contexts, m.known), m, normalisers, lower, float(np.log(m.total + 0.1 * (m.distinct + 1)))
        return cache[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, m, norm, lower, base_lower = prepared()
        part, row, n_head = TaskContext.get().partitionId(), 0, len(shared.value.head)
        for held, texts in chunks(batches, "t", CHUNK):
            rows, lens = index.rows(texts)
            context, symbol = index.pairs(rows)
            count, in_class = index.count[rows], symbol >= n_head
            upper = np.log(np.maximum(count, 0) + 0.1)
            known = count >= 0
            base = np.where(known, upper, 0.0) - base_lower
            own = np.einsum("ij,ij->i", m.r[context], m.q[symbol]) + m.b[symbol] - norm[context] - lower[symbol] + np.where(known & in_class, upper, 0.0)
            ends = np.cumsum(lens)
            sums = lambda x: np.add.reduceat(x, ends - lens)
            beyond = np.flatnonzero(~known)
            doc = np.searchsorted(ends, beyond, "right")
            order = np.lexsort((index.hash[rows[beyond]], doc))
            doc, hashes = doc[order], index.hash[rows[beyond]][order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])) if len(doc) else np.zeros(0, np.int64)
            times = np.diff(new, append=len(doc))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    held.column(0), pa.array((np.int64(part) << 33) + row + np.arange(len(texts))), pa.array(lens), pa.array(sums((count > 0).astype(np.int64))), pa.array(sums(base) / np.log(10)), pa.array(sums(own) / np.log(10)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[new])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32))),
                ],
                ["_k", "row_id", "n_tokens", "n_known", "base", "own", "hashes", "times"],
            )
            row += len(texts)

    found = materialise(spread.mapInArrow(run, f"_k {kind}, row_id long, n_tokens long, n_known long, base double, own double, hashes array<long>, times array<int>"), "lm-texts")
    tail = found.select("row_id", F.explode(F.arrays_zip("hashes", "times")).alias("x")).select("row_id", F.col("x.hashes").alias("hash"), F.col("x.times").alias("times"))
    seen = F.coalesce(F.col("c"), F.lit(0))
    more = tail.join(rare, "hash", "left").groupBy("row_id").agg(F.sum(F.col("times") * F.log10(seen + 0.1)).alias("more"), F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"))
    plus = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.join(more, "row_id", "left").select(F.col("_k").alias(key), "row_id", "n_tokens", (F.col("n_known") + plus("more_known")).alias("n_known"), (F.col("base") + plus("more")).alias("base_score"), (F.col("own") + plus("more")).alias("score"))
