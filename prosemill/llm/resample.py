"""Importance resampling towards a target collection by hashed n-grams of words.

Two passes over the texts, both Arrow batches and numpy. The first counts hashed features: np.bincount over each batch adds to one vector of `buckets`
numbers a partition, and treeReduce merges the vectors, so the driver meets a few vectors of fixed length. Smoothed log ratios of target and source
shares are the buckets' gains, floored to thousandths and broadcast (8 bytes a bucket). The second pass gathers the gains of each feature and sums them
by document with the weights of np.bincount. Gumbel noise from the document's id turns the k highest scores into a draw without replacement.

A word's crc32 is taken once for each distinct word of a batch; the crc32 of a run of two follows from those of its words by shift tables, without a string.

The draw is by rank: scores are whole numbers within a bounded range, so counts by score (pre-aggregated) give the lowest score that is drawn; only
documents from there on are sorted, by ranges, and ranked by the counts of the ranges before. No task holds more than its range.

Defined cases: a null text has no words; a text without words has weight 0; a null id counts as an empty string in the noise and comes first among
ties; repeated rows are documents each; extra columns are ignored, whatever their names; an empty table gives an empty result, an empty target no features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes as words hold them: A-Z in lower case, and 0 for all that stands between words.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)
#: Bytes of text that are worked on together; a longer text is taken whole.
SLICE = 4_000_000
_SPACE = zlib.crc32(b" ")


def _shift_tables(most: int = 255) -> np.ndarray:
    """[n][k][b]: what byte k of a crc32, being b, becomes when n zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(most):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> 8)
    return out


_SHIFTS = _shift_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 values as they enter those of longer strings: with n further bytes behind."""
    out, left = crc.copy(), n.copy()
    at = np.arange(len(crc))
    while len(at):
        c, k = out[at], np.minimum(left[at], len(_SHIFTS) - 1)
        out[at] = _SHIFTS[k, 0, c & 255] ^ _SHIFTS[k, 1, (c >> 8) & 255] ^ _SHIFTS[k, 2, (c >> 16) & 255] ^ _SHIFTS[k, 3, c >> 24]
        left[at] -= k
        at = at[left[at] > 0]
    return out


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of texts of about SLICE bytes each; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document number of each run of one or two words."""
    low = _BYTES[data]
    held = low != 0
    new = held.copy()
    new[1:] &= ~held[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    new[firsts] = held[firsts]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append((np.cumsum(held) - 1)[starts], held.sum()).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[held])]).dictionary_encode()
    each, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
    alone = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    after = np.fromiter((zlib.crc32(w, _SPACE) for w in distinct), np.uint32, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    pair = np.flatnonzero(doc[:-1] == doc[1:])
    left, right = each[pair], each[pair + 1]
    crcs = np.concatenate([alone[each], shifted(alone[left], size[right]) ^ after[right]])
    return (crcs % np.uint32(buckets)).astype(np.int64), np.concatenate([doc, doc[pair]])


def counts(df: DataFrame, text: str = "text", buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, offsets in _slices(batch.column(0)):
                total += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = df.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, by bucket."""
    n = len(source)
    s, t, all_s, all_t = source.astype(float), target.astype(float), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n))))


def weigh(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: key, n_features, weight (the floored mean of gains)."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    held = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            at = 0
            for data, offsets in _slices(batch.column(1)):
                n = len(offsets) - 1
                bucket, doc = features(data, offsets, len(gain))
                found = np.bincount(doc, minlength=n)
                total = np.bincount(doc, weights=gain[bucket], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(found), pa.array(total // np.maximum(found, 1))], ["_key", "n_features", "weight"])
                at += n

    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, n_features long, weight long").withColumnRenamed("_key", key)


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 10_000, seed: int = 7, percent: int = 25, least_words: int = 20) -> DataFrame:
    """A row per row of df: key, n_features, weight, score, rank (1, 2, 3 ... of the drawn documents, null for others)."""
    scored = weigh(df, gains(counts(df, text, buckets), counts(target, text, buckets)), key, text).withColumnRenamed(key, "_key")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / F.lit(4294967296.0)
    scored = materialise(scored.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share)))), "resample-scores")
    able = scored.where(F.col("n_features") >= 2 * least_words - 1)
    by_score = sorted(((r["score"], r["count"]) for r in able.groupBy("score").count().collect()), reverse=True)
    draws, above, least = percent * sum(n for _, n in by_score) // 100, 0, None
    for score, n in by_score:
        if above >= draws:
            break
        above, least = above + n, score
    out = lambda rows, rank: rows.select(F.col("_key").alias(key), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if least is None:
        return out(scored, F.lit(None))
    within = F.col("score") >= least
    best = able.where(within).withColumn("_row", F.monotonically_increasing_id())
    best = best.repartitionByRange(F.desc("score"), F.asc("_key"), F.asc("_row")).sortWithinPartitions(F.desc("score"), F.asc("_key"), F.asc("_row"))
    best = materialise(best.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "resample-drawn")
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in best.groupBy("_part").count().collect()):
        before.append((part, total))
        total += n
    ranges = F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before long"))  # a row per partition
    rank = F.col("_before") + (F.col("_row") % F.lit(1 << 33)) + 1  # the lower bits count within a partition
    rest = scored.where(~(within & (F.col("n_features") >= 2 * least_words - 1)))
    return out(best.join(ranges, "_part"), F.when(rank <= draws, rank)).unionByName(out(rest, F.lit(None)))
