"""Sharding: the law of bytes, gapless slots, whole rows, and equal texts kept together."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from prosemill.llm import sharding


def checked(df, shards):
    """Rows by shard, after what holds for any table."""
    rows, found = sharding.shard(df, shards).collect(), defaultdict(list)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for r in rows:
        found[r.shard].append(r)
    for s, rs in found.items():
        assert 0 <= s < shards and sorted(r.slot for r in rs) == list(range(len(rs)))
    return found


def spread(found, shards):
    return [sum(r.size for r in found.get(s, [])) for s in range(shards)]


def test_table_by_bytes(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = checked(df, 40)
    sizes = spread(found, 40)
    assert max(sizes) <= 1.1 * sum(sizes) / 40
    where = defaultdict(set)
    for s, rs in found.items():
        for r in rs:
            where[r.text_crc32, r.size].add(s)
    assert sum(len(s) > 1 for s in where.values()) <= 0.01 * len(where)


def test_hot_groups_are_cut_by_row(spark):
    rows = [(7, "the same text of some length", "en", "s")] * 400 + [(i, f"own text number {i}", "en", "s") for i in range(100, 900)]
    sizes = spread(checked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8), 8)
    assert max(sizes) <= 1.15 * sum(sizes) / 8 and min(sizes) >= 0.85 * sum(sizes) / 8


def test_odd_rows(spark, docs):
    found = checked(docs.withColumns({"shard": F.lit("x"), "slot": F.lit(1), "size": F.lit(2), "b": F.lit(3)}), 5)
    assert sum(map(len, found.values())) == docs.count()
    none = docs.limit(0)
    assert sharding.shard(none, 4).count() == 0
    few = spark.createDataFrame([(None, None, None, None), (None, "", None, None), (1, None, "en", "s")], "doc_id long, text string, lang string, source string")
    assert sum(len(rs) for rs in checked(few, 40).values()) == 3
