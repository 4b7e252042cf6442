"""From documents to packed token sequences: toxicity, quality rules, near duplicates, secrets, packing.

Each stage takes the documents that the one before kept, whole, and returns documents with the same columns; the last returns packed pieces. Null ids and empty
texts do no harm: what has no ten words fails the quality rules. Decisions are by row: rows that share an id, null ids too, are told apart by their texts; of rows with
equal ids and texts in one group of near duplicates one stays. Columns of any names pass through; an empty table stays empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import jaccard, packing, quality, secrets, toxicity
from prosemill.llm.common import crc_bucket, discard, fresh, materialise, table
from prosemill.llm.queries import tokenizer

#: Bytes of ids or spans up to which a join sends them to all executors; beyond, both sides are shuffled.
BROADCAST_BYTES = 16_000_000


def _sent(df: DataFrame, size: str = "32") -> DataFrame:
    """df, broadcast if its rows are known to be few; size: bytes of a row, an expression."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(size))).first()[0] or 0) <= BROADCAST_BYTES else df


def _with_hash(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the hash of the text by which the operators name a row, and that column."""
    name = fresh(docs, "text_hash")
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("_k"), 5) != 0), fresh(docs, "toxicity")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < 0.5).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the least id (null last): sets of five words, a Jaccard similarity of 0.8 or more."""
    found = jaccard.link(docs.select("doc_id", "text"), n=5, percent=80).where("class is not null")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    found = materialise(found.select("root", row.alias("row")), "near-duplicates")
    first = found.groupBy("root").agg(F.min("row").alias("first"))
    gone = found.join(first, "root").where(F.col("row") != F.col("first"))
    twice = found.groupBy("row").count().where("count > 1")  # equal ids and texts: one of them may stay
    (left, h), of = _with_hash(docs), lambda df: df.select(F.col("row.doc_id").alias("i"), F.col("row.text_hash").alias("h")).distinct()
    same = lambda df: left["doc_id"].eqNullSafe(df["i"]) & (left[h] == df["h"])
    gone = materialise(of(gone), "near-duplicates-gone")
    left = left.join(_sent(gone), same(gone), "left_anti")
    twice = materialise(of(twice), "near-duplicates-twice")
    once = left.join(_sent(twice), same(twice), "left_anti")
    return once.unionByName(left.join(_sent(twice), same(twice), "left_semi").dropDuplicates(["doc_id", h])).drop(h)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets, by rule and by ownership, masked."""
    found = secrets.scan(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    found = found.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), F.concat("base", "owned").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["i", "h"])
    spans = materialise(found, "secret-spans")
    rows, h = _with_hash(docs)
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    col = {c: f"c{i}" for i, c in enumerate([*docs.columns, h])}
    out = rows.join(_sent(spans, "32 + 32 * size(spans)"), rows[col["doc_id"]].eqNullSafe(spans["i"]) & (rows[col[h]] == spans["h"]), "left")
    out = out.withColumn("masked", F.when(F.col("spans").isNotNull(), secrets.masked(F.col(col["text"]), F.col("spans"))))
    new = {"text": F.coalesce("masked", col["text"]), "n_chars": F.coalesce(F.length("masked").cast("long"), col.get("n_chars", "i"))}
    return out.select(*[new.get(c, F.col(col[c])).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, *tokenizer("byte_bpe_50k.json"), end_id=0, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack),
]

#: A trained classifier, components and byte-pair merges have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
