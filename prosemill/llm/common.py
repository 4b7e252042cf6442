"""What several operators share: the shared folder, tables, words, and text chunks from Arrow batches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a character class of Java's and Python's regular expressions.
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: Characters of text that a Python worker holds as one unit of work.
CHUNK_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a new temporary one if all runs on this machine, else an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="prosemill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and a lost executor loses no part of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for these tables; nothing that is still to run may read them."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has such a column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that a row belongs to."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: bytes.lower() and bytes.split() know ASCII letters and ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about `most` characters of text each, and their texts (null: empty)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        at, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= most:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, held = i + 1, 0
        if at < len(texts):
            yield batch.slice(at), texts[at:]
