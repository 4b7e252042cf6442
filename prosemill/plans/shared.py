"""Tables of a folder, and tables that are written once for several passes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one, deleted at exit, where all runs on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="prosemill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The rows, written once to the shared folder and reread: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{os.urandom(8).hex()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounded(c: Column | str, name: str | None = None) -> Column:
    """Six decimals by DuckDB's rule, which rounds the product with a million: the shortest decimals of a double can be a half where that product is not, and the reverse."""
    x = F.col(c) if isinstance(c, str) else c
    return (F.round(x * 1e6) / 1e6).alias(name or c)
