"""Incremental ingestion: new files only, each row once, the last version of an id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Appends all files under source that no earlier call has read to the Parquet table at target, with the batch's number; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch_id={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compacted(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return log.withColumn("_last", last).where("_last = 1").drop("_last")
