"""Continuous ingest: files of documents arrive, chunks of the newest versions are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

#: What arriving files hold; of a batch's rows with one doc_id, that with the largest version (then text) counts.
SCHEMA = "doc_id long, version long, text string"


def newest(df: DataFrame) -> DataFrame:
    """(doc_id, version, text): one row for each doc_id; aggregated before the shuffle."""
    return df.groupBy("doc_id").agg(F.max(F.struct("version", "text")).alias("x")).select("doc_id", "x.version", "x.text")


def ingest(spark: SparkSession, arrivals: str, table: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Starts a query that cuts all files in `arrivals` not seen yet into chunks, and ends when it has them.

    A batch writes its own two folders of `table` (versions and chunks) and overwrites them when it is run again after a failure, so nothing is doubled or lost. Folders must be shared by all executors. A text that is null or blank has a version but no chunks, so it takes the place of an older text.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rows = newest(batch)
        chunker(rows).join(rows.select("doc_id", "version"), "doc_id").write.mode("overwrite").parquet(f"{table}/chunks/batch={number}")
        rows.select("doc_id", "version").write.mode("overwrite").parquet(f"{table}/versions/batch={number}")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """Chunks of each document's largest version, the later batch's if two have it; None before the first batch."""
    try:
        versions = spark.read.parquet(f"{table}/versions")
    except AnalysisException:
        return None
    last = versions.groupBy("doc_id").agg(F.max(F.struct("version", "batch")).alias("x")).select("doc_id", "x.version", "x.batch")
    return spark.read.parquet(f"{table}/chunks").join(last, ["doc_id", "version", "batch"], "left_semi").drop("batch")
