"""Shared helpers of the training-data operators: inputs, the shared scratch folder, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in most contracts: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text that cross to Python at once, at most.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, a session that runs on this machine alone gets a temporary folder; on a cluster that is an error, since no executor could read what another writes.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lodestar/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives the loss of executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch, so that a batch of long texts fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_of(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(id, text, ...) only, so that no other column can clash; a null text is empty."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col), *more)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1 and so on, and the new name of each; so columns of any names stand beside an operator's own, which start with an underscore."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def by_bytes(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about `most` bytes; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def release(keep_words: bool = False) -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers stay while other stages run. Words that the tokenizer operators keep go too, unless the task is one of theirs."""
    import ctypes
    import sys

    import pyarrow as pa

    from . import wordhash

    wordhash.forget()
    for module, kept in (("lexicon", "Lexicon"), ("transducer", "Transducer")):
        if not keep_words and (m := sys.modules.get(f"{__package__}.{module}")):
            getattr(m, kept)._open.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def thrifty(run, keep_words: bool = False):
    """run(batches), a generator, with release() at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release(keep_words)

    return wrapped


def thrifty_group(run):
    """run(group) with release() after it."""

    def wrapped(group):
        try:
            return run(group)
        finally:
            release()

    return wrapped
