"""Shared storage between stages, and keys for rows.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which all executors share, so a
lost executor costs no recomputation of what has been staged.  Where the setting is unset (tests on
one machine) a temporary folder is set once for the session; a cluster without the setting is refused.

What a staged table was shuffled from is deleted as soon as it is written, and a staged table that has been
used up can be `discard`ed, so the disk in use is that of one step.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, as a URI or path."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that this process made; after the session has ended, only one on this machine."""
    context = spark.sparkContext
    if context._jsc is None or context._jvm is None:
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before this
        remove(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of each run are removed when it has ended: for runs that write a table."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> Iterator[None]:
    """Within this, Python workers get at most so many rows and about so many bytes at once: whole texts and packed rows in batches of 10,000 take memory on both sides."""
    before = spark.conf.get(_BATCH), spark.conf.get(_BYTES, None)
    spark.conf.set(_BATCH, str(min(rows, int(before[0])) if int(before[0]) > 0 else rows))
    spark.conf.set(_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before[0])
        spark.conf.unset(_BYTES) if before[1] is None else spark.conf.set(_BYTES, before[1])


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write the rows to the shared folder as Parquet (in folders by a column) and read them back: lineage is cut there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_freed(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        if getattr(table, "_staged_at", None):
            remove(table.sparkSession, table._staged_at)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has, in either case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of(doc_id: Column) -> Column:
    """CRC-32 of a document id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def documents_of(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text, whatever other columns the table has."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c] for c in extra])
