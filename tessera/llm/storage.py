"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With it, a step's shuffle files go when its result is written, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only on a local master that has none set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; it is not set on {master}")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that it ran, not the whole plan before the table. Shuffle files of the
    step go once it is written; discard() removes the table when nothing reads it any more, and the cluster's cleaning of
    spark.checkpoint.dir removes what a result still reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    with _setting(spark, _CLEANUP, "true"):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that materialize() made and that no plan still to run reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_frequent(left: DataFrame, right: DataFrame, key: str, weight: str, share: int = 10_000) -> DataFrame:
    """left joined with right by key, whatever share of left's rows a key has; both must be read from tables, left twice.

    right has one row per key, with the number of left's rows that have it, or more, in column weight. Keys with more than 1 / share
    of all weight are fewer than share, at every size: these are broadcast. Of the others, which are shuffled, none is a heavy one.
    """
    heavy = F.col(weight) * share > (right.agg(F.sum(weight)).first()[0] or 0)
    few = right.where(heavy)
    rest = left.join(F.broadcast(few.select(key)), key, "left_anti")
    return left.join(F.broadcast(few), key).unionByName(rest.join(right.where(~heavy), key))


def bound_batches(spark: SparkSession, rows: int = 1024, size: str = "8m") -> None:
    """Lowers the session's limits on Arrow batches, which count rows first and would hold ten thousand whole texts.

    The limits stay lowered, as the plans that operators return run later under them. Limits that are lower already stay.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
