"""Spark sessions for local use."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tessera", memory: str = "8g") -> SparkSession:
    n = cores if isinstance(cores, int) else 8
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoints(spark: SparkSession) -> None:
    """A folder for checkpoint() where a local session has none, as in tests; a cluster's must be named."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; it is not set on {master}")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df from the folder that all executors share: lost executors cost no more than the tasks that they ran."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()
