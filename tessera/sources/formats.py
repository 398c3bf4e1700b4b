"""Registers the library's data sources with a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.sources.matfile import MatSource
from tessera.sources.workbook import WorkbookSource


def register_formats(spark: SparkSession) -> None:
    """Makes `workbook` and `matfile` known to spark.read.format, and lets sources take filters, as workbooks do."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WorkbookSource, MatSource):
        spark.dataSource.register(source)
