"""Exactly-once ingest of landed statement / payment CSV files.

``readStream`` over the landing folder (fixed all-text schema, no inference)
-> the same cleaning functions as the batch path -> parquet append.  With
``availableNow`` the query processes whatever has landed and stops, so it can
run on a schedule; the checkpoint in the shared folder records which files
were taken, so a rerun or a lost executor never duplicates rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from dunning.sources import ingest as IN

CLEANERS = {"statement": IN.clean_statement, "payments": IN.clean_payments}


def landed_stream(spark: SparkSession, landing_dir: str, columns, kind: str) -> DataFrame:
    """A streaming file source needs its schema up front: landed files must
    carry exactly ``columns``, in that order (the header line is skipped)."""
    raw = spark.readStream.options(**IN.CSV_OPTIONS).schema(IN.text_schema(columns)).csv(landing_dir)
    return CLEANERS[kind](raw)


def ingest_landed(
    spark: SparkSession, landing_dir: str, table_dir: str, checkpoint_dir: str, columns, kind: str = "statement"
) -> int:
    """Append newly landed files to ``table_dir``; returns rows appended (the
    table's rows after less before: progress reports only reach back so far)."""
    before = _rows(spark, table_dir)
    query = (
        landed_stream(spark, landing_dir, columns, kind)
        .writeStream.format("parquet")
        .option("path", table_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _rows(spark, table_dir) - before


def _rows(spark: SparkSession, table_dir: str) -> int:
    try:
        return spark.read.parquet(table_dir).count()
    except AnalysisException:  # not there yet
        return 0
