"""Tiny constant dimensions (a handful of rows each).  Their size is fixed by
the label sets in :mod:`dunning.functions.labels`, so broadcasting them is
always safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from dunning.functions import labels as L


def literal_frame(spark: SparkSession, rows, schema: StructType) -> DataFrame:
    """A tiny constant table built JVM-side (``inline`` of literal structs):
    no Python RDD, no Python worker, and Catalyst knows it is tiny."""
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def segment_dim(spark: SparkSession) -> DataFrame:
    schema = StructType(
        [
            StructField("segment_rank", IntegerType(), False),
            StructField("risk_segment", StringType(), False),
            StructField("actions", StringType(), False),
            StructField("follow_up", StringType(), False),
        ]
    )
    rows = [(i, seg, act, fu) for i, (seg, act, fu) in enumerate(L.SEGMENT_ACTIONS)]
    return F.broadcast(literal_frame(spark, rows, schema))
