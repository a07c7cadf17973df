"""CSV sinks (S5-S7): distributed part files with a header, UTF-8.

Quotes are doubled, blanks and line breaks stay, and a quoted empty cell is an
empty text while an unquoted one is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Stands for a quoted empty cell between the reader and :func:`read_csv`.
_EMPTY = "\u0001empty\u0001"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).options(**OPTIONS, encoding="UTF-8", emptyValue='""').csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    df = spark.read.options(**OPTIONS, multiLine="true", emptyValue=_EMPTY).schema(schema).csv(path)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)) for c in texts}) if texts else df


def plan_file_stem(week_label: str) -> str:
    """File stem of a weekly plan export: one folder name without blanks or slashes."""
    return "collection_plan_" + week_label.replace(" ", "_").replace("/", "-")
