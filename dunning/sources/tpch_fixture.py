"""Derive the two receivables tables from the TPC-H style test tables.

The column expressions are plain SQL accepted by both Spark and DuckDB
(FIXTURES.md), so the oracle reuses the very same text; Spark evaluates them
with ``selectExpr`` on top of ordinary DataFrame joins.  The one function the
engines spell differently, days between two dates, is a parameter.

* ``statement``: every open order (status O or P), one row per invoice.
* ``payments``: every line item, one row per payment line.

The source dates span years.  They are *folded* into the last 240 (invoices)
and 215 (payments) days, so that no row is left out and all aging classes,
weeks and months occur.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.functions import labels as L
from dunning.params import ReportParams

# Fixed values (FIXTURES.md): the reporting day and weeks of the derived tables.
AS_OF = dt.date(2001, 8, 2)
WEEK_START = dt.date(2001, 7, 30)
FUTURE_WEEK_START = dt.date(2001, 8, 6)
#: A day on which no invoice of the derived statement is over 60 days late.
ONE_CLASS_AS_OF = dt.date(2001, 2, 1)

#: Deterministic reports on the derived tables score by the rules.
PARAMS = ReportParams(as_of=AS_OF, week_start=WEEK_START, score_mode="rules")

#: What the two reports that show a filter ask for.
FILTERED = ReportParams(
    as_of=AS_OF,
    week_start=WEEK_START,
    score_mode="rules",
    filter_start=dt.date(2001, 3, 1),
    filter_end=dt.date(2001, 6, 30),
    filter_statuses=(L.STATUS_EARLY, L.STATUS_MODERATE, L.STATUS_HIGH),
    limit_segments=(L.SEGMENT_LOW, L.SEGMENT_EXTREME),
    limit_low=2_000.0,
    limit_high=400_000.0,
)


def _folded(last: str, days: int, column: str, between: Callable[[str, str], str]) -> str:
    """``column`` moved by whole multiples of ``days`` into the ``days`` up to ``last``."""
    return f"DATE '{last}' - CAST({between(f"DATE '{last}'", f'CAST({column} AS DATE)')} % {days} AS INT)"


def spark_days(later: str, earlier: str) -> str:
    return f"datediff({later}, {earlier})"


def duckdb_days(later: str, earlier: str) -> str:
    return f"datediff('day', {earlier}, {later})"


def statement_columns(between: Callable[[str, str], str] = spark_days) -> list[str]:
    date = _folded("2001-08-01", 240, "o.o_orderdate", between)
    return [c.replace("<invoice date>", date) for c in _STATEMENT_COLUMNS]


def payments_columns(between: Callable[[str, str], str] = spark_days) -> list[str]:
    date = _folded("2001-11-04", 215, "l.l_shipdate", between)
    return [c.replace("<payment date>", date) for c in _PAYMENTS_COLUMNS]


_STATEMENT_COLUMNS = [
    "c.c_custkey AS customer_code",
    "c.c_name AS customer_name",
    "CAST(o.o_orderkey AS STRING) AS document_no",
    "<invoice date> AS invoice_date",
    "CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE <invoice date> + "
    "CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 15 WHEN '2' THEN 30 WHEN '3' THEN 45 "
    "WHEN '4' THEN 60 ELSE 90 END END AS due_date",
    "o.o_totalprice AS initial_amount",
    "CASE o.o_orderstatus WHEN 'O' THEN o.o_totalprice ELSE floor(CAST(CAST(CAST(o.o_totalprice "
    "AS DECIMAL(18,2)) * 100 AS BIGINT) AS DOUBLE) / 2) / 100 END AS balance",
]

_NET_CENTS = (
    "CAST(CAST(CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) "
    "AS DECIMAL(18,2)) * 100 AS BIGINT) AS DOUBLE)"
)

_PAYMENTS_COLUMNS = [
    "o.o_custkey AS customer_code",
    "c.c_name AS customer_name",
    "CAST(l.l_orderkey AS STRING) AS document_no",
    "l.l_linenumber AS line_no",
    "<payment date> AS payment_date",
    f"CASE WHEN l.l_orderkey % 59 = 0 THEN NULL ELSE {_NET_CENTS} / 100 END AS paid_amount",
    f"CASE WHEN l.l_linenumber IN (1, 2) THEN {_NET_CENTS} / 100 WHEN l.l_linenumber = 7 "
    f"THEN floor({_NET_CENTS} / 2) / 100 ELSE CAST(0 AS DOUBLE) END AS cash",
    f"CASE WHEN l.l_linenumber = 3 THEN {_NET_CENTS} / 100 ELSE CAST(0 AS DOUBLE) END AS cheque",
    f"CASE WHEN l.l_linenumber IN (4, 5) THEN {_NET_CENTS} / 100 ELSE CAST(0 AS DOUBLE) END AS card",
    f"CASE WHEN l.l_linenumber = 6 THEN {_NET_CENTS} / 100 WHEN l.l_linenumber = 7 "
    f"THEN ({_NET_CENTS} - floor({_NET_CENTS} / 2)) / 100 ELSE CAST(0 AS DOUBLE) END AS transfer",
]


def _comma_text(cents: str) -> str:
    """Text ``12,345.67`` from integer cents (FIXTURES.md section 3)."""
    w = f"CAST(floor({cents} / CAST(100 AS DOUBLE)) AS BIGINT)"
    whole = (
        f"CASE WHEN {w} >= 1000 THEN concat(CAST(CAST(floor({w} / CAST(1000 AS DOUBLE)) AS BIGINT) AS STRING), "
        f"',', lpad(CAST({w} % 1000 AS STRING), 3, '0')) ELSE CAST({w} AS STRING) END"
    )
    return f"concat({whole}, '.', lpad(CAST({cents} % 100 AS STRING), 2, '0'))"


def _cents(col: str) -> str:
    return f"CAST(CAST({col} AS DECIMAL(18,2)) * 100 AS BIGINT)"


# statement_raw: every column as text, with dirty dates and amounts.
STATEMENT_RAW_COLUMNS = [
    "CAST(customer_code AS STRING) AS customer_code",
    "customer_name",
    "document_no",
    "CASE WHEN CAST(document_no AS BIGINT) % 43 = 0 THEN 'bad-date' ELSE CAST(invoice_date AS STRING) END AS invoice_date",
    "CAST(due_date AS STRING) AS due_date",
    f"{_comma_text(_cents('initial_amount'))} AS initial_amount",
    "CASE WHEN CAST(document_no AS BIGINT) % 41 = 0 THEN 'N/A' WHEN CAST(document_no AS BIGINT) % 47 = 0 THEN 'nan' "
    f"ELSE {_comma_text(_cents('balance'))} END AS balance",
]

# payments_raw: our text image of payments (documented in FIXTURES.md section 3b).
PAYMENTS_RAW_COLUMNS = [
    "CAST(customer_code AS STRING) AS customer_code",
    "customer_name",
    "document_no",
    "CAST(line_no AS STRING) AS line_no",
    "CASE WHEN CAST(document_no AS BIGINT) % 67 = 0 THEN 'bad-date' ELSE CAST(payment_date AS STRING) END AS payment_date",
    f"CASE WHEN paid_amount IS NULL THEN 'nan' WHEN CAST(document_no AS BIGINT) % 71 = 0 THEN 'N/A' "
    f"ELSE {_comma_text(_cents('paid_amount'))} END AS paid_amount",
    f"{_comma_text(_cents('cash'))} AS cash",
    f"{_comma_text(_cents('cheque'))} AS cheque",
    f"CASE WHEN CAST(document_no AS BIGINT) % 73 = 0 THEN '-' ELSE {_comma_text(_cents('card'))} END AS card",
    f"{_comma_text(_cents('transfer'))} AS transfer",
]


_READERS: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table reader, reused within one live session so the footer /
    schema read happens once per table rather than once per report.  Keyed by
    the application id and checked against the session object, so a stopped
    and recreated session never gets a reader bound to a dead context."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (spark.sparkContext.applicationId, path)
    hit = _READERS.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, spark.read.parquet(path))
        _READERS[key] = hit
    return hit[1]


def _shared(df: DataFrame, columns: list[str], parts: dict[str, str]) -> DataFrame:
    """``df`` with ``columns``, where what each of ``parts`` says is evaluated
    once for a row and not wherever it stands in them."""
    for name, text in parts.items():
        df = df.withColumn(name, F.expr(text))
        columns = [c.replace(text, name) for c in columns]
    return df.selectExpr(*columns)


def _amount_parts(amounts: tuple[str, ...]) -> dict[str, str]:
    cents = {f"_cents_{c}": _cents(c) for c in amounts}
    return cents | {f"_whole_{c}": f"CAST(floor(_cents_{c} / CAST(100 AS DOUBLE)) AS BIGINT)" for c in amounts}


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).alias("o")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name").alias("c")
    return o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey")).selectExpr(*statement_columns())


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _table(spark, sf_dir, "lineitem").alias("l")
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").alias("o")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name").alias("c")
    rows = l.join(o, F.col("l.l_orderkey") == F.col("o.o_orderkey")).join(c, F.col("o.o_custkey") == F.col("c.c_custkey"))
    return _shared(rows, payments_columns(), {"_net_cents": _NET_CENTS})


def statement_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(statement(spark, sf_dir), STATEMENT_RAW_COLUMNS, _amount_parts(("initial_amount", "balance")))


def payments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(payments(spark, sf_dir), PAYMENTS_RAW_COLUMNS, _amount_parts(("paid_amount", "cash", "cheque", "card", "transfer")))
