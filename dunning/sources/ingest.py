"""Landed-file ingest: all-string read, date parsing, amount cleaning, and the
emptiness gate (S1-S4).

Every column is read as text with a fixed schema (no inference pass over the
data), then coerced with ``try_*`` functions so one bad cell becomes NULL
instead of failing the job under ANSI mode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType, StructField, StructType

from dunning.functions.dims import literal_frame
from dunning.functions.money import in_range
from dunning.session import materialize
from dunning.sources.csv_ranges import read_csv_ranges

STATEMENT_TEXT_COLUMNS = (
    "customer_code",
    "customer_name",
    "fiscal_no",
    "document_no",
    "invoice_date",
    "due_date",
    "days_past_due",
    "initial_amount",
    "balance",
    "aging_0_30",
    "aging_31_60",
    "aging_61_90",
    "aging_91_120",
    "aging_over_120",
)
PAYMENT_TEXT_COLUMNS = (
    "customer_code",
    "customer_name",
    "fiscal_no",
    "document_no",
    "line_no",
    "payment_date",
    "paid_amount",
    "discount_amount",
    "total_amount",
    "cash",
    "cheque",
    "card",
    "transfer",
)
STATEMENT_AMOUNTS = (
    "initial_amount",
    "balance",
    "aging_0_30",
    "aging_31_60",
    "aging_61_90",
    "aging_91_120",
    "aging_over_120",
)
PAYMENT_AMOUNTS = ("paid_amount", "discount_amount", "total_amount", "cash", "cheque", "card", "transfer")

#: Landed CSV: doubled quotes and line breaks inside quoted cells, as spreadsheets
#: and pandas write them.  A file with ``multiLine`` is read by one task, so
#: files above ``spark.sql.files.maxPartitionBytes`` are read in byte ranges.
CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true"}

# Plain decimal / scientific numbers, optionally signed.
# (Spark alone would also accept '1d' / '1f' suffixes, pandas does not.)
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def text_schema(columns) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def read_receivables(spark: SparkSession, path: str, fmt: str = "csv", columns=None) -> DataFrame:
    """Read landed files of one table with every column as text.

    CSV columns are matched by the *header names* (not by position), with no
    type inference, so optional columns may simply be absent -- like the
    reference's ``if name in df.columns`` checks.  ``columns`` (optional)
    keeps the known columns that are present, in that order.
    """
    if fmt == "csv" and largest_file(spark, path) > range_bytes(spark):
        df = read_csv_ranges(spark, path)
    elif fmt == "csv":
        df = spark.read.options(**CSV_OPTIONS, inferSchema="false", mode="PERMISSIVE").csv(path)
    else:
        df = spark.read.format(fmt).load(path)
        df = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    if columns is not None:
        df = df.select([c for c in columns if c in df.columns])
    return df


def with_row_order(df: DataFrame) -> DataFrame:
    """Parquet rows with ``_file`` and ``_row``, their place in the input:
    names are then the first in row order, as in the reference, instead of the
    smallest.  (CSV: ``read_csv_ranges(..., positions=True)``.)"""
    at = df.metadataColumn("_metadata")
    return df.select("*", at["file_path"].alias("_file"), at["row_index"].alias("_row"))


def range_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` in bytes."""
    conf = spark._jsparkSession.sessionState().conf()
    return conf.filesMaxPartitionBytes()


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file below ``path``; only the listing is read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]


def parse_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """A date, or the date of a date and time; unparsable text -> NULL."""
    s = F.trim(c.cast("string"))
    times = [F.try_to_timestamp(s, F.lit(f"{fmt}{t}")).cast("date") for t in (" HH:mm[:ss]", "'T'HH:mm[:ss]", " HH:mm:ss.SSSSSS", " HH:mm:ss.SSS")]
    # every time has a colon; four failed attempts cost more than the rest of a row
    return F.coalesce(F.try_to_date(s, fmt), F.when(F.contains(s, F.lit(":")), F.coalesce(*times)))


def parse_dates(df: DataFrame, cols, fmt: str = "yyyy-MM-dd") -> DataFrame:
    present = [c for c in cols if c in df.columns]
    trimmed = df.withColumns({c: F.trim(F.col(c).cast("string")) for c in present})
    return trimmed.withColumns({c: parse_date(F.col(c), fmt) for c in present})


def _without_commas(c: Column) -> Column:
    return F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("")))


def _number(s: Column) -> Column:
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def _whole(n: Column) -> Column:
    return F.when(n == F.floor(n), n.try_cast("int"))


def clean_amount(c: Column) -> Column:
    """Strip thousands commas and spaces, coerce to double.  Junk, NaN and what
    is no amount (infinite, or too large to hold cents, see
    :data:`dunning.functions.money.MOST`) -> NULL."""
    return in_range(_number(_without_commas(c)))


def clean_whole(c: Column) -> Column:
    """A whole number, also written as 45.0; anything else -> NULL."""
    return _whole(clean_amount(c))


def clean_amounts(df: DataFrame, cols) -> DataFrame:
    """:func:`clean_amount` of each column, step by step over all of them: each
    step uses the one before several times, and here it is evaluated once.  One
    expression for all columns also keeps Spark's generated method small: above
    8000 bytes of code the JVM interprets it."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    cells = F.array(*[F.col(c).cast("string") for c in present])
    for step in (_without_commas, _number, in_range):
        cells = F.transform(cells, step)
    return df.withColumn("_amounts", cells).withColumns({c: F.col("_amounts")[i] for i, c in enumerate(present)}).drop("_amounts")


def clean_wholes(df: DataFrame, cols) -> DataFrame:
    df = clean_amounts(df, cols)
    return df.withColumns({c: _whole(F.col(c)) for c in cols if c in df.columns})


def require_non_empty(df: DataFrame, name: str) -> DataFrame:
    """Stop early when a table is empty (one cheap ``LIMIT 1`` job)."""
    if df.isEmpty():
        raise ValueError(f"table {name!r} is empty; check the path and structure")
    return df


def clean_statement(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    df = parse_dates(raw, ["invoice_date", "due_date"], date_format)
    df = clean_amounts(df, STATEMENT_AMOUNTS)
    return clean_wholes(df, ["days_past_due"])


def clean_payments(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    df = parse_dates(raw, ["payment_date"], date_format)
    df = clean_amounts(df, PAYMENT_AMOUNTS)
    return clean_wholes(df, ["line_no"])


def load_receivables(
    spark: SparkSession,
    statement_path: str,
    payments_path: str,
    fmt: str = "csv",
    date_format: str = "yyyy-MM-dd",
) -> tuple[DataFrame, DataFrame]:
    """S1-S4 end to end: read both landed tables as text, coerce dates and
    amounts, and stop early when either is empty."""
    st = read_receivables(spark, statement_path, fmt, STATEMENT_TEXT_COLUMNS if fmt == "csv" else None)
    pay = read_receivables(spark, payments_path, fmt, PAYMENT_TEXT_COLUMNS if fmt == "csv" else None)
    st = require_non_empty(clean_statement(st, date_format), "statement")
    pay = require_non_empty(clean_payments(pay, date_format), "payments")
    return st, pay


# --- what coercion lost ----------------------------------------------------------


@dataclass(frozen=True)
class Accounted:
    """A cleaned table and what its cleaning lost."""

    #: The cleaned rows.
    rows: DataFrame
    #: ``column_name`` and ``cell`` of each text that gave no value, beside what identifies its row.
    rejects: DataFrame
    #: ``column_name``, ``cells`` (rows), ``missing`` (null or blank) and ``rejected``.
    counts: DataFrame


def clean_accounted(raw: DataFrame, clean, columns, row_id=()) -> Accounted:
    """``clean(raw)`` with an account of ``columns``, in one pass over ``raw``.

    The counters ride on the job that writes the cleaned rows; rejected cells
    are written beside their row, so rows and rejects read the same files.
    ``row_id`` names columns of ``raw`` that tell where a row comes from, such
    as ``_file`` and ``_row`` of :func:`read_csv_ranges`.
    """
    columns = [c for c in columns if c in raw.columns]
    text = {c: f"_text_{c}" for c in columns}
    df = clean(raw.withColumns({t: F.col(c).cast("string") for c, t in text.items()}))
    blank = {c: F.coalesce(F.trim(t), F.lit("")) == "" for c, t in text.items()}
    lost = {c: ~blank[c] & F.col(c).isNull() for c in columns}
    account = Observation()
    sums = [F.count(F.lit(1)).alias("cells")]
    for c in columns:
        sums += [F.count_if(blank[c]).alias(f"{c}_missing"), F.count_if(lost[c]).alias(f"{c}_rejected")]
    cells = F.array(*[F.when(lost[c], F.struct(F.lit(c).alias("column_name"), F.col(text[c]).alias("cell"))) for c in columns])
    df = df.observe(account, *sums).withColumn("_rejects", F.array_compact(cells)).drop(*text.values())
    written = materialize(df)
    got = account.get
    counts = [(c, got["cells"], got[f"{c}_missing"], got[f"{c}_rejected"]) for c in columns]
    spark = raw.sparkSession
    return Accounted(
        rows=written.drop("_rejects"),
        rejects=written.where(F.size("_rejects") > 0).select(*row_id, F.inline("_rejects")),
        counts=literal_frame(spark, counts, T.StructType().add("column_name", "string").add("cells", "long").add("missing", "long").add("rejected", "long")),
    )


STATEMENT_COERCED = ("invoice_date", "due_date", "days_past_due", *STATEMENT_AMOUNTS)
PAYMENT_COERCED = ("payment_date", "line_no", *PAYMENT_AMOUNTS)


def load_accounted(spark: SparkSession, statement_path: str, payments_path: str, date_format: str = "yyyy-MM-dd") -> tuple[Accounted, Accounted]:
    """:func:`load_receivables` of landed CSV files with an account of each
    table; a rejected cell comes with its file and row (the header is row 0)."""
    at = ("_file", "_row")
    out = []
    for path, known, clean, columns in (
        (statement_path, STATEMENT_TEXT_COLUMNS, clean_statement, STATEMENT_COERCED),
        (payments_path, PAYMENT_TEXT_COLUMNS, clean_payments, PAYMENT_COERCED),
    ):
        raw = require_non_empty(read_csv_ranges(spark, path, positions=True), path)
        raw = raw.select(*at, *[c for c in known if c in raw.columns])
        out.append(clean_accounted(raw, lambda df, clean=clean: clean(df, date_format), columns, at))
    return out[0], out[1]
