"""CSV files in byte ranges, and the account of what coercion lost."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from dunning.sources import ingest as IN
from dunning.sources.csv_ranges import file_lines, odd_ranges, read_csv_ranges, safe_header

HEADER = ["id", "name", "note"]


def some_rows(n, seed=1):
    rng = random.Random(seed)
    names = ["plain", 'a "quoted" one', "two\nlines", "x,y", '\n\n\n"', "'", "é\r\nß", " blanks ", "long " * 20 + "\n" * 40]
    return [[str(i), rng.choice(names), rng.choice(["", "é", "1,234.50", '""'])] for i in range(n)]


def write(path, rows, header=HEADER, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


@pytest.fixture
def ranges(spark):
    """Sets the size of a range."""

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cells(df):
    return sorted(tuple(r[c] or "" for c in HEADER) for r in df.collect())


@pytest.mark.parametrize("size", ["29", "64", "1k", "1m"])
def test_rows_do_not_depend_on_the_ranges(spark, tmp_path, ranges, size):
    rows = some_rows(120)
    write(tmp_path / "a.csv", rows[:70])
    write(tmp_path / "b.csv", rows[70:119], end="\r\n")
    write(tmp_path / "c.csv", [r[::-1] for r in rows[119:]], header=HEADER[::-1])  # columns by name
    write(tmp_path / "d.csv", [])
    ranges(size)
    df = read_csv_ranges(spark, str(tmp_path))
    assert cells(df) == sorted(map(tuple, rows))
    if size == "29":
        lines = file_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 100
        assert odd_ranges(lines).count() > 20  # ranges that start inside quotes


def test_a_break_at_every_border(spark, tmp_path, ranges):
    """One quoted break a file, with the border of a range at each of its bytes."""
    rows = [[[f"{pad}a", "x" * pad, "n"], [f"{pad}b", 'one\n"two"', "m"], [f"{pad}c", "y", "k"]] for pad in range(14)]
    for pad, some in enumerate(rows):
        write(tmp_path / f"{pad}.csv", some)
    ranges("32")
    assert cells(read_csv_ranges(spark, str(tmp_path))) == sorted(tuple(r) for some in rows for r in some)


def test_positions_are_row_numbers(spark, tmp_path, ranges):
    rows = some_rows(60, seed=3)
    write(tmp_path / "a.csv", rows)
    ranges("100")
    got = read_csv_ranges(spark, str(tmp_path), positions=True).collect()
    assert sorted((r._row, r.id) for r in got) == [(i + 1, r[0]) for i, r in enumerate(rows)]
    assert {r._file.rsplit("/", 1)[1] for r in got} == {"a.csv"}


def test_landed_files_are_split_when_they_are_large(spark, tmp_path, ranges):
    rows = some_rows(100, seed=5)
    path = write(tmp_path / "a.csv", rows)
    assert IN.largest_file(spark, path) < IN.range_bytes(spark)
    whole = cells(IN.read_receivables(spark, path))
    ranges("500")
    assert IN.largest_file(spark, path) > IN.range_bytes(spark) == 500
    assert cells(IN.read_receivables(spark, path)) == sorted(map(tuple, rows))
    assert [r[0] for r in whole] == [r[0] for r in sorted(map(tuple, rows))]


def test_headers():
    assert safe_header('a,"b ""x""",,a') == ["a0", 'b "x"', "_c2", "a3"]


def test_empty_and_blank_files(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "f.csv").write_text("")
    assert read_csv_ranges(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "f.csv").write_text("\n\nid,name,note\n\n1,,x\n \n")
    assert cells(read_csv_ranges(spark, str(tmp_path / "blank"))) == [("1", "", "x")]


# --- account ---------------------------------------------------------------------


def test_account_counts_and_rejects_in_one_pass(spark, tmp_path):
    with open(tmp_path / "st.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["customer_code", "customer_name", "document_no", "invoice_date", "due_date", "balance"])
        out.writerow(["1", "a\nb", "d1", "2001-02-03", "", "1,234.50"])
        out.writerow(["2", "c", "d2", "soon", "2001-02-30", "N/A"])
        out.writerow(["3", "d", "d3", "2001-02-03 10:00", " ", "inf"])
        out.writerow(["4", "e", "d4", "", "", ""])
    with open(tmp_path / "pay.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["customer_code", "line_no", "payment_date", "paid_amount"])
        out.writerow(["1", "1.5", "2001-02-03", "-"])
    st, pay = IN.load_accounted(spark, str(tmp_path / "st.csv"), str(tmp_path / "pay.csv"))
    counts = {r.column_name: (r.cells, r.missing, r.rejected) for r in st.counts.collect()}
    assert counts == {"invoice_date": (4, 1, 1), "due_date": (4, 3, 1), "balance": (4, 1, 2)}
    rejects = sorted((r._row, r.column_name, r.cell) for r in st.rejects.collect())
    assert rejects == [(2, "balance", "N/A"), (2, "due_date", "2001-02-30"), (2, "invoice_date", "soon"), (3, "balance", "inf")]
    assert {r._file.rsplit("/", 1)[1] for r in st.rejects.collect()} == {"st.csv"}
    clean = IN.clean_statement(IN.read_receivables(spark, str(tmp_path / "st.csv")))
    assert sorted(map(str, st.rows.drop("_file", "_row").collect())) == sorted(map(str, clean.collect()))
    assert sorted((r.column_name, r.cell) for r in pay.rejects.collect()) == [("line_no", "1.5"), ("paid_amount", "-")]


def test_account_reads_its_input_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    raw = spark.range(100).select(F.col("id").cast("string").alias("balance"), F.lit("x").alias("due_date")).mapInArrow(count, "balance string, due_date string")
    got = IN.clean_accounted(raw, IN.clean_statement, IN.STATEMENT_COERCED)
    assert got.rows.count() == 100 and got.rejects.count() == 100
    assert {r.column_name: r.rejected for r in got.counts.collect()} == {"balance": 0, "due_date": 100}
    assert reads.value == 100


def test_empty_table_has_an_account(spark):
    got = IN.clean_accounted(spark.createDataFrame([], "balance string"), IN.clean_statement, IN.STATEMENT_COERCED)
    assert [tuple(r) for r in got.counts.collect()] == [("balance", 0, 0, 0)] and got.rejects.count() == 0


def test_cells_are_cleaned_once(spark):
    """One pattern for all amounts and one for the whole number; it was twelve before."""
    from dunning.sources import tpch_fixture as fx
    from dunning.sources.ingest import clean_payments

    plan = clean_payments(fx.payments_raw(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == 2
