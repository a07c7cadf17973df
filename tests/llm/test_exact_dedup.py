from collections import defaultdict

from pyspark.sql import functions as F

from dunning.llm.common import new_folder, with_location
from dunning.llm.exact_dedup import arrivals_of, drop_exact_copies, exact_groups, first_seen, sha256

SCHEMA = "doc_id long, text string, file int, keeper string"
ROWS = [
    (1, "a  b", 5, "x"),
    (7, "a\tb", 6, None),
    (None, "a b", 6, "x"),
    (1, "a b", 7, "x"),
    (3, "a b ", 1, "x"),
    (4, None, 2, "x"),
    (5, "", 3, "x"),
    (None, "z", None, "x"),
    (9, "é" * 50_000, 1, "x"),
    (8, "é" * 50_000, 1, "x"),
]


def groups(spark, rows, **options):
    return exact_groups(spark.createDataFrame(rows, SCHEMA), **options)


def test_groups_of_equal_texts(spark):
    got = {(r.id, r.sha, r.keep_id, r.group_size) for r in groups(spark, ROWS).collect()}
    sizes = defaultdict(set)
    for i, _, keep, size in got:
        sizes[keep, size].add(i)
    assert sizes == {(1, 4): {1, 7, None}, (3, 1): {3}, (4, 2): {4, 5}, (None, 1): {None}, (8, 2): {8, 9}}


def test_one_row_of_a_group_stays_with_all_its_columns(spark):
    got = drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "text", "file", "keeper"]
    assert sorted((str(r.doc_id), r.text if r.text is None else len(r.text.split())) for r in got.collect()) == sorted(
        [("1", 2), ("3", 2), ("4", None), ("None", 1), ("8", 1)]
    )


def test_texts_whose_digests_collide_are_told_apart_by_their_bytes(spark):
    strong = {(r.id, r.sha, r.keep_id, r.group_size, r.kept) for r in groups(spark, ROWS).collect()}
    weak = {(r.id, r.sha, r.keep_id, r.group_size, r.kept) for r in groups(spark, ROWS, digest=lambda c: F.lit("k").cast("binary")).collect()}
    # the kept row of id 1, given twice, depends on the location only
    assert {x[:4] for x in weak} == {x[:4] for x in strong}
    assert sum(x[4] for x in weak) == sum(x[4] for x in strong)


def test_empty_table(spark):
    assert groups(spark, []).count() == 0
    assert drop_exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stream_goes_on_with_the_state_of_earlier_runs(spark):
    path, checkpoint = new_folder(spark, "arrivals"), new_folder(spark, "state")
    parts = [spark.createDataFrame(rows, SCHEMA) for rows in (ROWS[:5], ROWS[5:], [(0, "a b", 1, "x"), (2, "new", 1, "x")])]
    for part in parts:
        arrivals_of(with_location(part), "text", "doc_id", sha256).write.mode("append").parquet(path)
        state = {(r.keeper.id, r.size) for r in first_seen(spark.read.parquet(path), path, checkpoint).collect()}
    assert state == {(0, 5), (3, 1), (4, 2), (None, 1), (8, 2), (2, 1)}
    assert {(r.keeper.id, r.size) for r in first_seen(spark.read.parquet(path), path, checkpoint).collect()} == state
