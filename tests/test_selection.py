"""Exact box statistics, quantile sketches and the goal search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunning.operators import running
from dunning.operators.keys import join_small
from dunning.operators.quantile_sketch import K, measured_ranks, merge_sketches, rank_error, sketch_values, sketched_box
from dunning.operators.running import rows_to_goal
from dunning.operators.selection import double_image, exact_box, from_double_image, select_ranks

# --- exact box ----------------------------------------------------------------


def box_of(values):
    v = sorted(values)

    def at(p):
        x = (len(v) - 1) * p
        a, b = v[math.floor(x)], v[math.ceil(x)]
        return a + (b - a) * (x - math.floor(x))

    q1, q2, q3 = at(0.25), at(0.5), at(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return (v[0], q1, q2, q3, v[-1], len(v), lo, hi, sum(x < lo or x > hi for x in v))


def test_box_of_any_doubles(spark):
    rng = random.Random(1)
    groups = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(301)],
        "hot": [7.25] * 400 + [rng.gauss(0, 1) for _ in range(200)],
        "zero": [0.0, -0.0, 1.0, -1.0],
        "one": [3.5],
        "tiny": [5e-324 * i for i in range(50)],
        None: [float(i) for i in range(10)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("empty", None), ("empty", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in exact_box(df, "v", ["g"]).collect()}
    assert got == {g: box_of(v) for g, v in groups.items()}


def test_box_of_money_and_whole_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(-(10**9), 10**11) / 100, rng.randrange(-50, 50)) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, d int")
    for column, image in ((1, "money"), (2, "whole")):
        got = {r[0]: tuple(r)[1:] for r in exact_box(df, "vd"[column - 1], ["g"], image).collect()}
        assert got == {g: box_of([float(r[column]) for r in rows if r[0] == g]) for g in "ab"}
    assert [tuple(r) for r in exact_box(df, "v", image="money").collect()] == [box_of([r[1] for r in rows])]
    assert exact_box(df.where("false"), "v", ["g"]).collect() == []


def test_several_group_columns_and_many_groups(spark):
    df = spark.range(6000).select((F.col("id") % 50).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") * 37 % 1009).alias("v"))
    got = {(r.a, r.b): r.median for r in exact_box(df, "v", ["a", "b"], "whole").collect()}
    want = {}
    for i in range(6000):
        want.setdefault((i % 50, i % 3), []).append(i * 37 % 1009)
    assert got == {g: float(np.median(v)) for g, v in want.items()}


def test_any_rank_can_be_asked_for(spark):
    values = [v * v % 977 - 400 for v in range(2000)]
    rows = spark.createDataFrame([(0, v) for v in values], "g int, v long")
    ranks = spark.createDataFrame([(0, r) for r in (0, 1, 999, 1500, 1999)], "g int, rank long")
    got = {r["rank"]: r["found"] for r in select_ranks(rows, "v", ["g"], ranks).collect()}
    assert got == {r: sorted(values)[r] for r in (0, 1, 999, 1500, 1999)}


def test_image_keeps_the_order_of_doubles(spark):
    values = [float("-inf"), -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("i", double_image(F.col("v")))
    got = sorted(df.withColumn("back", from_double_image(F.col("i"))).collect(), key=lambda r: r.i)
    assert [r.v for r in got] == values == [r.back for r in got] and len({r.i for r in got}) == len(values)


def test_no_row_moves_in_a_counting_pass(spark):
    """What is shuffled are counts: rows are neither sorted nor joined by shuffle."""
    from dunning import session

    plans, write = [], session.materialize
    df = spark.range(50_000).select((F.col("id") % 4).alias("g"), F.col("id").alias("v"))
    from dunning.operators import selection

    try:
        selection.materialize = lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or write(x)
        exact_box(df, "v", ["g"], "whole").collect()
    finally:
        selection.materialize = write
    assert len(plans) > 4
    for plan in plans:
        assert "SortMergeJoin" not in plan.split("_rel")[0] or "HashAggregate" in plan
        for below in plan.split("Exchange hashpartitioning")[1:]:
            assert "partial_" in below or "Aggregate" in below or "LocalTableScan" in below or "FileScan" in below


@pytest.mark.parametrize("small", [100_000, 2])
def test_facts_join_both_ways(spark, monkeypatch, small):
    monkeypatch.setattr("dunning.operators.keys.SMALL", small)
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("c", 4)], "g string, v int")
    facts = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "g string, f int")
    got = join_small(rows, facts, ["g"])
    assert got.columns == ["g", "v", "f"]
    assert sorted((r.v, r.f) for r in got.collect()) == [(1, 10), (2, 20), (3, 30)]
    assert sorted(r.v for r in join_small(rows, facts.select("g"), ["g"], "left_semi").collect()) == [1, 2, 3]


# --- sketches -------------------------------------------------------------------


def test_sketches_keep_their_bound_and_size(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 24).alias("month"), (F.rand(3) * F.rand(4) * 1e6).alias("v"))
    df = df.union(spark.createDataFrame([(0, 0, None), (1, 0, float("nan"))], "g long, month long, v double"))
    from dunning.session import materialize

    df = materialize(df)
    stored = materialize(sketch_values(df, "v", ["g", "month"]))
    assert stored.count() == 24
    assert stored.agg(F.max(F.length("sketch"))).first()[0] < 60 * K
    boxes = materialize(sketched_box(merge_sketches(stored, ["g"]), ["g"]))
    assert boxes.agg(F.sum("n")).first()[0] == 200_000
    for r in measured_ranks(df, "v", ["g"], boxes).collect():
        assert max(r.q1_error, r.median_error, r.q3_error) <= 3 * rank_error()
    # a period: only its months
    few = merge_sketches(stored.where("month < 6"), ["g"])
    assert few.agg(F.sum("n")).first()[0] == df.where("month < 6 AND v < 1e9").count()
    exact = {r.g: r for r in exact_box(df, "v", ["g"]).collect()}
    for r in boxes.collect():
        assert (r.min_value, r.max_value) == (exact[r.g].min_value, exact[r.g].max_value)
        assert abs(r.outliers - exact[r.g].outliers) <= 6 * rank_error() * r.n


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(K // 2 + 1)], "g string, v double")
    (box,) = sketched_box(sketch_values(df, "v", ["g"]), ["g"]).collect()
    (errors,) = measured_ranks(df, "v", ["g"], spark.createDataFrame([box])).collect()
    assert (errors.q1_error, errors.median_error, errors.q3_error) == (0.0, 0.0, 0.0)


# --- goal search ------------------------------------------------------------------


def walk(rows, goal):
    """Rows up to the one at which the total reaches the goal."""
    if goal <= 0:
        return []
    out, total = [], 0
    for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])):
        out.append(r[0])
        total += r[2] or 0
        if total / 100.0 >= goal:
            break
    return sorted(out)


def some_rows(seed, n=400):
    rng = random.Random(seed)
    scores = [rng.choice([0.25, 0.25, 0.5, rng.random(), rng.random() * 1e-12, None]) for _ in range(n)]
    return [(i, scores[i], rng.choice([None, rng.randrange(-4000, 9000), rng.randrange(0, 900)])) for i in range(n)]


@pytest.mark.parametrize("most", [1_000_000, 10])
@pytest.mark.parametrize("seed", [1, 2])
def test_goal_search_equals_the_walk(spark, monkeypatch, most, seed):
    monkeypatch.setattr(running, "GOAL_ROWS", most)
    monkeypatch.setattr(running, "GOAL_BINS", 16)
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, "id int, score double, cents long").repartition(4)
    top = sum(r[2] or 0 for r in rows) / 100
    for goal in (0, 0.01, 29.29, top / 3, top * 0.9, top * 5):
        assert sorted(r.id for r in rows_to_goal(df, "score", ["id"], "cents", goal).collect()) == walk(rows, goal), goal


def test_goal_cut_is_a_filter(spark, monkeypatch):
    """No other row is moved, and only the bin of the cut is ordered."""
    monkeypatch.setattr(running, "GOAL_ROWS", 50)
    ordered = []
    run = running.running_total
    monkeypatch.setattr(running, "running_total", lambda df, *a, **k: ordered.append(df.count()) or run(df, *a, **k))
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_011 / 20_011).alias("score"), F.lit(100).cast("long").alias("cents"))
    chosen = rows_to_goal(df, "score", ["id"], "cents", 5000.0)
    assert chosen.count() == 5000
    assert len(ordered) == 1 and ordered[0] <= 50
    assert "Exchange" not in chosen._jdf.queryExecution().executedPlan().toString()


