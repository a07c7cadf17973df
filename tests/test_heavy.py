"""Certified top sums against the plain aggregation; first names in row order."""

import random

import pytest
from pyspark.sql import functions as F

from dunning.operators.heavy import certain, summaries, top_keys, top_sums
from dunning.operators.modal import any_name
from dunning.sources.csv_ranges import read_csv_ranges
from dunning.sources.ingest import with_row_order


def zipf(n=6000, names=2500, seed=1, negative=False):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = int(names * rng.random() ** 6)
        out.append((f"n{k}", rng.randrange(-500 if negative else 1, 2000)))
    return out


def report(df):
    return df.groupBy("name").agg((F.sum("cents") / 100.0).alias("sums")).orderBy(F.desc("sums"), "name").limit(5)


@pytest.mark.parametrize("negative", [False, True])
@pytest.mark.parametrize("capacity", [4, 60, 5000])
def test_top_sums_equal_the_aggregation(spark, capacity, negative):
    df = spark.createDataFrame(zipf(negative=negative) + [(None, 10**9)], "name string, cents long").repartition(6)
    got = top_sums(df.where("name IS NOT NULL"), "name", "cents", 5, report, "sums", capacity)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in report(df.where("name IS NOT NULL")).collect()]


def test_certificate_holds_for_few_candidates(spark):
    """With 60 of some 2,000 names kept, the first five are certain, and the
    plain aggregation does not run."""
    df = spark.createDataFrame(zipf(), "name string, cents long").repartition(6)
    runs = []
    top_sums(df, "name", "cents", 5, lambda rows: runs.append(rows) or report(rows), "sums", 60)
    assert len(runs) == 1
    runs.clear()
    top_sums(df, "name", "cents", 5, lambda rows: runs.append(rows) or report(rows), "sums", 5)
    assert len(runs) == 2  # not certain with so few


def test_nobody_left_out_has_more_than_the_bound(spark):
    rows = zipf(negative=True, seed=4)
    df = spark.createDataFrame(rows, "name string, cents long").repartition(7)
    for capacity in (8, 40):
        keys, most = top_keys(df, "name", "cents", 5, capacity)
        totals = {}
        for k, v in rows:
            totals[k] = totals.get(k, 0) + v
        assert len(keys) == capacity
        assert max(v for k, v in totals.items() if k not in keys) <= most
        held = summaries(df, "name", "cents", capacity).groupBy(F.spark_partition_id()).count()
        assert held.agg(F.max("count")).first()[0] <= 2 * capacity + 1
        taken = summaries(df, "name", "cents", capacity).where("key IS NULL").agg(F.sum("weight")).first()[0]
        assert taken <= sum(max(v, 0) for _, v in rows) / capacity


def test_certificate():
    assert certain(1.01, 100) and not certain(1.0, 100) and not certain(None, 0) and not certain(-3.0, 0)


def test_empty(spark):
    df = spark.createDataFrame([], "name string, cents long")
    assert top_sums(df, "name", "cents", 5, report, "sums").collect() == []


def test_names_in_row_order(spark, tmp_path):
    rows = [(1, "z"), (2, None), (1, "a"), (2, "y"), (2, "b"), (3, None)]
    df = spark.createDataFrame(rows, "code int, name string")
    df.coalesce(1).write.parquet(f"{tmp_path}/p")
    named = lambda d: {r.code: r.name for r in d.groupBy("code").agg(any_name(F.col("name"), d).alias("name")).collect()}
    assert named(with_row_order(spark.read.parquet(f"{tmp_path}/p"))) == {1: "z", 2: "y", 3: None}
    assert named(df) == {1: "a", 2: "b", 3: None}
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/c")
    got = named(read_csv_ranges(spark, f"{tmp_path}/c", positions=True))
    assert got == {"1": "z", "2": "y", "3": None}
