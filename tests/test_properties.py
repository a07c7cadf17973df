"""Property tests (hypothesis) against plain-Python brute force."""

import math

import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dunning.functions import text as T
from dunning.operators.running import running_total, select_to_goal
from dunning.functions.money import MOST
from dunning.sources import ingest as IN

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-10_000, 10_000)), min_size=1, max_size=300))
def test_running_total_equals_sorted_prefix_sums(spark, rows):
    data = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, v long")
    got = running_total(df, [F.desc("k"), F.asc("id")], F.col("v"), "cum", position="pos", num_partitions=5)
    res = {r.id: (r.cum, r.pos) for r in got.collect()}
    acc, want = 0, {}
    for pos, (i, k, v) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), start=1):
        acc += v
        want[i] = (acc, pos)
    assert res == want


@SETTINGS
@given(st.lists(st.integers(-500, 2000), min_size=1, max_size=40), st.integers(-100, 20_000))
def test_goal_cut_equals_reference_loop(spark, balances, goal):
    data = [(i, float(b)) for i, b in enumerate(balances)]
    df = spark.createDataFrame(data, "id long, balance double")
    ranked = running_total(df, [F.asc("id")], (F.col("balance") * 100).cast("long"), "_c", position="position")
    ranked = ranked.withColumn("cum", F.col("_c") / 100.0)
    got = sorted(r.id for r in select_to_goal(ranked, float(goal), "cum", "position").collect())
    picked, acc = [], 0.0
    for i, b in data:
        if acc >= goal:
            break
        picked.append(i)
        acc += b
    assert got == picked


def _python_number(s):
    """What the reference's coercion yields: strip commas, float(), NaN -> None."""
    if s is None:
        return None
    t = s.replace(",", "").strip()
    if "_" in t:  # pandas' parser rejects digit separators
        return None
    try:
        v = float(t)
    except ValueError:
        return None
    if math.isnan(v):
        return None
    low = t.lower().lstrip("+-")
    if low not in ("inf", "infinity") and not any(ch.isdigit() for ch in low):
        return None
    return v


NUMERIC_TEXT = st.one_of(
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(lambda x: f"{x:,.2f}"),
    st.integers(-10**9, 10**9).map(str),
    st.text(alphabet="0123456789.,+-eE $()nainf ", max_size=8),
)


@SETTINGS
@given(st.lists(NUMERIC_TEXT, min_size=1, max_size=30))
def test_clean_amount_matches_python_parsing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.v for r in df.select(IN.clean_amount(F.col("s")).alias("v")).collect()]
    wanted = [_python_number(t) for t in texts]
    # what is too large to hold cents is no amount
    assert got == [None if w is None or not abs(w) < MOST else w for w in wanted]


@SETTINGS
@given(st.lists(st.integers(-10**11, 10**11), min_size=1, max_size=30))
def test_currency_text_matches_python_format(spark, cents):
    vals = [c / 100 for c in cents]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.t for r in df.select(T.fmt_currency(F.col("x")).alias("t")).collect()]
    want = ["${:,.2f}".format(v) if v % 1 else "${:,.0f}".format(v) for v in vals]
    assert got == want


@SETTINGS
@given(st.lists(st.integers(-200, 400), min_size=1, max_size=200))
def test_box_summary_matches_numpy(spark, values):
    import numpy as np

    from dunning.operators.distribution import box_summary

    df = spark.createDataFrame([(v,) for v in values], "d int")
    r = box_summary(df, "d").first()
    q1, med, q3 = np.percentile(values, [25, 50, 75], method="linear")
    assert (r.q1, r.median, r.q3) == (pytest.approx(q1), pytest.approx(med), pytest.approx(q3))
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert r.outliers == sum(1 for v in values if v < lo or v > hi)
    assert (r.min_value, r.max_value, r.n) == (min(values), max(values), len(values))


@SETTINGS
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=200), st.integers(1, 25))
def test_histogram_counts_match_numpy(spark, values, bins):
    import numpy as np

    from dunning.operators.distribution import histogram

    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["count"] for r in histogram(df, "x", bins).orderBy("bin").collect()]
    assert len(got) == bins and sum(got) == len(values)
    if max(values) > min(values):
        lo, hi = min(values), max(values)
        width = (hi - lo) / bins
        want = [0] * bins
        for v in values:
            want[min(int(math.floor((v - lo) / width)), bins - 1)] += 1
        assert got == want
        # numpy uses the same edges; counts may differ only for values that sit
        # on a bin border within float rounding (each such value moves once)
        np_counts, _ = np.histogram(values, bins=bins, range=(lo, hi))
        on_border = sum(1 for v in values if abs((v - lo) / width - round((v - lo) / width)) < 1e-9)
        assert sum(abs(a - b) for a, b in zip(got, np_counts)) <= 2 * on_border


@SETTINGS
@given(
    st.lists(
        st.tuples(st.one_of(st.none(), st.integers(-50, 50)), st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False))),
        min_size=1,
        max_size=120,
    )
)
def test_exact_medians_match_numpy(spark, rows):
    import numpy as np

    from dunning.operators.distribution import exact_medians

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, a int, b double")
    got = {r._ci: r.median for r in exact_medians(df, ["a", "b"]).collect()}
    for i, col in enumerate([[a for a, _ in rows], [b for _, b in rows]]):
        vals = [v for v in col if v is not None]
        if vals:
            assert got[i] == pytest.approx(float(np.median(vals)))
        else:
            assert i not in got
