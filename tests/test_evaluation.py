"""Score evaluation against all pairs, and the reports of one scan."""

import random

import pytest
from tools.oracle_check import rows_of

from dunning.operators.evaluation import calibration, evaluate, score_curve
from dunning.plans import ml as ML
from dunning.plans import portfolio as PO
from dunning.plans.prepare import prepare_statement
from dunning.reports import REPORTS
from dunning.session import materialize
from dunning.sources import tpch_fixture as fx

SF = "/root/testdata/sf0.001"


def pairs(rows):
    """Share of (positive, negative) pairs in the right order, ties half."""
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
def test_area_is_the_share_of_ordered_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0.25, 0.25, 0.5, round(rng.random(), 6)]), int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows + [(None, 1), (0.5, None)], "p double, y int").repartition(5)
    got = evaluate(df, "p", "y").first()
    assert (got.rows, got.positives) == (400, sum(y for _, y in rows))
    assert got.auc == pytest.approx(pairs(rows), abs=1e-12)
    assert got.brier == pytest.approx(sum((p - y) ** 2 for p, y in rows) / 400, abs=1e-9)
    assert got.accuracy == sum((p > 0.5) == (y == 1) for p, y in rows) / 400
    bins = {r.bin: (r.rows, r.mean_score, r.positive_share) for r in calibration(df, "p", "y", 4).collect()}
    for b, (n, mean, share) in bins.items():
        own = [(p, y) for p, y in rows if min(int(p * 4), 3) == b]
        assert n == len(own) and share == sum(y for _, y in own) / n and mean == pytest.approx(sum(p for p, _ in own) / n)
    assert sum(n for n, _, _ in bins.values()) == 400


def test_ties_are_one_row(spark):
    df = spark.createDataFrame([(0.5, i % 2) for i in range(1000)] + [(1.0, 1)], "p double, y int")
    assert sorted(tuple(r) for r in score_curve(df, "p", "y").collect()) == [(0.5, 500, 500, 0), (1.0, 1, 0, 500)]


def test_one_class_and_no_rows(spark):
    one = evaluate(spark.createDataFrame([(0.2, 1), (0.9, 1)], "p double, y int"), "p", "y").first()
    assert (one.rows, one.positives, one.auc, one.accuracy) == (2, 2, None, 0.5)
    none = evaluate(spark.createDataFrame([], "p double, y int"), "p", "y").first()
    assert (none.rows, none.positives, none.auc, none.brier) == (0, 0, None, None)


def test_holdout_is_the_fifth_that_was_not_learnt(spark):
    st = materialize(prepare_statement(fx.statement(spark, SF), fx.AS_OF, "rules"))
    model = ML.fit_risk_model(st, num_trees=10)
    got, bins = ML.model_holdout(st, model)
    got = got.first()
    held = st.where(~ML.in_training_split())
    assert got.rows == held.count() == sum(r.rows for r in bins.collect())
    assert 0.1 < got.rows / st.count() < 0.3
    scored = ML.labelled(ML.score_model(held, model)).collect()
    assert got.auc == pytest.approx(pairs([(r.default_probability, r.label) for r in scored]), abs=1e-12)
    assert got.auc > 0.95


def test_six_reports_of_one_scan(spark):
    st = prepare_statement(fx.statement(spark, SF), fx.AS_OF, "rules")
    plan = PO.breakdowns(st)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FileScan parquet") == 2  # invoices and customers, once each
    parts = PO.reports_of(materialize(PO.breakdowns(st)))
    assert len(parts) == 6
    for name, got in parts.items():
        want = REPORTS[name](spark, SF)
        assert got.dtypes == want.dtypes, name
        assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(want.columns, map(tuple, want.collect())), name
