"""Invariants for the reports that have no SQL oracle (model and clustering)."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from dunning.plans import ml as ML
from dunning.plans.prepare import classify, score
from dunning.reports import Inputs
from dunning.sources import tpch_fixture as fx

SF = "/root/testdata/sf0.01"


def test_random_forest_scores_every_row(spark):
    out = queries()["score_model"](spark, SF)
    st = Inputs(spark, SF).statement
    assert out.count() == st.count()
    bad = out.where((F.col("default_probability") < 0) | (F.col("default_probability") > 1) | F.col("default_probability").isNull())
    assert bad.count() == 0
    agree = out.select(
        F.avg(((F.col("default_probability") > 0.5) == (F.col("days_past_due") > 60)).cast("double"))
    ).first()[0]
    assert agree >= 0.99
    assert out.where(F.col("risk_segment").isNull()).count() == 0


def test_split_is_deterministic_80_20(spark):
    tf = ML.training_frame(Inputs(spark, SF).statement)
    a = tf.where(ML.in_training_split()).select("document_no").collect()
    b = tf.repartition(7).where(ML.in_training_split()).select("document_no").collect()
    assert sorted(a) == sorted(b)
    share = len(a) / tf.count()
    assert 0.7 < share < 0.9


def test_feature_importance(spark):
    rows = queries()["feature_importance"](spark, SF).collect()
    assert [r.variable for r in rows][:1] == ["days_past_due"]
    assert abs(sum(r.importance for r in rows) - 1.0) < 1e-9
    assert len(rows) == 3


def test_one_class_falls_back_to_rules(spark):
    raw = fx.statement(spark, SF)
    st = classify(raw, __import__("datetime").date(2001, 8, 2)).where(F.col("days_past_due") <= 60)
    assert not ML.has_two_classes(st)
    scored = score(st, mode="auto")
    vals = {r[0] for r in scored.select("default_probability").distinct().collect()}
    assert vals <= {0.1, 0.3, 0.5}


def test_scoring_needs_no_key_and_no_shuffle(spark):
    st = Inputs(spark, SF).statement
    odd = st.withColumn("document_no", F.when(F.col("customer_code") % 3 == 0, None).otherwise((F.col("customer_code") % 5).cast("string")))
    model = ML.fit_risk_model(odd)
    scored = ML.score_model(odd, model)
    assert scored.count() == odd.count()
    assert scored.where("default_probability IS NULL").count() == 0
    plan = ML.score_model(spark.read.parquet(_written(odd)), model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def _written(df):
    from dunning.session import scratch_path

    path = scratch_path(df.sparkSession, "odd")
    df.write.parquet(path)
    return path


def test_second_class_only_in_the_hold_out_falls_back_to_rules(spark):
    import pytest

    st = classify(fx.statement(spark, SF), fx.AS_OF)
    only = st.where((F.col("days_past_due") <= 60) | ~ML.in_training_split())
    assert only.where("days_past_due > 60").count() > 0
    vals = {r[0] for r in score(only, mode="auto").select("default_probability").distinct().collect()}
    assert vals <= {0.1, 0.3, 0.5, 0.85}
    with pytest.raises(ValueError, match="one class"):
        score(only, mode="model")


def test_customer_segments(spark):
    seg = queries()["customer_segments"](spark, SF)
    n_customers = Inputs(spark, SF).statement.select("customer_code").distinct().count()
    rows = seg.collect()
    assert len(rows) == n_customers
    assert {r.cluster for r in rows} <= {0, 1, 2, 3}
    # relabelled by ascending mean days
    means = seg.groupBy("cluster").agg(F.avg("avg_days").alias("m")).orderBy("cluster").collect()
    assert [r.m for r in means] == sorted(r.m for r in means)
    stats = queries()["cluster_stats"](spark, SF).collect()
    assert sum(r.customers for r in stats) == n_customers


def test_model_reports_after_an_observation(spark):
    """A session that has observed a DataFrame can still send models to tasks."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from dunning.reports import REPORTS

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    assert REPORTS["score_decision"](spark, "/root/testdata/sf0.001").count() > 0
    assert REPORTS["customer_segments"](spark, "/root/testdata/sf0.001").count() > 0
