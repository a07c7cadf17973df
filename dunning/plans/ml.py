"""Risk model and customer segmentation (M1-M8, A18, T3) with ``pyspark.ml``.

The random forest mirrors the reference's settings (150 trees, depth 5,
seed 42, one feature per split like scikit-learn's sqrt(3) -> 1).  The split
is a hash of the document number, so it does not depend on partitioning.
K-means cluster ids are relabelled 0..3 by ascending mean days so that the
group descriptions are stable.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from dunning.functions import classify as C
from dunning.functions.dims import literal_frame
from dunning.functions.money import WIDE_INT, fixed_point, spread_and_centre
from dunning.operators.distribution import exact_medians
from dunning.operators.evaluation import calibration, evaluate
from dunning.session import materialize

FEATURES = ["days_past_due", "initial_amount", "balance"]
SEVERE_DAYS = 60
#: More than the different values of days past due in a few years, so that the
#: trees can split between any two of them.
MAX_BINS = 1024


def training_frame(st: DataFrame) -> DataFrame:
    """Features with missing -> 0 and label = days > 60 (missing -> 0)."""
    return st.select(
        "document_no",
        F.coalesce(F.col("days_past_due"), F.lit(0)).alias("days_past_due"),
        F.coalesce(F.col("initial_amount"), F.lit(0.0)).alias("initial_amount"),
        F.coalesce(F.col("balance"), F.lit(0.0)).alias("balance"),
        F.when(F.col("days_past_due") > SEVERE_DAYS, F.lit(1)).otherwise(F.lit(0)).alias("label"),
    )


def in_training_split(key: str = "document_no", train_pct: int = 80) -> F.Column:
    """Deterministic 80/20 split on a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(100)) < train_pct


def has_two_classes(st: DataFrame) -> bool:
    """The one driver-side check: do the rows that the model would learn from
    have both classes?"""
    n = training_frame(st).where(in_training_split()).agg(F.count_distinct("label")).first()[0]
    return n >= 2


def fit_risk_model(st: DataFrame, seed: int = 42, num_trees: int = 150, max_depth: int = 5) -> PipelineModel:
    """A missing document number hashes like any other value, so every row is
    on one side of the split."""
    if not has_two_classes(st):
        raise ValueError("the training rows have one class only: score by the rules (mode 'rules' or 'auto')")
    train = training_frame(st).where(in_training_split()).withColumn("label", F.col("label").cast("double"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        maxBins=MAX_BINS,
        featureSubsetStrategy="1",
        labelCol="label",
        featuresCol="features",
    )
    model = Pipeline(stages=[assembler, forest]).fit(train)
    without_summary(model.stages[-1])
    return model


def without_summary(model) -> None:
    """Drop a fitted model's training summary.  It holds the session, which no
    task can receive once the session has observed a DataFrame."""
    model._java_obj.setSummary(SparkSession.getActiveSession()._jvm.scala.Option.empty())


def score_model(st: DataFrame, model: PipelineModel) -> DataFrame:
    """P(label = 1) for *every* row, and the model path's segmentation
    (exactly 0 belongs to the lowest bin).  Row by row, without key or join:
    the row itself rides along as a struct beside the features."""
    columns = [c for c in st.columns if c not in ("default_probability", "risk_segment")]
    filled = st.select(
        F.struct(*columns).alias("_row"),
        F.coalesce(F.col("days_past_due"), F.lit(0)).alias("days_past_due"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("initial_amount", "balance")],
    )
    out = model.transform(filled).select("_row.*", vector_to_array("probability")[1].alias("default_probability"))
    return out.withColumn("risk_segment", C.risk_segment(F.col("default_probability"), include_lowest=True))


def labelled(st: DataFrame) -> DataFrame:
    """The scored statement's score beside the label that the model learns."""
    return st.select("document_no", "default_probability", F.when(F.col("days_past_due") > SEVERE_DAYS, F.lit(1)).otherwise(F.lit(0)).alias("label"))


def model_holdout(st: DataFrame, model: PipelineModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Evaluation and calibration of the model on the fifth of the rows that it
    has not learnt from."""
    scored = score_model(st.where(~in_training_split()), model or fit_risk_model(st))
    rows = materialize(labelled(scored))
    return evaluate(rows, "default_probability", "label"), calibration(rows, "default_probability", "label")


def feature_importance(model: PipelineModel) -> DataFrame:
    """Three rows (variable, importance), most important first."""
    forest = model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = [(name, float(v)) for name, v in zip(FEATURES, forest.featureImportances.toArray())]
    schema = StructType([StructField("variable", StringType(), False), StructField("importance", DoubleType(), False)])
    return literal_frame(spark, rows, schema).orderBy(F.desc("importance"))


# --- segmentation --------------------------------------------------------------

SEG_FEATURES = ["avg_days", "balance", "avg_probability"]


def impute_median(df: DataFrame, cols) -> DataFrame:
    """Fill missing values with the exact column median (M5).  The input is
    written once, all medians come from one distributed sort of that copy,
    and the filled result is written once more so that later scalars never
    recompute it.  A column that is missing everywhere has no median: error,
    as in the reference."""
    cols = list(cols)
    base = materialize(df)
    present = base.agg(*[F.count(c).alias(c) for c in cols]).first()
    empty = [c for c in cols if present[c] == 0]
    if empty:
        raise ValueError(f"no value to take a median of in {empty}")
    medians = materialize(exact_medians(base, cols))  # one row per column
    fills = {
        c: F.coalesce(F.col(c).cast("double"), medians.where(F.col("_ci") == i).select("median").scalar())
        for i, c in enumerate(cols)
    }
    return materialize(base.withColumns(fills))


def standardize(df: DataFrame, cols, scales: dict[str, int]) -> DataFrame:
    """(x - mean) / population std, zero std -> 1 (M6).  Mean and std come
    from exact integer power sums of a fixed-point image of x."""
    fields = []
    for c in cols:
        u = fixed_point(F.col(c), scales[c])
        fields += [F.count(u).alias(f"{c}_n"), F.sum(u).cast(WIDE_INT).alias(f"{c}_s1"), F.sum(u * u).cast(WIDE_INT).alias(f"{c}_s2")]
    g = df.agg(*fields).first()  # one row of integers
    out = {}
    for c in cols:
        std, mean = spread_and_centre(g[f"{c}_n"], g[f"{c}_s1"], g[f"{c}_s2"], scales[c], ddof=0)
        out[f"z_{c}"] = (F.col(c) - F.lit(mean).cast("double")) / F.lit(1.0 if std == 0 else std).cast("double")
    return df.withColumns(out)


def imputed_rollup(rollup: DataFrame) -> DataFrame:
    return impute_median(rollup, SEG_FEATURES).select("customer_code", "customer_name", *SEG_FEATURES, "modal_status")


def standardized_rollup(rollup: DataFrame) -> DataFrame:
    imp = imputed_rollup(rollup)
    z = standardize(imp, ["avg_days", "balance"], {"avg_days": 6, "balance": 2})
    return z.select("customer_code", "customer_name", "z_avg_days", "z_balance", "avg_probability", "avg_days", "balance")


def segment_points(rollup: DataFrame) -> DataFrame:
    """What is clustered and drawn: customers with all three values, and the
    point size of each."""
    z = standardized_rollup(rollup).na.drop(subset=["z_avg_days", "z_balance", "avg_probability"])
    return z.withColumn("point_size", F.col("avg_probability") * F.lit(20.0) + F.lit(5.0))


def segment_customers(rollup: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """K-means on (z days, z balance, probability); needs >= k customers.  The
    points are sorted before the fit, so that it starts from the same rows on
    the same settings; cluster ids follow ascending mean days."""
    z = materialize(segment_points(rollup).orderBy("customer_code"))
    if z.limit(k).count() < k:
        raise ValueError(f"not enough customers for {k} clusters")
    vec = VectorAssembler(inputCols=["z_avg_days", "z_balance", "avg_probability"], outputCol="features").transform(z)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="raw_cluster").fit(vec)
    without_summary(model)
    pred = model.transform(vec).drop("features")
    # k rows: relabel clusters by ascending mean days (bounded single-partition window)
    order = pred.groupBy("raw_cluster").agg(F.avg("z_avg_days").alias("_m"))
    order = order.withColumn("cluster", (F.row_number().over(Window.orderBy("_m", "raw_cluster")) - 1).cast("int"))
    out = pred.join(F.broadcast(order.select("raw_cluster", "cluster")), "raw_cluster")
    return out.select(
        "customer_code",
        "customer_name",
        "cluster",
        "z_avg_days",
        "z_balance",
        "avg_probability",
        "avg_days",
        "balance",
        "point_size",
    )


def cluster_stats(segments: DataFrame) -> DataFrame:
    """Per cluster on unscaled values: mean/std days, total/mean balance,
    mean risk, distinct customers."""
    return segments.groupBy("cluster").agg(
        F.avg("avg_days").alias("avg_days"),
        F.stddev_samp("avg_days").alias("std_days"),
        F.sum("balance").alias("total_balance"),
        F.avg("balance").alias("avg_balance"),
        F.avg("avg_probability").alias("avg_risk"),
        F.count_distinct("customer_code").alias("customers"),
    )
