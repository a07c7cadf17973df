"""Session helpers: a configured local session for tests/bench, and the shared
folder used for intermediate tables and exports.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dunning", **settings: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config(map=settings)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root of the cluster-shared scratch area: ``spark.checkpoint.dir``.

    Only a master whose tasks run in the driver's own process (``local`` or
    ``local[...]``, not ``local-cluster``) may do without the setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared scratch area."""
    return f"{shared_dir(spark)}/dunning-out/{name}-{uuid.uuid4().hex[:12]}"


_WRITTEN: list[tuple[str, str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the
    files: later reads prune columns and push filters into them instead of
    recomputing the joins above, and a lost executor cannot change them."""
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """:func:`materialize` as a table of sorted buckets by ``key``: later joins
    and aggregations by ``key`` need no exchange.  Each task writes what it
    holds of a bucket to a file of its own, so deal ``df`` by ``key`` before."""
    spark = df.sparkSession
    path = scratch_path(spark, "buckets")
    table = "dunning_" + path.rsplit("-", 1)[1]
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def bucket_count(df: DataFrame, key: str) -> int | None:
    """The number of buckets by ``key`` in which all of ``df``'s tables lie."""
    found = set()
    for leaf in df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").splitlines():
        name = leaf.split("Relation ")[1].split("[")[0].rsplit(".", 1)[-1] if leaf.startswith("Relation ") else ""
        if not name.startswith("dunning_"):
            return None
        about = {r.col_name: r.data_type for r in df.sparkSession.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        if about.get("Bucket Columns") != f"[`{key}`]":
            return None
        found.add(int(about["Num Buckets"]))
    return found.pop() if len(found) == 1 else None


def materialize_by(df: DataFrame, key: str) -> DataFrame:
    """:func:`materialize`; in buckets if ``df`` comes from tables that are
    bucketed by ``key`` alone, so that the layout is not lost on the way."""
    buckets = bucket_count(df, key)
    return bucketed(df, buckets, key) if buckets else materialize(df)


def written(spark: SparkSession) -> list[str]:
    """Folders that :func:`materialize` wrote in this application so far."""
    return [path for app, path in _WRITTEN if app == spark.sparkContext.applicationId]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that :func:`materialize` wrote, once nothing reads them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if "/buckets-" in path:
            spark.sql(f"DROP TABLE IF EXISTS dunning_{path.rsplit('-', 1)[1]}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _WRITTEN.remove((spark.sparkContext.applicationId, path))
