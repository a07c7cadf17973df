"""Exact duplicates by stateful streaming (operator 10).

Each document becomes an *arrival*: digest of its normalised text, id and
content locator (file, row).  A Structured Streaming query groups arrivals by
digest; its state lives in RocksDB on the executors' disks, is checkpointed to
the shared folder and never expires, so later runs of the same stream still
recognise texts seen before.  The state is read back with Spark's state reader.
Rows that hit a digest already held are compared byte for byte with the text
at the locator that the state retains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, column, new_folder, read_table, stage, unwrapped, with_location

by_value(__name__)

#: Members of a group that share one copy of its keeper's text in the check.
SPREAD = 512
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def arrivals_of(docs: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column]) -> DataFrame:
    body = normalised(column_of(text))
    return docs.select(digest(body).alias("digest"), F.sha2(body.cast("binary"), 256).alias("sha"), column_of(doc_id).alias("id"), "file", "row")


def column_of(name: str) -> Column:
    return F.col("doc")[name]


def first_seen(arrivals: DataFrame, path: str, checkpoint: str | None = None, most_bytes: int = 64 << 30) -> DataFrame:
    """The stream's state after all arrivals under ``path``: for each digest
    the smallest id with its locator, and the number of rows.  With the
    ``checkpoint`` of an earlier run only files added to ``path`` since are
    read, and they meet the state of all before."""
    spark = arrivals.sparkSession
    session = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # else every open state file takes megabytes ahead of its contents
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.session.timeZone": "UTC",
    }.items():
        session.conf.set(key, value)
    checkpoint = checkpoint or new_folder(spark, "dedup-state")
    keeper = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    if arrivals.isEmpty():
        return arrivals.groupBy("digest").agg(F.min(keeper).alias("keeper"), F.count(F.lit(1)).alias("size"))
    query = (
        session.readStream.schema(arrivals.schema)
        .option("maxBytesPerTrigger", str(most_bytes))
        .parquet(path)
        .groupBy("digest")
        .agg(F.min(keeper).alias("keeper"), F.count(F.lit(1)).alias("size"))
        .writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    kept, size = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), F.col(kept).alias("keeper"), F.col(size).alias("size"))


def exact_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row for each row of ``docs``: file, row, id, sha, keep_id,
    group_size, kept.

    Texts are equal when identical after each run of blanks became one space;
    null is the empty text.  Of equal texts the row with the smallest id stays
    (a null id counts as largest; among equal ids the first location), so
    exactly one row of a group is kept, repeated rows included.  An empty table
    gives no rows.  Rows whose digests agree but whose bytes differ form
    groups of their own.
    """
    return groups_of(with_location(docs.select(column(docs, doc_id), column(docs, text))), text, doc_id, digest)


def groups_of(located: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column]) -> DataFrame:
    spark = located.sparkSession
    arrivals = arrivals_of(located, text, doc_id, digest)
    path = new_folder(spark, "arrivals")
    arrivals.write.parquet(path)
    arrivals = spark.read.schema(arrivals.schema).parquet(path)
    state = stage(first_seen(arrivals, path), "dedup-groups")

    # full bytes of the rows that hit a digest held by another row
    hits = arrivals.join(state.filter("size > 1"), "digest").select(
        "digest", "file", "row", "id", F.col("keeper.file").alias("at_file"), F.col("keeper.row").alias("at_row"), "size"
    )
    bodies = stage(
        located.select("file", "row", normalised(column_of(text)).alias("body")).join(hits, ["file", "row"]), "dedup-hits"
    )
    is_keeper = (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))
    salts = F.ceil(F.col("size") / F.lit(SPREAD)).cast("int")
    keepers = bodies.filter(is_keeper).select(
        "at_file", "at_row", F.col("body").alias("held"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    members = bodies.filter(~is_keeper).withColumn("salt", F.pmod(F.xxhash64("file", "row"), salts).cast("int"))
    differ = members.join(keepers, ["at_file", "at_row", "salt"]).filter("body != held").select("digest", "file", "row", "id", "body")
    differ = stage(differ, "dedup-differ")

    rows = arrivals.join(state, "digest")
    if not differ.isEmpty():
        own = differ.groupBy("digest", "body").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")).alias("own"), F.count(F.lit(1)).alias("own_size")
        )
        fixed = differ.join(own, ["digest", "body"]).select("file", "row", "own", "own_size")
        gone = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
        rows = (
            rows.join(fixed, ["file", "row"], "left")
            .join(gone, "digest", "left")
            .withColumn("size", F.coalesce("own_size", F.col("size") - F.coalesce("gone", F.lit(0))))
            .withColumn("keeper", F.coalesce("own", "keeper"))
        )
    return rows.select(
        "file",
        "row",
        "id",
        "sha",
        F.col("keeper.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        ((F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` does not keep; all
    columns and their order stay."""
    located = with_location(docs)
    keep = groups_of(located, text, doc_id, sha256).filter("kept").select("file", "row")
    return unwrapped(located.join(keep, ["file", "row"], "left_semi"), docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )
