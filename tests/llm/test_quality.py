import zlib

import numpy as np
from pyspark.sql import functions as F

from dunning.llm.quality import FEATURES, features, keep_quality, op3_quality, quality_scores

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op3_quality(spark, D).collect()}
    labels = spark.read.parquet(f"{D}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    out = [(got[x.doc_id].predicted, x.quality) for x in labels if got[x.doc_id].held_out]
    assert np.mean([a == b for a, b in out]) > 0.95
    assert np.mean([a for a, b in out if b == 1]) > 0.95


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda d, x: {r.doc_id: r.score for r in quality_scores(d, x).collect()}
    assert score(docs, labels) == score(docs.withColumn("lang", F.lit("x")).drop("source").repartition(3), flipped)


def test_edge_rows(spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    odd = [(None, "plain words here"), (-1, None), (-2, ""), (-3, "word " * 50_000), (-3, "word " * 50_000), (-4, "$$$ ### %%%" * 50)]
    both = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("x")).withColumn("x", F.lit(None).cast("int"))
    more = labels.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (-1, None), (0, 1)], "doc_id long, quality int"))
    got = quality_scores(both, more).collect()
    assert len(got) == docs.count() + len(odd)
    kept = keep_quality(both, more)
    assert kept.columns == ["doc_id", "text", "score", "x"]
    assert kept.filter("doc_id = -4").count() == 0


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_scores(docs, none).collect()] == [0.5, 0.5]
    assert keep_quality(docs, none).count() == 2
    some = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert quality_scores(docs.limit(0), some).count() == 0


def test_features_of_any_bytes():
    assert features(b"").tolist() == [0.0] * FEATURES
    assert np.isfinite(features("\x00 é ! a\n\n".encode() * 999)).all()


def test_a_hot_id_sends_one_row_to_the_driver(spark, monkeypatch):
    """A third of all rows under one id: training fetches it once."""
    from dunning.llm import quality

    rows = [(i if i % 3 else 0, f"plain words of number {i} and some more") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 900, 3)] + [(i, 1) for i in range(1, 200, 3)], "doc_id long, quality int")
    fetched = []
    monkeypatch.setattr(quality, "fit", lambda p, u, c, y: fetched.append((len(p), len(u), len(c))))
    quality.train(docs, labels)
    ids = {i for i, _ in rows}
    assert fetched[0][1] == len(ids) < 700
    quality.train(docs, labels, most=50)
    assert max(fetched[1]) <= 50
