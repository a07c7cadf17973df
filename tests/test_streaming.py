"""Landed-file ingest appends each file exactly once across reruns."""

from dunning.sources import sinks
from dunning.sources import tpch_fixture as fx
from dunning.streaming.landing import ingest_landed

SF = "/root/testdata/sf0.001"


def test_ingest_is_incremental_and_exactly_once(spark, tmp_path):
    raw = fx.statement_raw(spark, SF)
    cols = raw.columns
    land, table, ckpt = str(tmp_path / "land"), str(tmp_path / "table"), str(tmp_path / "ckpt")
    first = raw.where("CAST(document_no AS BIGINT) % 2 = 0")
    second = raw.where("CAST(document_no AS BIGINT) % 2 = 1")
    import glob
    import os
    import shutil

    os.makedirs(land)

    def land_batch(df, tag):
        # write part files to a staging folder, then drop them into the landing folder
        stage = str(tmp_path / f"stage-{tag}")
        sinks.write_csv(df, stage, mode="overwrite")
        for i, f in enumerate(sorted(glob.glob(f"{stage}/part-*.csv"))):
            shutil.copy(f, f"{land}/{tag}-{i}.csv")

    land_batch(first, "batch1")
    n1 = ingest_landed(spark, land, table, ckpt, cols)
    assert n1 == first.count()
    assert ingest_landed(spark, land, table, ckpt, cols) == 0  # nothing new
    land_batch(second, "batch2")
    ingest_landed(spark, land, table, ckpt, cols)
    out = spark.read.parquet(table)
    assert out.count() == raw.count()
    assert out.select("document_no").distinct().count() == raw.count()
    assert dict(out.dtypes)["balance"] == "double" and dict(out.dtypes)["invoice_date"] == "date"
    assert os.path.isdir(ckpt)
