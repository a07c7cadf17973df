import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from dunning.llm import decontaminate, sentencepieces
from dunning.llm.queries import QUERIES

from .test_simhash import brute_fingerprint, brute_roots

D = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        before = docs
        step(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
        kept.append((before.collect(), docs.collect()))

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows, left = kept[0]
    left = {r.doc_id for r in left}
    right = [(r.doc_id in left) == (labels[r.doc_id] == 1) for r in rows if r.doc_id in labels]
    assert sum(right) / len(right) > 0.95

    rows, left = kept[1]
    first = {}
    for r in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in left} == set(first.values())

    rows, left = kept[2]
    rows = sorted(rows)
    roots = brute_roots([brute_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in left) == sorted({rows[i].doc_id for i in roots})

    rows, left = kept[3]
    items = [f" {' '.join(r.text.lower().split())} " for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    verbatim = {r.doc_id for r in rows if any(x in f" {' '.join(r.text.lower().split())} " for x in items)}
    gone = {r.doc_id for r in rows} - {r.doc_id for r in left}
    assert verbatim <= gone and len(gone) <= len(verbatim) + 3

    rows, left = kept[4]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in left)
    assert all(r.round_trip and r.parity and len(r.ids) == r.n_tokens for r in left)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 11))


def test_a_worker_takes_texts_in_small_pieces(spark, monkeypatch):
    rng = random.Random(2)
    names = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(5000)]
    texts = [" ".join(rng.choices(names, k=300)) for _ in range(3000)]  # 5 MB
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(texts)), pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["file", "row", "id", "text"])
    table = np.zeros(1 << 20, np.uint8)
    table[0] = 3
    needs = type("Needs", (), {"value": table.tobytes()})
    docs = spark.createDataFrame([], "doc_id long, text string")
    seen = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.setdefault("run", run))
    decontaminate.passages(docs.selectExpr("'f' file", "0L row", "struct(doc_id id, text) doc"), "text", [2, 3], 40, needs)
    run = seen.pop("run")
    tracemalloc.start()
    list(run([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6

    codec = sentencepieces.Codec(open(sentencepieces.public_model(), "rb").read())
    assert "full" not in vars(codec)  # this model needs no second tokenizer
    sizes = []
    plain = codec.encode
    monkeypatch.setattr(codec, "encode", lambda some: sizes.append(sum(map(len, some))) or plain(some))
    monkeypatch.setattr(sentencepieces, "codec_of", lambda data, threads: codec)
    sentencepieces.sentencepiece_ids(docs, sentencepieces.public_model())
    n = sum(b.num_rows for b in seen["run"]([batch.select(["id", "text"])]))
    assert n == len(texts) and sum(sizes) == sum(map(len, texts)) and max(sizes) <= 256 << 10
