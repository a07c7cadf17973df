import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dunning.llm.eliasfano import EliasFano
from dunning.llm.sentencepieces import SPACE, Codec, backend, parse, public_model, sentencepiece_ids
from dunning.llm.tokenfiles import BytePairCodec, Shard, dump_shard, op4_token_files, read_token_files, write_token_files

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=700), st.sampled_from([1, 10, 1 << 20]))
def test_elias_fano_gives_back_every_value(values, scale):
    values = sorted(v // scale for v in values)
    data = b"xx" + EliasFano.of(np.array(values, np.uint64)).dumps() if not values or values[-1] - values[0] < (1 << 40) * max(1, len(values)) else None
    code = EliasFano.of(np.array(values, np.uint64)) if data is None else EliasFano.loads(data, 2)[0]
    assert code.all().tolist() == values
    assert [code[i] for i in range(len(code))] == values


def test_elias_fano_takes_little_space():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000)).astype(np.uint64)
    assert len(EliasFano.of(ends).dumps()) * 8 < len(ends) * (2 + np.log2(1000) + 1)


def texts():
    rng = random.Random(5)
    blanks = [" ", " ", " ", "  ", "\n", "\n ", " \n", "\t", " ", "   ", "   "]
    words = ["the", "don't", "x1y2", "été", "日本語", "!!", "<|endoftext|>", "12,5", "🙂", "́a", "'s", "▁", "a▁b", "<s>", "\x00"]
    return ["".join(rng.choice(blanks) + rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice(["", " ", "  ", "\n"]) for _ in range(300)]


def test_chunks_encode_like_whole_texts():
    with open(BPE, encoding="utf-8") as f:
        codec = BytePairCodec(f.read())
    for t, ids in zip(texts(), codec.encode(texts()), strict=True):
        assert ids.tolist() == codec.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
        assert "".join(codec.chunks(t)) == t


def test_shard_without_and_with_repeated_ids():
    docs = [np.arange(n, dtype=np.uint16) for n in (0, 5, 1, 300)]
    shard = Shard(dump_shard([-4, 7, 7, None], docs, np.uint16))
    assert shard.doc_ids() == [-4, 7, 7, None]
    assert [shard[i].tolist() for i in range(len(shard))] == [d.tolist() for d in docs]
    assert len(Shard(dump_shard([], [], np.uint16))) == 0


def test_token_files(spark):
    rows = [(i * 3 - 20, t, i) for i, t in enumerate(texts()[:120])] + [(None, "no id", 1), (4, None, 2), (4, "", 3), (4, "again", 4), (900, "long text " * 20_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(7)
    manifest = write_token_files(docs, BPE, shard_ids=500)
    assert manifest.count() > 5
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows if r[0] is not None) + [None]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    wanted = sorted((str(i), len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == wanted


def test_special_tokens_in_a_text_get_the_ids_of_the_file():
    with open(BPE, encoding="utf-8") as f:
        codec = BytePairCodec(f.read(), special_as_text=False)
    untouched = Tokenizer.from_file(BPE)
    some = texts() + ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>", " <|endoftext|><|endoftext|>\n <|endoftext|> "]
    for t, ids in zip(some, codec.encode(some), strict=True):
        assert ids.tolist() == untouched.encode(t, add_special_tokens=False).ids, repr(t)
    assert codec.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


def test_the_query_takes_the_tokenizer_file_as_it_is(spark, tmp_path):
    some = ["a <|endoftext|> b", "plain", None]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    untouched = Tokenizer.from_file(BPE)
    ids = [np.array([*untouched.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in some]
    got = sorted(op4_token_files(spark, str(tmp_path)).collect())
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]


def test_token_files_of_an_empty_table(spark):
    assert read_token_files(write_token_files(spark.createDataFrame([], "doc_id long, text string"), BPE)).count() == 0


# --- SentencePiece ------------------------------------------------------------


def test_bpe_model_equals_the_library():
    with open(public_model(), "rb") as f:
        codec = Codec(f.read())
    for t, ids in zip(texts(), codec.encode(texts()), strict=True):
        assert ids.tolist() == codec.oracle.encode(t), repr(t)
        assert codec.decode(ids.tolist()) == t.replace(SPACE, " ")
        assert codec.full.encode(t, add_special_tokens=False).ids == ids.tolist()
    assert not codec.wrong and codec.chunked


def model(kind, pieces, **normaliser):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(n, v):
        if isinstance(v, int):
            return varint(n << 3) + varint(v)
        if isinstance(v, float):
            return varint(n << 3 | 5) + np.float32(v).tobytes()
        return varint(n << 3 | 2) + varint(len(v)) + v

    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, kind) + field(35, 1) + field(40, 0))
    return out + field(3, field(1, b"identity") + field(3, normaliser.get("prefix", 1)) + field(4, normaliser.get("trim", 0)))


UNIGRAM = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)]] + [
    (p, -i / 2 - 1, 1) for i, p in enumerate([SPACE, SPACE + "the", "th", "e", "t", "h", SPACE + "a", "a", "b", "ab", SPACE + "ab", "he", "bb"])
]


@pytest.mark.parametrize("trim", [0, 1])
def test_unigram_model_equals_the_library(trim):
    codec = Codec(model(1, UNIGRAM, trim=trim))
    rng = random.Random(2)
    some = ["".join(rng.choices(["the", "ab", "b", " ", "a", "é", "  "], k=rng.randint(0, 30))) for _ in range(200)]
    for t, ids in zip(some, codec.encode(some), strict=True):
        assert ids.tolist() == codec.oracle.encode(t), repr(t)


def test_parse_reads_scores_types_and_switches():
    spec = parse(model(1, UNIGRAM, prefix=0, trim=1))
    assert (spec.model, spec.byte_fallback, spec.dummy_prefix, spec.trim_blanks) == (1, True, False, True)
    assert spec.pieces[-1] == ("bb", -7.0, 1)
    assert backend(spec, whole=False).get_vocab_size() == len(UNIGRAM)
    with pytest.raises(ValueError):
        parse(model(3, UNIGRAM))


def test_sentencepiece_rows(spark):
    rows = [(1, "The cat", "x"), (1, "The cat", "x"), (None, None, "y"), (2, "", "z"), (3, "été " * 30_000, "q"), *((10 + i, t, "w") for i, t in enumerate(texts()[:50]))]
    got = sentencepiece_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string"), public_model()).collect()
    with open(public_model(), "rb") as f:
        library = Codec(f.read()).oracle
    assert all(r.round_trip and r.parity and r.n_tokens == len(r.ids) for r in got)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), library.encode(t or "")) for i, t, _ in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert sentencepiece_ids(spark.createDataFrame([], "doc_id long, text string"), public_model()).count() == 0


def test_stretches_are_read_through_select():
    rng = random.Random(8)
    for values in (sorted(rng.randrange(10**6) for _ in range(2000)), [5] * 700, [0], list(range(0, 10**12, 10**9)), []):
        code = EliasFano.loads(EliasFano.of(np.array(values, np.uint64)).dumps())[0]
        for _ in range(40):
            i = rng.randint(0, len(values))
            j = rng.randint(i, len(values))
            assert code.some(i, j).tolist() == values[i:j]


@pytest.mark.parametrize("prefix, trim", [(0, 0), (0, 1), (1, 1)])
def test_parity_of_models_that_do_not_work_by_chunk(prefix, trim):
    codec = Codec(model(1, UNIGRAM, prefix=prefix, trim=trim))
    assert not codec.by_chunk
    some = ["the ab", " ab  b", "", "é the"]
    ids = codec.encode(some)
    assert codec.parity == [x.tolist() == codec.oracle.encode(t) for x, t in zip(ids, some, strict=True)]


def test_decoded_text_comes_along(spark):
    rows = [(1, "The cat"), (2, " two  blanks "), (3, None)]
    got = {r.doc_id: r.decoded for r in sentencepiece_ids(spark.createDataFrame(rows, "doc_id long, text string"), public_model()).collect()}
    assert got == {1: "The cat", 2: " two  blanks ", 3: ""}


def test_a_worker_keeps_a_bounded_number_of_pieces(monkeypatch):
    from dunning.llm import sentencepieces

    with open(sentencepieces.public_model(), "rb") as f:
        data = f.read()
    texts = [" ".join(f"word{i}" for i in range(at, at + 40)) for at in range(0, 400, 20)]
    wanted = [x.tolist() for x in sentencepieces.Codec(data).encode(texts)]
    monkeypatch.setattr(sentencepieces, "KEPT_PIECES", 50)
    codec = sentencepieces.Codec(data)
    assert [x.tolist() for t in texts for x in codec.encode([t])] == wanted
    assert len(codec.known) <= 50
