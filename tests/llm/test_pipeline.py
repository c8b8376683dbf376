"""Packing round trips and the pipeline."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import packing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def whole(rows):
    """Documents and windows are both gapless; windows are full powers of two. Returns ids by document row."""
    docs, windows = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
    for ps in windows.values():
        ps.sort(key=lambda r: r.offset)
        assert [r.offset for r in ps] == [0, *np.cumsum([r.length for r in ps])[:-1].tolist()]
        total = sum(r.length for r in ps)
        assert total == ps[0].tier <= 2048 and total & (total - 1) == 0
    out = {}
    for d, ps in docs.items():
        ps.sort(key=lambda r: r.start)
        out[d] = np.frombuffer(b"".join(r.ids for r in ps), "<u4").tolist()
        assert [r.start for r in ps] == [0, *np.cumsum([r.length for r in ps])[:-1].tolist()] and len(out[d]) == ps[0].doc_tokens
    return out


def test_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = whole(packing.pack(docs).collect())
    assert got == {r.doc_id: ids_of(tokenizer, r.text) for r in docs.collect()}


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b", "a \nb", "\n\n a\t b", "x  y", "a\x1c b", "don't I'll", "3.14 km², ½", "日本 語", "<|endoftext|> x", "a<|endoftext|><|endoftext|>  b <|endoftext", "a" * 9000, " ", "\n"])
def test_encoder_equals_the_tokenizer(tokenizer, text):
    got = packing.encoder("byte_bpe_50k.tiktoken").encode(text)
    assert [*np.frombuffer(got, "<u4"), 1] == ids_of(tokenizer, text)


def test_packing_edges(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "word " * 30000), (None, "no id"), (4, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("x"), "ids": F.lit(1)})
    got = whole(packing.pack(df).collect())
    assert got[1] == got[2] == [1] and got[3] == ids_of(tokenizer, rows[2][1]) and got[None] == ids_of(tokenizer, "no id") and got[4] == got[5]
    assert packing.pack(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, tiers=(100, 2048))


def test_special_tokens_are_those_of_the_vocabulary(tokenizer):
    assert packing.SPECIAL == {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


def test_a_very_long_document_is_cut_without_copying_its_rest():
    packer = packing.Packer()
    start = time.perf_counter()
    packer.add(1, bytes(4 * (16_000_000 + 5)))
    assert time.perf_counter() - start < 5 and len(packer.closed) == 16_000_005 // 2048
    assert sum(len(w) for ws in packer.waiting for w in ws) + 2048 * len(packer.closed) == 16_000_005
    assert all(isinstance(w.ids, bytes) for ws in packer.waiting for w in ws)


def test_tiers_and_groups():
    packer = packing.Packer(pool=16)
    rng = np.random.default_rng(0)
    for i in range(300):
        packer.add(i, bytes(4 * int(rng.integers(1, 5000))))
    closed = len(packer.closed)
    assert {size for size, _ in packer.closed} <= set(packing.TIERS)
    groups = packing.step_groups(packer.closed[:64], 8)
    cost = [sum(sum(len(p) ** 2 for p in ps) for (_, ps), g in zip(packer.closed, groups) if g == k) for k in range(8)]
    assert max(cost) < 1.5 * min(cost)
    packer.finish()
    assert len(packer.closed) - closed < 200 and not any(packer.waiting)


def test_pipeline_stages(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "", None, None, None), (90003, "12 34", "en", "s", 5), (None, "the of and to in is that for it was on are with as be", "en", "s", 3)], docs.schema)
    docs = docs.union(odd).withColumns({"fingerprint": F.lit(1), "digest": F.lit("x"), "hash": F.lit(2)})
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, before.schema)
        assert docs.columns == before.columns
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100 and sizes[0] - sizes[1] >= 3
    assert not {90001, 90002, 90003} & {r.doc_id for r in docs.collect()}
    assert len({r.doc_id for r in docs.collect()}) == docs.count()
    got = whole(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect())
    assert got == {r.doc_id: ids_of(tokenizer, r.text) for r in docs.collect()}


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
