"""Learned scores on held-out rows, and the pipeline's promises."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtale.llm import chat, compress_quality, queries, toxicity

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")]


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = y.sum()
    return (rank[y == 1].sum() - good * (good - 1) / 2) / (good * (len(y) - good))


def test_held_out_is_crc(spark):
    rows = spark.range(50).select("id", compress_quality.held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_quality(tables):
    docs, labels = tables
    model = compress_quality.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(compress_quality.held_out(F.col("doc_id"), 3, 1)).select("doc_id", "text", "quality")
    out = compress_quality.score_quality(held, model).toPandas()
    assert auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.99
    assert ((out.score >= 0.5) == (out.quality == 1)).mean() > 0.95
    assert abs(out.score.mean() - out.quality.mean()) < 0.05


def test_quality_feature(tables):
    """The only feature is the size difference by the text's size, as the library's own calls give it."""
    import zstandard

    model = compress_quality.fit(*tables)
    texts = [r["text"] for r in tables[0].limit(40).collect()] + [""]
    got = compress_quality.features(texts, model.compressors())
    for t, row in zip(texts, got, strict=True):
        data = (t or "").encode()
        sizes = []
        for d in (model.good, model.bad):
            made = zstandard.ZstdCompressor(level=compress_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(made.compress(data[i : i + compress_quality.BLOCK])) for i in range(0, len(data), compress_quality.BLOCK)))
        x = 10 * (sizes[1] - sizes[0]) / max(1, len(data))
        assert row.tolist() == pytest.approx([1, x, x * x])


def test_toxicity(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(compress_quality.held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "toxic")
    out = toxicity.score_toxicity(held, model).toPandas()
    assert auc(out.score.to_numpy(), out.toxic.to_numpy()) > 0.95
    assert (out.score[out.toxic == 0] >= 0.3).mean() < 0.02
    for hidden, plain in {"1d10t": "idiot", "i d i o t": "idiot", "m.o.r.o.n": "moron", "tr@sh": "trash", "stuuuupid": "stupid", "w0rthl3ss": "worthless", "c l 0 w n": "clown"}.items():
        assert model.restore([f"of {hidden} the"]) == [f"of {plain} the"]
    assert model.restore(["the eronth 2024 of (thing)"]) == ["the eronth 2024 of (thing)"]


def test_chat_sql(spark, same_rows):
    same_rows(queries.QUERIES["op6_chat"](spark, "/root/testdata/sf0.001"), chat.ORACLE)


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data).cache()
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) <= before, name
        before = len(ids)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert out.where(F.length("text") != F.col("n_chars")).count() == 0
            docs = out
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert before > 100
