"""The columns that the queries promise, computed again in plain Python at sf0.001."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from loomtale.llm import common, near_dedup, queries
from loomtale.llm.oracles import ORACLE_SQL

DATA = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_op2(spark, texts, lib):
    for r in queries.op2_sentencepiece(spark, DATA).collect():
        ids = [*lib.encode(texts[r["doc_id"]]), lib.eos_id()]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(lib.decode(ids).encode()))


def test_op9(spark, texts, lib):
    for r in queries.op9_token_counts(spark, DATA).collect():
        n = len(lib.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_op10(spark, texts):
    seen, expected = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        expected[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op10_phrase_dedup(spark, DATA).collect()} == expected


@pytest.mark.parametrize(("query", "modulus", "remainder", "bar"), [("op1_toxicity", 4, 2, 0.3), ("op8_compress_quality", 3, 1, 0.5)])
def test_scores(spark, texts, query, modulus, remainder, bar):
    rows = queries.QUERIES[query](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= bar)


@pytest.mark.parametrize("name", ["op4_host_quality", "op5_decontamination"])
def test_sql(spark, same_rows, name):
    same_rows(queries.QUERIES[name](spark, DATA), ORACLE_SQL[name])


def test_run_is_its_stages(spark, texts, lib):
    """Each stage's promise, on the rows that the whole pipeline gives."""
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    kept = {i for i, k in con.sql(f"select doc_id, kept from ({ORACLE_SQL['op4_host_quality']})").fetchall() if k}
    assert set(rows) <= kept and len(rows) > 0.8 * len(kept)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(common.F.col("doc_id").isin(sorted(kept)))
    firsts = {r["doc_id"] for r in near_dedup.near_duplicates(docs).where("first").collect()}
    assert set(rows) <= firsts and len(firsts - set(rows)) < 5
    seen = Counter()
    for i in sorted(rows):
        text = lib.decode(list(rows[i]["ids"]))
        assert rows[i]["n_tokens"] == len(rows[i]["ids"]) and rows[i]["ids"][-1] == lib.eos_id()
        b = text.encode()
        grams = {b[p : p + 112] for p in range(0, len(b) - 111, 7)}  # a cut joins what wasn't side by side
        assert not any(seen[g] for g in grams if g in texts[i].encode()), i
        seen.update({b[p : p + 112] for p in range(len(b) - 111)})


def test_near_duplicates_recall(spark):
    """All pairs at sf0.01, by an inverted index of shingles, against the classes: no link between texts is lost."""
    data = "/root/testdata/sf0.01"
    rows = near_dedup.near_duplicates(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "text").collect()
    import numpy as np

    sets, of = {}, {r["doc_id"]: r["class_id"] for r in rows}
    holders = {}
    for r in rows:
        _, h, w, _ = near_dedup.shingles([(r["text"] or "").encode()])
        sets[r["doc_id"]] = (h, w.astype(float))
        for x in h.tolist():
            holders.setdefault(x, []).append(r["doc_id"])
    shared = Counter((a, b) for ids in holders.values() if len(ids) > 1 for k, a in enumerate(ids) for b in ids[:k])
    up = {i: i for i in of}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if 3 * n >= min(len(sets[a][0]), len(sets[b][0])) and near_dedup.probability_jaccard(sets[a], sets[b]) >= 0.8 - near_dedup.NEAR:
            up[max(top(a), top(b))] = min(top(a), top(b))
    assert np.mean([of[i] == top(i) for i in of]) == 1.0
