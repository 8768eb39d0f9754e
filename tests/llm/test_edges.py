"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtale.llm import chat, compress_quality, decontam, host_quality, near_dedup, phrase_dedup, sentence_dedup, sp_codec, token_counts, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 700} other{i}" for i in range(20_000)) + "."
SHORT = "A short text. It has a few words in it. And then it ends here."
CLASHING = ["n_words", "Score", "KEPT", "IDS", "decoded", "Restored", "removed", "Class_Id", "first", "class_size", "N_TOKENS", "hit_items", "Cleaned", "n_sentences", "host_rate", "base_failed", "__host", "__spans", "__class", "__id", "id", "k", "node", "host", "w1", "spans", "c0", "c3", "a`b", "x.y", "x y", "item", "part", "counted"]
#: Of those, what an operator's results replace, by operator, in lower case.
RESULTS = {
    "encode": {"ids", "decoded"}, "count": {"n_tokens"}, "judge": {"n_words", "base_failed", "host_rate", "kept"}, "decontaminate": {"n_words", "hit_items", "cleaned"},
    "sentences": {"n_sentences", "kept"}, "phrases": {"removed", "kept"}, "near": {"class_id", "class_size", "first"}, "quality": {"score"}, "toxicity": {"restored", "score"},
}
ROWS = [(1, SHORT, "a"), (1, SHORT, "a"), (2, None, "a"), (3, "", None), (None, SHORT + " More of it.", "b"), (4, LONG, "b"), (5, "  \n\t ", "b"), (6, "ß é 日本 😀 \x00", "b"), (1, "another text of the same number", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return base.select("*", *[F.lit(f"user's {c}").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(7, "It has a few words"), (7, "It has a few words"), (8, None), (9, ""), (None, "other5 word6 other6")], "item_id long, text string")


OPERATORS = {
    "encode": lambda d, labels, bench: sp_codec.encode_decode(d, PIECES),
    "count": lambda d, labels, bench: token_counts.count_tokens(d, PIECES),
    "judge": lambda d, labels, bench: host_quality.judge(d),
    "decontaminate": lambda d, labels, bench: decontam.decontaminate(d, bench, cleaned="cleaned"),
    "sentences": lambda d, labels, bench: sentence_dedup.drop_repeated_sentences(d),
    "phrases": lambda d, labels, bench: phrase_dedup.drop_repeats(d),
    "near": lambda d, labels, bench: near_dedup.near_duplicates(d),
    "quality": lambda d, labels, bench: compress_quality.score_quality(d, compress_quality.fit(d, labels)),
    "toxicity": lambda d, labels, bench: toxicity.score_toxicity(d, toxicity.fit(d, labels)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_place(name, docs, labels, benchmark):
    rows = OPERATORS[name](docs, labels, benchmark).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i is None, i or 0, t or "") for i, t, _ in ROWS)
    twins = [tuple(r[c] for c in r.asDict() if c != "first") for r in rows if r["doc_id"] == 1 and r["text"] == SHORT]
    assert twins[0] == twins[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_stay_as_they_are(name, docs, labels, benchmark):
    out = OPERATORS[name](docs, labels, benchmark)
    low = [c.lower() for c in out.columns]
    assert len(set(low)) == len(low)
    others = [c for c in CLASHING if c.lower() not in RESULTS[name]]
    assert [c for c in out.columns if c in others] == others
    assert RESULTS[name] <= {c for c in out.columns if c not in others}
    rows = out.toDF(*[f"n{i}" for i in range(len(out.columns))]).collect()
    assert all(r[f"n{out.columns.index(c)}"] == f"user's {c}" for r in rows for c in others)


@pytest.mark.parametrize("name", ["sentences", "phrases", "near"])
def test_ids_that_are_no_integers_are_refused(name, docs):
    with pytest.raises(TypeError, match="doc_id must be an integer"):
        OPERATORS[name](docs.withColumn("doc_id", F.col("doc_id").cast("string")), None, None)


def test_a_missing_column_is_named(docs):
    with pytest.raises(ValueError, match="no column body"):
        sp_codec.encode_decode(docs, PIECES, text="body")


STAGE_ROWS = [(1, SHORT + " " + LONG[:400], "en", "h", 3), (1, SHORT + " " + LONG[:400], "en", "h", 3), (2, None, None, None, None), (3, "", "en", "h", 0), (None, " ".join(f"z{i}" for i in range(60)), "en", None, 9), (4, LONG, None, "h", 1), (5, " ".join(f"q{i}" for i in range(40)) + " It has a few words", "en", "g", 2)]


@pytest.mark.parametrize(("k", "ids"), [(0, [None, 1, 1, 4, 5]), (1, [None, 1, 2, 3, 4, 5]), (2, [None, 1, 1, 4, 5]), (3, [None, 1, 1, 2, 3, 4, 5]), (4, [None, 1, 1, 2, 3, 4, 5])])
def test_stages_on_odd_rows(k, ids, spark, benchmark, tmp_path):
    import corpus_pipeline

    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    base = spark.createDataFrame(STAGE_ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = base.select("*", *[F.lit(1).alias(c) for c in ["TEXT", "kept", "Source", "ids", "first", "cleaned", "a`b", "__id", "spans"]])
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, clashing, str(tmp_path))
    assert sorted((r["doc_id"] for r in out.collect()), key=lambda i: (i is not None, i or 0)) == ids
    assert out.columns == (list(corpus_pipeline.COLUMNS) if k < 4 else ["doc_id", "lang", "source", "n_tokens", "ids"])
    assert stage(spark, clashing.limit(0), str(tmp_path)).collect() == []


def test_stages_keep_no_state(spark, tmp_path):
    """A result that hasn't been read outlives the next stage's call."""
    import corpus_pipeline

    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(STAGE_ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    stages = [f for _, f in corpus_pipeline.STAGES]
    first = stages[0](spark, docs, str(tmp_path))
    assert stages[3](spark, docs, str(tmp_path)).count() == 7 and first.count() == 5


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, spark, docs, labels, benchmark):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).collect() == []


def test_no_labels_and_no_items(docs, labels, benchmark):
    assert {r["score"] for r in OPERATORS["quality"](docs, labels.limit(0), None).collect()} == {0.5}
    assert {r["score"] for r in OPERATORS["toxicity"](docs, labels.limit(0), None).collect()} == {0.5}
    assert {r["n_hit"] for r in OPERATORS["decontaminate"](docs, None, benchmark.limit(0)).collect()} == {0}


@pytest.mark.parametrize("operator", [compress_quality, toxicity])
def test_clashes_while_fitting(operator, docs, labels):
    """Labels and documents with further columns that are called as those that are read, in another case."""
    more = [F.lit(7).alias(c) for c in ("DOC_ID", "TEXT", "TOXIC", "Quality", "__label", "count", "n")]
    fitted = operator.fit(docs.select("*", *more[2:]).withColumn("Text ", F.lit(1)), labels.select("*", *more))
    plain = operator.fit(docs.select("doc_id", "text"), labels)
    assert (fitted.share, fitted.beta is None) == (plain.share, plain.beta is None)
    wider = docs.select("doc_id", "text").toDF("doc_id", "text").select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("Doc_Id"))
    assert operator.fit(wider, labels).share == plain.share


def test_defined_results(docs, labels, benchmark):
    by = {(r["doc_id"], r["text"]): r for r in OPERATORS["decontaminate"](docs, None, benchmark).collect()}
    assert by[1, SHORT]["hit_items"] == ["7"] and by[1, SHORT]["n_hit"] == 5
    assert by[4, LONG]["hit_items"] == [""] and by[4, LONG]["n_hit"] == 3
    assert by[2, None]["n_words"] == 0
    near = {(r["doc_id"], r["text"]): r for r in OPERATORS["near"](docs, None, None).collect()}
    assert near[None, SHORT + " More of it."]["class_id"] is None
    assert near[2, None]["class_id"] == 2 and near[3, ""]["class_id"] == 3 and near[5, "  \n\t "]["class_id"] == 5
    assert sum(r["first"] for r in OPERATORS["near"](docs, None, None).collect()) == len({(r["class_id"], r["text"] if r["class_id"] in (2, 3, 5) else r["class_id"] is None or r["text"][:5]) for r in near.values()})


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "<|im_end|>"), (None, 0, "user", "z"), (4, None, "user", "x"), (4, 0, "user", "y")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conv = conv.select("*", *[F.lit(1).alias(c) for c in ("n", "TEXT", "Role", "CONV_ID", "h1", "line", "__kept", "i", "p1", "n_turns", "a`b")])
    out = {r["conv_id"]: r for r in chat.render(conv).collect()}
    assert set(out) == {1, 3, None, 4}
    assert out[1]["n_turns"] == 2 and "unknown" in out[1]["rendered"]
    assert "< |im_end|>" in out[3]["rendered"]
    assert out[4]["rendered"].index("x") < out[4]["rendered"].index("y")
    assert chat.render(conv.limit(0)).collect() == []


def test_chat_long_texts_and_many_turns(spark):
    rows = [(1, k, "user", f"turn {k}") for k in range(3000)] + [(2, k, "user", f"turn {k}") for k in range(2999)] + [(3, 0, "user", LONG * 5), (4, 0, "user", LONG * 5), (4, 1, "assistant", LONG)]
    out = {r["conv_id"]: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {1, 4} and out[1]["n_turns"] == 3000 and len(out[4]["rendered"]) > 6 * len(LONG)
