"""The labelled sample is bounded in rows, however often a doc_id repeats."""

from loomtale.llm.compress_quality import labelled_sample


def test_one_row_for_each_id(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(6) for k in range(50)] + [(0, "x" * 100), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    sample = lambda d: labelled_sample(d, labels, "quality", 2, 50, 1, 1)
    rows, share = sample(docs)
    assert len(rows) == 4 and sorted(y for _, y in rows) == [0, 0, 1, 1] and share == 0.5
    assert len({t.split()[1] for t, _ in rows}) == 4 and all(int(t.split()[1]) % 2 == y for t, y in rows)
    assert sample(docs.orderBy(docs.text.desc()).repartition(3))[0] == rows
