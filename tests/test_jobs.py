"""Jobs from files: events in order and once, statuses, and results that a killed run leaves alone."""

from collections import defaultdict

from pyspark.sql import functions as F

from loomtale.plans import jobs
from loomtale.plans.narrative import Pipeline
from loomtale.streaming import progress
from loomtale.streaming.store import Events, Results

BOOK = "\n\n".join(f"Then Elena Vargas met Bruno Paz there, in the year {k}. They talked for a long time about the sea and the weather." for k in range(12))


def test_files_to_events_and_results(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for name in ("a.txt", "b.txt"):
        (inbox / name).write_text(BOOK)
    (inbox / "c.txt").write_text("short")
    (inbox / "d.exe").write_text("x")
    card = lambda c: {"main_name": c["canonical_name"], "aliases": [], "description": "", "image_prompt": "", "confidence": "high", "warnings": []}
    answer = '{"characters": [{"local_id": "c", "display_name": "Elena Vargas", "reference_type": "named", "appearance": {"gender": {"value": "f"}}}]}'
    pipeline = Pipeline(extractor=lambda text: answer, generator=card, max_chars=400)
    jobs.serve(spark, str(inbox), out, pipeline).start().awaitTermination(300)
    table = Events(spark, f"{out}/events")
    by = defaultdict(list)
    for r in sorted(table.read().collect(), key=lambda r: (r["ts"], r["pct"] or 0)):
        by[r["job_id"].rsplit("/", 1)[1]].append((r["step"], r["pct"]))
    steps = list(dict.fromkeys(s for s, _ in by["a.txt"]))
    assert steps == list(jobs.STEPS) and by["a.txt"] == by["b.txt"] and by["a.txt"][-1] == ("done", 100)
    extraction = [p for s, p in by["a.txt"] if s == "character_extraction"]
    assert extraction == sorted(extraction) and extraction[-1] == 95 and len(extraction) > 2
    assert [s for s, _ in by["c.txt"]] == ["reading", "error"] == [s for s, _ in by["d.exe"]]
    status = {r["job_id"].rsplit("/", 1)[1]: (r["status"], r["error"]) for r in table.status().collect()}
    assert status == {"a.txt": ("done", None), "b.txt": ("done", None), "c.txt": ("error", "too_short"), "d.exe": ("error", "unsupported")}
    results = Results(spark, f"{out}/results")
    assert sorted(r["main_name"] for r in results.read().collect()) == ["Elena Vargas"] * 2
    # the stream cut at the terminal event reads the same table
    query = progress.stream_until_terminal(table.stream()).writeStream.format("memory").queryName("job_events").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    n = table.read().count()
    assert spark.sql("select * from job_events").count() == n
    # a batch that is played again says nothing twice
    files = spark.read.format("binaryFile").load(str(inbox))
    jobs.run_batch(files, 0, pipeline, table, results)
    assert not table.publish(table.read(), 0, 3) and table.has(0, jobs.LAST) and not table.has(1, 0)
    assert table.read().count() == n and results.read().count() == 2


def test_results_by_version(spark, tmp_path):
    results = Results(spark, str(tmp_path / "r"), files=2)
    assert results.read() is None
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, card string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    read = lambda: sorted(map(str, (tuple(r) for r in results.read().collect())))
    results.write(rows((1, "a"), (1, "b"), (2, "c"), (None, "n")), ids(1, 2, None))
    results.write(rows((1, "A")), ids(1, 3), "second")
    assert read() == sorted(["(1, 'A')", "(2, 'c')", "(None, 'n')"])
    assert not results.write(rows((1, "x")), ids(1), "second") and read() == sorted(["(1, 'A')", "(2, 'c')", "(None, 'n')"])
    # a run that dies before its manifest
    results.store.add(rows((2, "lost")), "third/rows")
    assert "(2, 'c')" in read()
    results.write(rows((None, "m")), ids(None, 2))  # nothing is left of document 2
    assert read() == sorted(["(1, 'A')", "(None, 'm')"])
    results.compact()
    assert read() == sorted(["(1, 'A')", "(None, 'm')"]) and len(results._last()[1]) == 1
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("card"))
    results.write(many, many, "many")
    assert len(list((tmp_path / "r" / "many" / "rows").glob("*.parquet"))) <= 2
