"""Chunking, scoring, merging, consolidation, retrieval, readers and streams on small inputs."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtale.functions import vocabulary as V
from loomtale.operators import cards, chunking, consolidation, evaluation, extraction, merging, pairing, resolving, retrieval
from loomtale.plans.narrative import Pipeline
from loomtale.sources import readers
from loomtale.streaming import progress


def fold(lengths, most, overlap):
    """The packing said as a loop over paragraphs."""
    out, now = [], [0]
    for i in range(1, len(lengths)):
        if sum(lengths[k] for k in now) + len(now) - 1 + 1 + lengths[i] <= most:
            now.append(i)
        else:
            out.append((now[0], now[-1]))
            now = (now[-overlap:] if overlap else []) + [i]
    return [*out, (now[0], now[-1])]


def test_bounds(spark):
    rng = random.Random(1)
    cases = [([4, 3, 5, 20, 2], 10, 1), ([4] * 5, 10, 3)] + [([rng.randint(1, 9) for _ in range(rng.randint(1, 12))], rng.randint(4, 25), rng.randint(0, 3)) for _ in range(150)]
    assert fold(*cases[0]) == [(0, 1), (1, 2), (2, 3), (3, 4)] and fold(*cases[1]) == [(0, 1), (0, 2), (0, 3), (1, 4)]
    for most, overlap in sorted({(m, k) for _, m, k in cases}):
        same = [n for n, m, k in cases if (m, k) == (most, overlap)]
        rows = spark.createDataFrame([(i, n) for i, n in enumerate(same)], "i int, n array<int>").select("i", chunking.bounds(F.col("n"), most, overlap).alias("b")).collect()
        assert all([tuple(x) for x in r["b"]] == fold(same[r["i"]], most, overlap) for r in rows)
        if most > 12:
            break


def test_chunks(spark):
    df = spark.createDataFrame([(1, "Uno\nCapítulo 1\nA\nCapítulo 2\nB"), (2, "a.\nb.\nc"), (3, " "), (4, None), (5, "x\n\ny")], "doc_id long, text string")
    out = {}
    for r in chunking.chunk(df, max_chars=1, overlap=0).collect():
        out.setdefault(r["doc_id"], []).append(r["chunk_text"])
    assert out == {1: ["Uno", "A", "B"], 2: ["a", "b", "c"], 5: ["x", "y"]}
    with pytest.raises(ValueError, match="positive"):
        chunking.chunk(df, max_chars=0)


def random_cast(n, seed):
    rng = random.Random(seed)
    words = ["ana", "rios", "elena", "vargas", "la", "el", "reina", "roja", "juan", "de", "mago", "hombre"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    return [(1, i, sorted({name() for _ in range(rng.randint(0, 3))} - set(V.DESCRIPTIVE_FORMS)), rng.choice([None, "f", "m"]), rng.choice([None, "old"]), rng.random() < 0.1, [rng.randint(0, 9)]) for i in range(n)]


CAST = "doc_id long, ord int, names array<string>, gender string, age string, conflicted boolean, chunks array<int>"


def test_blocked_scores(spark):
    rows = random_cast(60, 3)
    scored = {(r["a_ord"], r["b_ord"]): r["score"] for r in pairing.score_pairs(spark.createDataFrame(rows, CAST)).collect()}
    as_dict = [dict(zip(("doc_id", "ord", "names", "gender", "age", "conflicted", "chunks"), r, strict=True)) for r in rows]
    for i, a in enumerate(as_dict):
        for j in range(i + 1, len(rows)):
            s = consolidation.pair_score(a, as_dict[j])
            assert s < V.REVIEW or (i, j) in scored  # blocking loses no pair
            if (i, j) in scored:
                assert scored[i, j] == pytest.approx(s), (a, as_dict[j])


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        (dict(names=["elena vargas"]), dict(names=["elena vargas"]), 1.0),
        (dict(names=["elena"], gender="f", chunks=[0]), dict(names=["elena"], gender="f", chunks=[9]), 0.9),
        (dict(names=["elena"], chunks=[0]), dict(names=["elena"], chunks=[1]), 0.85),
        (dict(names=["elena vargas"], gender="f"), dict(names=["elena vargas"], gender="m"), 0.4),
        (dict(names=["rios", "capitana rios"]), dict(names=["ines rios"]), 1.0),
        (dict(names=["ines rios"]), dict(names=["rios", "capitana rios"]), 0.75),
        (dict(names=[]), dict(names=["x"]), 0.0),
    ],
)
def test_score_cases(spark, a, b, expected):
    full = lambda x, k, c: (1, k, x["names"], x.get("gender"), None, False, x.get("chunks", [c]))
    df = spark.createDataFrame([full(a, 0, 0), full(b, 1, 50)], CAST)
    pairs = spark.createDataFrame([(1, 0, 1)], "doc_id long, a_ord int, b_ord int")
    row = pairing.score_pairs(df, pairs).first()
    assert row["score"] == pytest.approx(expected)
    assert row["decision"] == ("merge" if expected >= 0.9 else "review" if expected >= 0.6 else "none")


def test_merges(spark):
    rows = [(1, "g", "s", "gender", v, c, l, o) for o, (v, c, l) in enumerate([("femenino", 0, "a"), ("Femenino", 1, "b"), ("masculino", 0, "a")])]
    traits = spark.createDataFrame(rows, "doc_id long, group_key string, section string, field string, value string, chunk_index int, local_id string, ord int")
    scalar = merging.merge_scalars(traits).first()
    assert (scalar["value"], scalar["n_references"], [(c["value"], [tuple(r) for r in c["references"]]) for c in scalar["conflicts"]]) == ("femenino", 2, [("masculino", [(0, "a")])])
    assert [tuple(r) for r in merging.merge_references(traits).first()["references"]] == [(0, "a"), (1, "b")]
    assert merging.append_unique(traits).first()["values"] == ["femenino", "masculino"]
    objects = traits.withColumn("item", F.struct("value", "chunk_index"))
    assert [tuple(x) for x in merging.append_unique_objects(objects, "value").first()["items"]] == [("femenino", 0), ("masculino", 0)]


def observation(chunk, name, **more):
    value = lambda v: {"value": v} if v else None
    return (1, chunk, [{"local_id": f"char_{chunk}", "display_name": name, "reference_type": "named", "identity": {"name_variants": [{"value": name}]}, "appearance": {"gender": value(more.get("gender"))}}])


def observations(spark, *rows):
    return spark.createDataFrame(list(rows), f"doc_id long, chunk_index int, characters array<{extraction.CHARACTER}>")


def test_consolidation(spark):
    seen = observations(spark, observation(0, "Capitana Rios", gender="femenino"), observation(1, "Ines Rios", gender="femenino"), observation(2, "Bruno"), observation(9, "Bruno", gender="masculino"))
    found = {r["canonical_name"]: r for r in Pipeline().consolidate(seen).collect()}
    assert set(found) == {"Ines Rios", "Bruno"}
    assert [tuple(x) for x in found["Ines Rios"]["references"]] == [(0, "char_0"), (1, "char_1")]
    assert found["Bruno"]["confidence"] == "medium" and not found["Bruno"]["needs_llm_review"]


def test_review_and_resolver(spark):
    seen = observations(spark, observation(0, "Ines Rios"), observation(9, "Rios"))
    unsure = Pipeline().consolidate(seen).collect()
    assert len(unsure) == 2 and all(r["confidence"] == "low" for r in unsure)
    resolved = Pipeline(resolver=lambda a, b, s: True).consolidate(seen).collect()
    assert len(resolved) == 1 and resolved[0]["confidence"] == "low" and not resolved[0]["needs_llm_review"]
    assert len(Pipeline(resolver=lambda a, b, s: False).consolidate(seen).collect()) == 2


def rich(chunk, name, kind="named", **more):
    """An observed character with traits."""
    items = lambda *v: [{"value": x} for x in v]
    return (1, chunk, [{"local_id": f"char_{chunk}", "display_name": name, "reference_type": kind, "identity": {"name_variants": items(name), "titles_roles_descriptors": [{"value": "capitana", "type": "role", "evidence_quote": "q"}] if more.get("title") else []},
        "appearance": {"gender": {"value": more["gender"]} if more.get("gender") else None, "physical_traits": items(*more.get("physical", []))},
        "social_context": {"relationships": [{"target": t, "relation": r} for t, r in more.get("relations", [])]}, "motivations_goals": items(*more.get("goals", [])), "scene_context": {"actions": items(*more.get("actions", []))}}])


def test_whole_characters(spark, tmp_path):
    seen = observations(
        spark, rich(0, "Ines Rios", gender="femenino", physical=["Alta", "morena"], relations=[("Bruno", "hermana"), ("Eva", "hermana")], title=True),
        rich(1, "Capitana Ines Rios", gender="masculino", physical=["alta"], goals=["volver"]), rich(5, "un hombre", "descriptive"), rich(7, "Bruno", actions=["corre"]),
    )
    p = Pipeline()
    found = p.consolidate(seen)
    by = {r["canonical_name"]: r for r in found.collect()}
    assert set(by) == {"Ines Rios", "Bruno"}  # "un hombre" has too little evidence
    ines = by["Ines Rios"]
    assert [x["value"] for x in ines["traits"]["physical_traits"]] == ["Alta", "morena"]
    assert [tuple(r) for r in ines["traits"]["physical_traits"][0]["references"]] == [(0, "char_0"), (1, "char_1")]
    assert [(x["target"], x["value"]) for x in ines["traits"]["relationships"]] == [("Bruno", "hermana"), ("Eva", "hermana")]
    assert ines["traits"]["motivations_goals"][0]["value"] == "volver" and ines["traits"]["titles_roles_descriptors"][0]["type"] == "role"
    gender = ines["scalars"]["gender"]
    assert gender["value"] == "femenino" and [c["value"] for c in gender["conflicts"]] == ["masculino"]
    assert ines["needs_llm_review"] and ines["confidence"] == "low" and ines["reasons"] == ["conflict"]
    chunks = spark.createDataFrame([(1, 0, "Then Ines Rios came."), (1, 1, "Capitana Ines Rios left."), (1, 7, "Bruno runs.")], "doc_id long, chunk_index int, chunk_text string")
    made = {r["main_name"]: r for r in p.cards(found, chunks).collect()}
    assert set(made) == {"Ines Rios", "Bruno"} and made["Ines Rios"]["id"] == "ines-rios"
    assert "physical_traits: Alta, morena" in made["Ines Rios"]["description"] and made["Ines Rios"]["warnings"] == ["identity needs review"]
    echo = lambda c: {"main_name": c["canonical_name"], "aliases": [], "description": c["source"]["snippets"][0]["snippet"], "image_prompt": str(c["references_count"]), "confidence": "high", "warnings": []}
    shown = {r["main_name"]: r for r in Pipeline(generator=echo).cards(found, chunks).collect()}
    assert shown["Ines Rios"]["description"] == "Then Ines Rios came." and shown["Ines Rios"]["image_prompt"] == "2"
    assert "evidence_quote" not in str(found.schema)


def test_resolver_contract(spark):
    seen = observations(spark, observation(0, "Ines Rios"), observation(9, "Rios"))
    chunks = spark.createDataFrame([(1, 0, "Here is Ines Rios."), (1, 9, "Only Rios here.")], "doc_id long, chunk_index int, chunk_text string")

    def sees_source(a, b, s):
        ok = a["source"]["snippets"][0]["snippet"] == "Here is Ines Rios." and [m["chunk_index"] for m in b["source"]["mentions"]] == [0, 9]
        return {"should_merge": ok, "confidence": "odd", "reason": "same"}

    merged = Pipeline(resolver=sees_source).consolidate(seen, chunks).collect()
    assert len(merged) == 1 and merged[0]["reasons"] == ["merged with rios: same"]
    assert len(Pipeline(resolver=lambda a, b, s: '{"should_merge": true}').consolidate(seen).collect()) == 1
    for answer in ("[1]", {"should_merge": "true"}, None, 1):
        assert not resolving.coerced(answer)["should_merge"]

    def fails(a, b, s):
        raise RuntimeError("no model")

    assert all("no model" in r["reasons"][0] for r in Pipeline(resolver=fails).consolidate(seen).collect())
    assert resolving.coerced({"should_merge": 1, "confidence": "high", "reason": 3}) == {"should_merge": False, "confidence": "high", "reason": ""}


def test_greedy_passes_against_all_pairs(spark):
    """Looking at pairs that can meet only, scored by Spark, gives what looking at all pairs gives."""
    from loomtale.plans import catalog

    found = consolidation.groups(consolidation.observed(catalog._observations(spark, "/root/testdata/sf0.001"))).cache()
    got = {(r["doc_id"], r["group_key"]): r["cluster"] for r in consolidation.clusters(found).collect()}
    books = {}
    for r in found.collect():
        books.setdefault(r["doc_id"], []).append(r.asDict())
    merged = 0
    for doc, rows in books.items():
        live = [r | {"members": [r["group_key"]], "reasons": []} for r in sorted(rows, key=lambda r: (r["ord"]["chunk_index"], r["ord"]["char_ord"]))]
        for _ in range(consolidation.PASSES):
            before, kept = len(live), []
            while live:
                base, rest = live[0], []
                for other in live[1:]:
                    if consolidation.pair_score(base, other) >= 0.9:
                        consolidation._absorb(base, other)
                    else:
                        rest.append(other)
                kept.append(base)
                live = rest
            live = kept
            if len(live) == before:
                break
        merged += len(rows) - len(live)
        assert {k: got[doc, k] for g in live for k in g["members"]} == {k: g["group_key"] for g in live for k in g["members"]}
    assert merged > 5


def test_components(spark):
    seen = observations(spark, observation(0, "Elena Vargas", gender="f"), observation(1, "Dra. Elena Vargas", gender="f"), observation(5, "Otro"))
    found = consolidation.groups(consolidation.observed(seen))
    assert len({r["cluster"] for r in consolidation.component_clusters(found).collect()}) == 2


def test_extraction_errors_and_cards(spark):
    def broken(text):
        raise RuntimeError("no model")

    chunks = spark.createDataFrame([(1, 0, "Then Elena Vargas met Bruno there.")], "doc_id long, chunk_index int, chunk_text string")
    failed = extraction.extract(chunks, broken).first()
    assert failed["error"] == "no model" and failed["characters"] == []
    p = Pipeline()
    found = p.consolidate(extraction.extract(chunks))
    assert {r["canonical_name"] for r in found.collect()} == {"Elena Vargas", "Bruno"}
    assert p.cards(found).count() == 0  # nothing is known of them but their names
    low = cards.generate_cards(found.select("doc_id", "canonical_name"), broken).first()
    assert low["confidence"] == "low" and low["warnings"] == ["no model"]


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, 0, "Anaconda and then Ana. So Ana spoke"), (1, 1, "nobody"), (1, 2, "ana")], "doc_id long, chunk_index int, chunk_text string")
    terms = spark.createDataFrame([(1, 0, "Ana")], "doc_id long, term_ord int, term string")
    out = [(r["chunk_index"], r["matched_text"]) for r in retrieval.mentions(chunks, terms).orderBy("chunk_index").collect()]
    assert out == [(0, "Ana"), (2, "ana")]
    at = chunks.select(retrieval.find_term(F.col("chunk_text"), F.lit("Ana")).alias("at")).collect()
    assert [r["at"] for r in at] == [18, None, 0]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_readers(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:r><w:t>D</w:t><w:t>os</w:t></w:r></w:p></w:body></w:document>"})
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="a.xhtml" media-type="application/xhtml+xml"/><item href="b.xhtml" media-type="application/xhtml+xml"/></manifest></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'
    epub = zipped({"META-INF/container.xml": container, "OEBPS/c.opf": opf, "OEBPS/a.xhtml": "<p>Hola</p><script>x</script><p>tú</p>", "OEBPS/b.xhtml": "<p> </p>"})
    files = {"a.txt": "niño".encode(), "b.TXT": "niño".encode("cp1252"), "c.docx": docx, "d.epub": epub, "e.exe": b"x", "f.txt": b"  ", "g.docx": b"broken"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    out = {r["path"].rsplit("/", 1)[1]: (r["blocks"], r["error"]) for r in readers.extract_blocks(readers.read_files(spark, str(tmp_path))).collect()}
    assert out["a.txt"] == out["b.TXT"] == (["niño"], None)
    assert out["c.docx"] == (["Uno\nDos"], None) and out["d.epub"] == (["Hola\ntú"], None)
    assert out["e.exe"][1] == "unsupported" and out["f.txt"][1] == "blank"
    assert out["g.docx"][1].startswith("unreadable")


def test_streams(spark, tmp_path):
    rows = [("j", f"2024-01-01 00:00:0{i}", s, i, s) for i, s in enumerate(["reading", "chunking", "done", "late"])] + [("k", "2024-01-01 00:00:00", "reading", 0, "x")]
    df = spark.createDataFrame(rows, "job_id string, ts string, step string, pct int, message string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert progress.until_terminal(df).count() == 4
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progress.stream_until_terminal(stream).writeStream.format("memory").queryName("open_events").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["step"] for r in spark.sql("select * from open_events").collect()) == ["chunking", "done", "reading", "reading"]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_text("hola")
    got = []
    q = progress.ingest(spark, str(tmp_path / "up"), lambda batch, n: got.extend(readers.extract_blocks(batch).collect()), str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert [r["blocks"] for r in got] == [["hola"]]


def test_metrics(spark):
    name = "case_id string, name string"
    row = evaluation.name_metrics(spark.createDataFrame([("a", "Ana"), ("a", "Luis")], name), spark.createDataFrame([("a", "ANA"), ("a", "Eva"), ("b", "X")], name)).first()
    assert (row["hits"], row["precision"]) == (1, 0.5) and row["recall"] == pytest.approx(1 / 3)
    resolved = spark.createDataFrame([("a", "1", "Ines Rios"), ("a", "1", "Capitana"), ("a", "2", "Rios")], "case_id string, cluster string, name string")
    wanted = spark.createDataFrame([("a", "ines rios", "capitana"), ("a", "ines rios", "rios")], "case_id string, canonical string, alias string")
    assert evaluation.alias_accuracy(resolved, wanted).first()["alias_accuracy"] == 0.5
    out = spark.createDataFrame([("a", "call 555-1")], "case_id string, text string")
    assert evaluation.leaks(out, spark.createDataFrame([("a", "555-1"), ("a", "@")], "case_id string, substring string")).first()["leak_count"] == 1


def test_documents_inside(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda x: f"<w:p><w:r>{x}</w:r></w:p>"
    body = p("<w:t>A</w:t><w:tab/><w:t>B</w:t><w:br/><w:t>C</w:t>") + f"<w:tbl><w:tr><w:tc>{p('<w:t>cell</w:t>')}</w:tc></w:tr></w:tbl>" + '<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
    assert readers.read_docx(zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})) == ["A\tB\nC\nlink"]
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item href="../text/a%20b.xhtml#x" media-type="application/xhtml+xml"/></manifest></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'
    assert readers.read_epub(zipped({"META-INF/container.xml": container, "OEBPS/c.opf": opf, "text/a b.xhtml": "<p>Hola</p>"})) == ["Hola"]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    assert readers.extract_blocks(readers.read_files(spark, str(tmp_path))).first()["error"].startswith("unreadable: ")


def test_events_logs_and_retention(spark):
    counts = spark.createDataFrame([("j", 1, 2), ("j", 2, 2)], "job_id string, i int, n int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert [(r["step"], r["pct"], r["message"]) for r in progress.events(counts, "extraction", "chunk {i} of {n}", 5, 95).orderBy("pct").collect()] == [("extraction", 50, "chunk 1 of 2"), ("extraction", 95, "chunk 2 of 2")]
    logs = spark.createDataFrame([("j", 0, "a\n\n b\n")], "job_id string, ts int, text string")
    assert [(r["line"], r["message"]) for r in progress.log_lines(logs).orderBy("line").collect()] == [(0, "a"), (2, " b")]
    files = spark.createDataFrame([("old", "2024-01-01 00:00:00"), ("new", "2024-01-02 00:00:00")], "path string, m string").select("path", F.col("m").cast("timestamp").alias("modificationTime"))
    assert [r["path"] for r in progress.expired(files, "2024-01-02 06:00:00", 24).collect()] == ["old"]
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, chunk_index int, chunk_text string")
    assert sorted(r["pct"] for r in Pipeline().events(chunks, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()) == [50, 95]
    docs = spark.createDataFrame([("x",), (" ",), (None,)], "text string")
    assert [r["error"] for r in chunking.with_errors(docs).collect()] == [None, "blank", "missing"]


def test_ties_at_the_end_of_a_job(spark, tmp_path):
    """Batch and stream keep the same events where times are equal."""
    rows = [("j", "2024-01-01 00:00:00", "reading", 5, "a"), ("j", "2024-01-01 00:00:01", "done", 100, "b"), ("j", "2024-01-01 00:00:01", "late", 50, "c"), ("j", "2024-01-01 00:00:02", "later", 60, "d")]
    df = spark.createDataFrame(rows, "job_id string, ts string, step string, pct int, message string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kept = sorted(r["step"] for r in progress.until_terminal(df).collect())
    assert kept == ["done", "late", "reading"]
    df.write.parquet(str(tmp_path / "in"))
    q = progress.stream_until_terminal(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tied").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["step"] for r in spark.sql("select * from tied").collect()) == kept
    updates = spark.createDataFrame([("j", 1, "ok", None), ("j", 2, "failed", "x"), ("j", 2, "done", None)], "job_id string, ts int, status string, error string")
    assert tuple(progress.latest_status(updates).first()) == ("j", "failed", "x", 2)


def test_long_books_are_packed_in_linear_time(spark):
    lengths = [(i * 7919) % 300 + 1 for i in range(3000)]
    text = "\n\n".join("x" * n for n in lengths)
    out = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.explode(chunking.chunks_of(F.array("text"), 1000, 2)).alias("c")).collect()
    expected, start, chars = [], 0, lengths[0]
    for i in range(1, 3000):
        if chars + 1 + lengths[i] <= 1000:
            chars += 1 + lengths[i]
        else:
            expected.append((start, i - 1))
            start = max(start, i - 2)
            chars = sum(lengths[start : i + 1]) + i - start
    expected.append((start, 2999))
    assert [len(r["c"]) for r in out] == [sum(lengths[a : b + 1]) + b - a for a, b in expected]


def test_equal_names_meet_as_classes(spark, monkeypatch):
    """Pairs made from classes are those that all characters compared with all give, also over several blocks; alike ones don't multiply rows."""
    from loomtale.operators import pairing

    names = [["ana ruiz", "ana"], ["eva ruiz"], ["ruiz"], ["ana ruiz", "ana"], []]
    rows = [(k % 2, k, names[k // 2 % 5], [None, "f", "m"][k % 3], [None, "old"][k % 2], k % 7 == 0, [k % 5 * 2]) for k in range(60)]
    df = spark.createDataFrame(rows, CAST)
    monkeypatch.setattr(pairing, "BLOCK", 4)
    told = lambda found: sorted((r["doc_id"], r["a_ord"], r["b_ord"], round(r["score"], 9), r["decision"], tuple(r["reasons"])) for r in found.collect())
    a, b = df.select("doc_id", F.col("ord").alias("a_ord")), df.select("doc_id", F.col("ord").alias("b_ord"))
    every = pairing.score_pairs(df, a.join(b, "doc_id").where("a_ord < b_ord"))
    assert told(pairing.score_pairs(df, least=0.5)) == told(every.where("score >= 0.5"))
    decided = pairing.class_pairs(df).withColumns({c: pairing.decision(F.col(f"{c}.score")) for c in ("forward", "backward")})
    counts = {(r["doc_id"], r["how"]): r["n"] for r in pairing.counted(decided).collect() if r["how"] != "none"}
    assert counts == {(r["doc_id"], r["decision"]): r["count"] for r in every.where("decision <> 'none'").groupBy("doc_id", "decision").count().collect()}
    monkeypatch.setattr(pairing, "BLOCK", 4096)
    many = spark.range(2000).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"), F.array(F.lit("ana ruiz")).alias("names"), F.lit("f").alias("gender"), F.lit(None).cast("string").alias("age"), F.lit(False).alias("conflicted"), F.array(F.lit(1)).alias("chunks"))
    alike = pairing.class_pairs(many)
    assert alike.count() == 1 and [r["n"] for r in pairing.counted(alike).collect()] == [2000 * 1999 // 2]


def test_pairs_of_a_large_group_are_made_in_parts(spark, monkeypatch):
    """A task holds all pairs of two groups, so those whose pairs are made have a bounded number of members; no pair is lost."""
    from loomtale.operators import pairing

    held, expand = [], pairing.expand
    monkeypatch.setattr(pairing, "MOST", 16)
    monkeypatch.setattr(pairing, "expand", lambda found: held.append(tuple(found.agg(F.max(F.size("a")), F.max(F.size("b"))).first())) or expand(found))
    many = spark.range(100).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"), F.array(F.lit("ana ruiz")).alias("names"), F.lit("f").alias("gender"), F.lit(None).cast("string").alias("age"), F.lit(False).alias("conflicted"), F.array(F.lit(1)).alias("chunks"))
    got = [(r["a_ord"], r["b_ord"]) for r in pairing.score_pairs(many, least=0.5).collect()]
    assert held == [(16, 16)] and sorted(got) == [(x, y) for x in range(100) for y in range(x + 1, 100)]


def test_pages_with_open_references(spark, duck):
    pages = ["<title>you&&&amp</title><p>a &amp; b", "x&copy y &copy; &nosuch; &#65; &quot;q&quot; &notit;", "<a href='?a=1&amp=2'>&</a>&middot", "&amp;quot; &amp;amp;"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in readers.pages_text(df).collect()}
    assert got == {0: "you&&&amp\na & b", 1: 'x&copy y © &nosuch; A "q" &notit;', 2: "&\n&middot", 3: "&quot; &amp;"}
    assert readers.html_text("<p>R&amp") == "R&"  # files are read as before
