"""Merging by component, decisions of a model, reasons, mentions: against plain loops, with odd ids and numbers."""

import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomtale.operators import components, consolidation, extraction, keys, lineage, merging, pairing, resolving, retrieval
from loomtale.plans.narrative import Pipeline


def seen(spark, rows, kind="long", chunk="int"):
    """rows: doc_id, chunk_index, names of the characters observed there, or (name, traits)."""

    def one(k, x):
        name, more = x if isinstance(x, tuple) else (x, {})
        value = lambda f: {"value": more[f]} if f in more else None
        items = lambda f: [{"value": v} for v in more.get(f, [])]
        return {"local_id": f"char_{k}", "display_name": name, "reference_type": "named", "identity": {"name_variants": [{"value": name}], "titles_roles_descriptors": items("titles")},
            "appearance": {"gender": value("gender"), "physical_traits": items("physical")}, "scene_context": {"actions": items("actions")}}

    data = [(d, c, [one(k, x) for k, x in enumerate(names)]) for d, c, names in rows]
    return spark.createDataFrame(data, f"doc_id {kind}, chunk_index {chunk}, characters array<{extraction.CHARACTER}>")


def names(rows):
    return sorted(((r["doc_id"], r["canonical_name"]) for r in rows), key=str)


def test_a_null_document_is_one_like_another(spark):
    rows = [(None, 0, ["Ines Rios", "Bruno"]), (None, 3, ["Capitana Ines Rios"]), (7, 0, ["Bruno"])]
    assert names(Pipeline().consolidate(seen(spark, rows)).collect()) == sorted([(None, "Ines Rios"), (None, "Bruno"), (7, "Bruno")], key=str)
    chunks = spark.createDataFrame([(None, 0, "Here is Bruno."), (7, 0, "Bruno again."), (8, 0, None)], "doc_id long, chunk_index int, chunk_text string")
    terms = spark.createDataFrame([(None, 0, "bruno"), (7, 0, "bruno"), (8, 0, "x")], "doc_id long, term_ord int, term string")
    assert sorted(((r["doc_id"], r["matched_text"]) for r in retrieval.mentions(chunks, terms).collect()), key=str) == [(7, "Bruno"), (None, "Bruno")]


@pytest.mark.parametrize("kind", ["string", "date"])
def test_ids_of_other_types(spark, kind):
    import datetime

    ids = {"string": ["b\"k", ""], "date": [datetime.date(2020, 1, 1), None]}[kind]
    made = Pipeline().consolidate(seen(spark, [(i, 0, ["Ines Rios", "Ines Rios"]) for i in ids], kind))
    assert made.schema["doc_id"].dataType.simpleString() == kind
    assert sorted(map(str, (r["doc_id"] for r in made.collect()))) == sorted(map(str, ids))


def test_large_chunk_numbers_and_crowded_chunks(spark):
    """The first observation leads, whatever the numbers."""
    far = seen(spark, [(1, 2_000_000_000, ["Capitana Rios"]), (1, 30_000, ["Ines Rios", "Capitana Rios"])])
    assert names(Pipeline().consolidate(far).collect()) == [(1, "Ines Rios"), (1, "Rios")]
    crowd = spark.createDataFrame([(1, "late", 0, 100_001), (1, "soon", 1, 0)], "doc_id long, group_key string, chunk_index int, char_ord int")
    found = crowd.select(
        "doc_id", "group_key", F.struct("chunk_index", "char_ord").alias("ord"), F.col("group_key").alias("canonical"), F.lit("named").alias("entity_type"), F.array(F.lit("ines rios")).alias("names"),
        F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("age"), F.lit(False).alias("conflicted"), F.array("chunk_index").alias("chunks"), F.lit(1).cast("long").alias("n_references"),
    )
    assert {r["cluster"] for r in consolidation.clusters(found).collect()} == {"late"}


def test_components(spark):
    """Long chains, cliques, stars and repeated edges, against union-find."""
    r = random.Random(4)
    edges = [("x", f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("y", f"c{i}", f"c{j}") for i in range(6) for j in range(6)] + [("z", "hub", f"s{i}") for i in range(30)]
    edges += [("r", f"v{r.randrange(60):02}", f"v{r.randrange(60):02}") for _ in range(45)] + [("y", "n001", "n002")]
    r.shuffle(edges)
    up = {}

    def top(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for s, a, b in edges:
        if a != b:
            x, y = sorted((top((s, a)), top((s, b))))
            up[y] = x
    got = components.components(spark.createDataFrame(edges, "scope string, a string, b string")).collect()
    assert {(g["scope"], g["node"]): g["component"] for g in got} == {n: top(n)[1] for n in list(up)} and len(got) == len(up)
    assert components.components(spark.createDataFrame([], "scope string, a string, b string")).collect() == []


def test_no_task_holds_more_than_a_component(spark, monkeypatch, tmp_path):
    sizes, decide = str(tmp_path), consolidation._decide

    def noted(rows, facts, *rest):
        with open(os.path.join(sizes, f"{rows[0]['component']}"), "w") as f:
            f.write(str(len(rows)))
        return decide(rows, facts, *rest)

    monkeypatch.setattr(consolidation, "_decide", noted)
    rows = [(1, k, [f"Name{k} Family{k // 2}"]) for k in range(40)] + [(1, 99, ["Lone Wolf"])]
    got = consolidation.clusters(consolidation.groups(consolidation.observed(seen(spark, rows)))).collect()
    assert len(got) == 41
    files = os.listdir(sizes)
    assert files == [] or ({open(os.path.join(sizes, f)).read() for f in files} == {"2"} and len(files) == 20)


def test_each_pair_is_asked_once(spark, tmp_path):
    """A book of many open pairs: the table of decisions gives what asking one by one gives, whoever reads the result and how often."""
    log = tmp_path / "asked"
    log.mkdir()
    rows = [(d, 10 * k, [n]) for d in (1, 2) for k, n in enumerate(["Ines Rios", "Rios", "Bruno Paz", "Paz", "Ana Paz", "Ines Paz"])]
    observed = seen(spark, rows)

    def resolver(a, b, score):
        with open(log / f"{os.getpid()}-{random.random()}", "w") as f:
            f.write(f"{a['references'][0]}{sorted(a['names'])}|{sorted(b['names'])}|{score:.2f}|{a['why']}")
        return {"should_merge": "rios" in a["names"] or "rios" in b["names"], "confidence": "high", "reason": "same"}

    made = Pipeline(resolver=resolver).consolidate(observed)
    first = sorted(map(str, made.collect()))
    calls = [p.read_text() for p in log.iterdir()]
    assert sorted(map(str, made.collect())) == first and len(list(log.iterdir())) == len(calls)
    assert len(calls) == len(set(calls)) > 2
    # the passes as a loop that asks at once
    found = [r.asDict(recursive=True) for r in consolidation.groups(consolidation.observed(observed.where("doc_id = 1"))).collect()]
    live = [g | {"members": [g["group_key"]], "reasons": []} for g in sorted(found, key=lambda g: (g["ord"]["chunk_index"], g["ord"]["char_ord"]))]
    for _ in range(consolidation.PASSES):
        before, unsure = len(live), []
        i = 0
        while i < len(live):
            for other in live[i + 1 :]:
                s = consolidation.pair_score(live[i], other)
                if s >= 0.9:
                    consolidation._absorb(live[i], other)
                    live = [g for g in live if g is not other]
                elif s >= 0.6:
                    unsure.append((live[i]["group_key"], other["group_key"]))
            i += 1
        for x, y in unsure:
            a, b = (next((g for g in live if g["group_key"] == k), None) for k in (x, y))
            if a and b and ("rios" in a["names"] or "rios" in b["names"]):
                consolidation._absorb(a, b)
                live = [g for g in live if g is not b]
        if len(live) == before:
            break
    assert len([r for r in made.collect() if r["doc_id"] == 1]) == len(live)


def test_books_that_wait_for_different_numbers_of_rounds(spark):
    """Answers of a component that has ended stay in the table while another one goes on."""
    books = {1: ["Ana Paz", "Paz"], 2: ["Ines Rios", "Rios", "Bruno Rios", "Ada Rios", "Eva Rios"], 3: ["Lone Wolf"]}
    rows = [(d, 10 * k, [n]) for d, found in books.items() for k, n in enumerate(found)]
    resolver = lambda a, b, score: {"should_merge": "paz" not in a["names"] + b["names"], "confidence": "high", "reason": "r"}
    together = names(Pipeline(resolver=resolver).consolidate(seen(spark, rows)).collect())
    alone = [x for d in books for x in names(Pipeline(resolver=resolver).consolidate(seen(spark, [r for r in rows if r[0] == d])).collect())]
    assert together == sorted(alone, key=str) and [d for d, _ in together] == [1, 1, 2, 3]


def test_by_name(spark):
    """The first character of a name; other spellings, ties, nulls, names that nobody has, columns of clashing names."""
    found = spark.createDataFrame([(1, 5, "Inés  Rios"), (1, 2, "ines RIOS"), (1, 9, "Paz"), (None, 1, "Paz"), (2, 0, None)], "doc_id long, ord int, canonical_name string")
    asked = spark.createDataFrame([(1, " INES rios", 0), (1, "paz", 1), (None, "PAZ", 2), (2, "paz", 3), (2, None, 4), (1, "paz", 1)], "doc_id long, name string, ORD int")
    got = consolidation.by_name(found, asked)
    assert got.columns == ["doc_id", "name", "ORD", "character"]
    assert sorted((r[2], r[3] and tuple(r[3])) for r in got.collect()) == [(0, (1, 2, "ines RIOS")), (1, (1, 9, "Paz")), (1, (1, 9, "Paz")), (2, (None, 1, "Paz")), (3, None), (4, None)]
    assert consolidation.by_name(found.limit(0), asked).where("character is not null").isEmpty()


def test_what_a_resolver_is_shown(spark):
    rows = [(1, 0, [("Ines Rios", {"gender": "femenino", "physical": ["Alta"], "titles": ["capitana"], "actions": ["corre"]})]), (1, 9, [("Rios", {"physical": ["alta", "morena"]})])]
    chunks = spark.createDataFrame([(1, 0, "Here is Ines Rios."), (1, 9, "Only rios here.")], "doc_id long, chunk_index int, chunk_text string")

    def check(a, b, score):
        assert set(resolving.FACTS) <= set(a) and set(resolving.FACTS) <= set(b)
        assert a["canonical_name"] == "Ines Rios" and a["appearance"]["gender"]["value"] == "femenino" and [t["value"] for t in a["appearance"]["physical_traits"]] == ["Alta"]
        assert [t["value"] for t in a["titles_roles_descriptors"]] == ["capitana"] and [t["value"] for t in a["scene_context"]["actions"]] == ["corre"]
        assert [t["value"] for t in b["appearance"]["physical_traits"]] == ["alta", "morena"] and b["motivations_goals"] == [] and b["references"] == [{"chunk_index": 9, "local_id": "char_0"}]
        assert a["why"] == ["contained name: ines rios / rios"] and score == pytest.approx(0.75)
        assert [m["chunk_index"] for m in b["source"]["mentions"]] == [0, 9] and a["source"]["snippets"][0]["snippet"] == "Here is Ines Rios."
        return {"should_merge": False, "confidence": "high", "reason": "no"}

    found = Pipeline(resolver=check).consolidate(seen(spark, rows), chunks).collect()
    assert len(found) == 2 and all(r["reasons"] == [] for r in found), [r["reasons"] for r in found]
    plain = Pipeline().consolidate(seen(spark, rows)).collect()
    assert all(r["reasons"] == ["ambiguous ines rios ~ rios 0.75 (contained name: ines rios / rios)"] for r in plain)


def test_terms_of_a_pair(spark):
    row = spark.sql("select 'Ines' as canonical_name, 'Ines' as display_name, array('la Jefa', ' ') as specific_appellations, array('la_jefa', 'in_es', 'ines') as aliases, array(named_struct('value', 'INES'), named_struct('value', 'Rios'), named_struct('value', 'rios')) as identity_names")
    assert row.select(resolving.pair_terms().alias("t")).first()["t"] == ["Ines", "Ines", "la Jefa", "in es", "Rios"]


def test_scores_and_reasons_in_columns_and_in_python(spark):
    r = random.Random(9)
    pool = ["ines", "rios", "bruno", "paz", "ana", "capitana", "de"]
    rows = [(1, k, sorted({" ".join(r.sample(pool, r.randrange(1, 4))) for _ in range(r.randrange(0, 4))}), r.choice([None, "f", "m"]), r.choice([None, "old", "young"]), r.random() < 0.1, [r.randrange(20)]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, names array<string>, gender string, age string, conflicted boolean, chunks array<int>")
    pairs = df.select("doc_id", F.col("ord").alias("a_ord")).crossJoin(df.select(F.col("ord").alias("b_ord"))).where("a_ord < b_ord")  # a fixture of 40 rows
    dicts = [dict(zip(("doc_id", "ord", "names", "gender", "age", "conflicted", "chunks"), x, strict=True)) for x in rows]
    for p in pairing.score_pairs(df, pairs).collect():
        score, why = consolidation.pair_facts(dicts[p["a_ord"]], dicts[p["b_ord"]])
        assert p["score"] == pytest.approx(score) and p["reasons"] == why, (dicts[p["a_ord"]], dicts[p["b_ord"]])


def test_mentions_against_a_pattern(spark):
    r = random.Random(2)
    letters = "abAB é.İß1_"
    texts = ["".join(r.choice(letters) for _ in range(120)) for _ in range(60)] + ["", "İİab ab", "aab-ab_ab"]
    terms = ["a", "ab", "ba", "b", "bab", "é", "a b", "ABA", "zz", "1_", "ss", "aa", "İa"]
    expected = {}
    for t in texts:
        low = retrieval.lowered(t)
        assert len(low) == len(t)
        for k, x in enumerate(terms):
            q = retrieval.lowered(x)
            m = re.search(r"(?<!\w)" + re.escape(q) + r"(?!\w)", low)
            if m or q in low:
                expected[t, k] = m.start() if m else low.index(q)
    for some in (terms, terms[:5]):
        find = retrieval.Finder([retrieval.lowered(x) for x in some])
        assert {(t, k): at for t in texts for k, (at, _) in find(t).items()} == {(t, k): at for (t, k), at in expected.items() if k < len(some)}


def test_mentions_are_dealt_to_those_who_asked(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 3)
    chunks = spark.createDataFrame([(d, i, f"Ana and Bruno, {i}." if i % 2 else f"only ana {i}") for d in (1, 2) for i in range(20)], "doc_id long, chunk_index int, chunk_text string")
    asked = spark.createDataFrame([(1, "a", ["ANA", "Bruno"]), (1, "b", ["bruno"]), (2, "c", ["nobody", None, "ana"]), (2, "d", [])], "doc_id long, key string, terms array<string>")
    got = defaultdict(list)
    for m in retrieval.mentions_by_key(asked, chunks, limit=4).orderBy("chunk_index", "term_ord").collect():
        got[m["key"]].append((m["chunk_index"], m["query"], m["matched_text"]))
    assert dict(got) == {"a": [(0, "ANA", "ana"), (1, "ANA", "Ana"), (1, "Bruno", "Bruno"), (2, "ANA", "ana")], "b": [(i, "bruno", "Bruno") for i in (1, 3, 5, 7)], "c": [(i, "ana", "Ana" if i % 2 else "ana") for i in range(4)]}
    plan = retrieval.mentions_by_key(asked, chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_text" not in plan[: plan.index("FlatMapCoGroupsInPandas")]  # texts go no further than the search


def test_keys_come_back(spark):
    df = spark.createDataFrame([(1, 2.5), (None, None)], "doc_id long, x double")
    assert sorted(map(str, keys.opened(keys.sealed(df), df.schema["doc_id"].dataType).collect())) == sorted(map(str, df.collect()))
    assert keys.sealed(df).where("doc_id is null").isEmpty()


def test_short_books_are_searched_together(spark, monkeypatch):
    """Books that share a set keep their own terms, and a book that is longer goes on in parts of its own."""
    monkeypatch.setattr(retrieval, "SETS", 1)
    monkeypatch.setattr(retrieval, "SHORT", 3)
    monkeypatch.setattr(retrieval, "PART", 2)
    chunks = spark.createDataFrame([(d, i, f"w{d % 5} w{d % 3} x") for d in range(30) for i in range(-2, d % 7)], "doc_id long, chunk_index int, chunk_text string")
    asked = spark.createDataFrame([(d, "k", [f"w{d % 5}"]) for d in range(0, 30, 2)], "doc_id long, key string, terms array<string>")
    got = sorted((m["doc_id"], m["chunk_index"], m["query"]) for m in retrieval.mentions_by_key(asked, chunks, limit=99).collect())
    assert got == sorted((d, i, f"w{d % 5}") for d in range(0, 30, 2) for i in range(-2, d % 7))
    keyed = lambda p: "hashpartitioning(set" in p and "REPARTITION_BY_NUM" in p
    assert keyed(retrieval.mentions_by_key(asked, chunks)._jdf.queryExecution().executedPlan().toString())


def test_components_share_batches_and_values_are_merged_without_joins(spark):
    """What each component or value cost before: a group of its own in Python, and a join of its references."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = [(1, k, [f"Name{k} Family{k // 2}"]) for k in range(40)]
    whole = plan(consolidation.clusters(consolidation.groups(consolidation.observed(seen(spark, rows)))))
    assert "MapInArrow" in whole and "CoGroup" not in whole
    items = spark.createDataFrame([(1, "g", "s", "f", " Año ", "t", 0, "a", 0), (1, "g", "s", "f", "ano", "t", 0, "a", 1), (1, "g", "s", "f", "ANO", "u", 2, "b", 2), (1, "g", "s", "f", None, "u", 3, "b", 3)], "doc_id int, group_key string, section string, field string, value string, type string, chunk_index int, local_id string, ord int")
    for merged in (merging.merge_values(items, ("type",)), merging.merge_identity_names(items)):
        assert "Join" not in plan(merged)
        row = merged.first()
        assert (row["value"], row["type"], row["ord"], [tuple(r) for r in row["references"]]) == (" Año ", "t", 0, [(0, "a"), (2, "b")])


def test_many_results_of_many_components(spark, monkeypatch):
    """More results than a batch holds come out whole, and in pieces."""
    monkeypatch.setattr(consolidation, "HANDED_ON", 3)
    rows = [(d, k, [f"Name{k} Family{k // 2}"]) for d in (1, None) for k in range(60)]
    got = consolidation.clusters(consolidation.groups(consolidation.observed(seen(spark, rows)).transform(keys.sealed))).collect()
    assert len(got) == 120 and len({(r["doc_id"], r["group_key"]) for r in got}) == 120


def test_three_references_and_some_substance_are_enough(spark):
    """A descriptive character of three references and a substance of one is eligible, as in the reference; the SQL of grouped_characters lacks that."""
    rows = [(1, c, [("Blue Gear", {"physical": ["steel"]})]) for c in range(3)] + [(2, c, [("Blue Gear", {"physical": ["steel"]})]) for c in range(2)]
    odd = F.transform("characters", lambda c: c.withField("reference_type", F.lit("descriptive")))
    found = Pipeline().consolidate(seen(spark, rows).withColumn("characters", odd))
    assert {r["doc_id"]: (r["n"], r["e"]) for r in found.select("doc_id", F.size("references").alias("n"), consolidation.eligible(found).alias("e")).collect()} == {1: (3, True), 2: (2, False)}


def test_what_is_merged_is_moved_once(spark):
    """Only the clusters' flags are shuffled behind the cut of their rows, which hold no quotes; the observed rows' table is gone."""
    rows = seen(spark, [(d, c, [("Ines Rios", {"gender": "f", "physical": ["tall"], "actions": ["runs"]}), "Capitana Ines Rios", "Bruno"]) for d in range(3) for c in range(3)])
    held = consolidation.observed(rows)
    assert "quote" not in held.schema["c"].dataType.simpleString() and "name_variants" not in held.schema["c"].dataType.simpleString()
    tables = lambda: {r["tableName"] for r in spark.sql("show tables in spark_catalog.default like 'loomtale_*'").collect()}
    before = tables()
    whole = Pipeline().consolidate(rows)
    assert len(tables() - before) == 1
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id#" in plan
    got = sorted((r["doc_id"], r["canonical_name"], len(r["references"]), "gender" in (r["scalars"] or {}), [x["value"] for x in r["traits"].get("physical_traits", [])]) for r in whole.collect())
    assert got == sorted([(d, "Bruno", 3, False, []) for d in range(3)] + [(d, "Ines Rios", 6, True, ["tall"]) for d in range(3)])


def test_a_bucketed_cut_is_deleted(spark):
    made = lineage.Bucketed(spark.createDataFrame([(None, "a", 1), ("x", "b", 2)], "doc_id string, group_key string, n int"), "doc_id", "group_key")
    assert sorted((r["n"], r["doc_id"]) for r in made.df.collect()) == [(1, None), (2, "x")]
    folder = made.path.removeprefix("file:")
    assert os.path.isdir(folder)
    made.drop()
    assert not os.path.exists(folder) and not spark.catalog.tableExists(made.table)
