"""Scalar functions and predicates on fixed inputs."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from loomtale.functions import identity as I
from loomtale.functions import text as X
from loomtale.functions import vocabulary as V
from loomtale.functions.json_repair import first_object
from loomtale.operators import guardrails, merging, narrative


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "value", "expected"),
    [
        (X.normalize, "  José   PÉREZ ", "jose perez"),
        (X.alias_form, "tortuga_1", "tortuga"),
        (X.slug, "Íñigo Montoya!", "inigo-montoya"),
        (X.slug, "¿?", "character"),
        (X.strip, " \t a b  ", "a b"),
        (X.detect_language, "la la la", "es"),
        (X.detect_language, "the cat of the house", "en"),
        (X.detect_language, "zzz", "source"),
        (I.strip_title, "Dra. Ruiz", "Ruiz"),
        (I.strip_title, "la capitana", "la capitana"),
        (I.strip_title, "senor Ruiz", "senor Ruiz"),
        (I.is_generated_id, "char_12", True),
        (I.is_generated_id, "personaje-3", True),
        (I.is_generated_id, "7", True),
        (I.is_generated_id, "Elena", False),
        (I.is_appellation, "el Mago Gris", True),
        (I.is_appellation, "La Reina", False),
        (I.is_appellation, "el mago", False),
        (I.is_descriptive, "el nino", True),
        (I.is_descriptive, "el hombre de la capa roja", True),
        (I.is_descriptive, "la reina roja", False),
        (narrative.non_narrative, "Agradecimientos\nA mi madre", True),
        (narrative.non_narrative, "Agradecimientos\nA mi madre\nCapítulo 1\nx", False),
        (narrative.non_narrative, "ÍNDICE", True),
        (narrative.non_narrative, "Table of contents here", True),
        (narrative.non_narrative, "Copyright 2020. ISBN 1", True),
        (narrative.non_narrative, "Some prose with one copyright in it", False),
        (narrative.non_narrative, " \n ", True),
        (guardrails.prompt_error, "", "empty"),
        (guardrails.prompt_error, "a " * 2001, "too_long"),
        (guardrails.prompt_error, "a b c d", "too_few_words"),
        (guardrails.prompt_error, "a b c d e\x07", "control_characters"),
        (guardrails.prompt_error, "a b c d e", None),
        (X.error_message, "{'error': {'message': 'no credit'}}", "no credit"),
        (X.error_message, '{"error": {"message": "busy"}}', "busy"),
        (X.error_message, "plain", "plain"),
    ],
)
def test_of_one_text(spark, column, value, expected):
    assert one(spark, column(F.col("v")), v=value) == expected


@pytest.mark.parametrize(("name", "size", "expected"), [("x", 1, "unsupported"), ("x.exe", 1, "unsupported"), ("x.PDF", 0, "empty"), ("x.pdf", 1, None), ("x.txt", 104_857_601, "too_large")])
def test_upload(spark, name, size, expected):
    assert one(spark, guardrails.upload_error(F.col("n"), F.col("s")), n=name, s=size) == expected


@pytest.mark.parametrize(("a", "b", "contained", "surname"), [("rios", "ines rios", True, True), ("ana", "ana maria lopez", False, False), ("la capitana", "capitana rios", False, False), ("ines rios", "juan rios", False, True), ("rios", "rios", True, False)])
def test_two_names(spark, a, b, contained, surname):
    assert one(spark, I.is_contained(F.col("a"), F.col("b")), a=a, b=b) is contained
    assert one(spark, I.shares_surname(F.col("a"), F.col("b")), a=a, b=b) is surname


@pytest.mark.parametrize(("i", "n", "start", "stop", "expected"), [(1, 2, 97, 99, 98), (1, 4, 0, 98, 24), (3, 0, 5, 9, 5), (9, 4, 0, 10, 10)])
def test_percent(spark, i, n, start, stop, expected):
    assert one(spark, X.percent(F.col("i"), F.col("n"), start, stop), i=i, n=n) == expected


def test_windows_and_templates(spark):
    text = "x" * 200 + "MARK" + "y" * 200
    assert one(spark, X.window_around(F.col("t"), F.lit(200), F.lit(204), 160), t=text) == "..." + "x" * 80 + "MARK" + "y" * 80 + "..."
    assert one(spark, X.head(F.col("t"), 5), t=" abcd efg ") == "abcd..."
    assert one(spark, X.render(F.col("t"), {"A": F.lit("{{B}}"), "B": F.lit("b")}), t="{{A}} {{C}}") == "b {{C}}"


@pytest.mark.parametrize(("refs", "aliases", "review", "expected"), [(3, 0, False, "high"), (1, 2, False, "high"), (1, 0, False, "medium"), (5, 5, True, "low")])
def test_confidence(spark, refs, aliases, review, expected):
    assert one(spark, merging.confidence(F.col("v"), F.lit(0), F.col("r"), F.col("a")), v=review, r=refs, a=aliases) == expected


@pytest.mark.parametrize(("answer", "expected"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ('text {"a":"}"} tail', '{"a": "}"}'), ('{"a":1', None), ("[1]", None), (None, None)])
def test_json(answer, expected):
    assert first_object(answer) == expected


def test_normal_form_of_every_character(spark):
    """As the standard library decomposes it, but for characters that stand for several ones without their marks."""
    import unicodedata

    bare = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn")
    codes = [c for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cc")]
    several = {c for c in codes if len(bare(chr(c).lower())) > 1}
    assert len([c for c in several if not 0xAC00 <= c <= 0xD7A3]) < 50
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes if c not in several], "c int, t string")
    wrong = [r["c"] for r in df.select("c", "t", X.normalize(F.col("t")).alias("n")).collect() if r["n"] != " ".join(bare(r["t"].lower()).split())]
    assert wrong == []
    assert one(spark, X.normalize(F.col("v")), v="ὌΡΟΣ") == "ορος"


def test_strip_takes_white_space_of_any_kind(spark):
    chars = [chr(c) for c in range(1, 0x3100)] + ["﻿", "​"]
    rows = spark.createDataFrame([(f"{c}{c}x {c} y{c}\n",) for c in chars] + [("",), (" 　",), (None,)], "t string")
    got = rows.select(X.strip(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == []


def test_every_heading_has_one_of_the_stems(spark):
    """Headings in any case are found behind the stems, and stems alone are none."""
    def forms(pattern):  # all texts of a pattern of optional letters, classes and groups
        parts = re.findall(r"\(\?:([^)]*)\)(\?)?|\[([^]]*)\]|(.)(\?)?", pattern)
        ways = [[*g.split("|"), *([""] if g_opt else [])] if g else list(cls) if cls else [c, *([""] if c_opt else [])] for g, g_opt, cls, c, c_opt in parts]
        return ["".join(x) for x in itertools.product(*ways)]

    found = sorted({f(x) for p in V.HEADINGS for x in forms(p) for f in (str, str.upper, str.title, lambda s: s.replace("s", "ſ"), lambda s: s.replace("i", "İ"), lambda s: s.replace("i", "ı"))})
    texts = [*[f"Uno\n{x}\nTres" for x in found if re.fullmatch("|".join(V.HEADINGS), x.replace("ſ", "s").replace("İ", "i").replace("ı", "i"), re.I)], "el autor presente\nun credito", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lines = narrative.lines_of(F.col("t"))
    plain = F.exists(F.slice(lines, 1, 5), lambda x: x.rlike(narrative.HEADING)) & ~F.col("t").rlike(narrative.CHAPTER)
    rows = df.select("t", narrative.non_narrative(F.col("t")).alias("got"), plain.alias("plain")).collect()
    assert len(rows) > 150 and sum(r["plain"] for r in rows) > 150
    assert [r["t"] for r in rows if r["plain"] and not r["got"]] == [] and [r["got"] for r in rows if r["t"] in ("el autor presente\nun credito", "x")] == [False, False]
