"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V

#: White space of any kind, as ``\\s`` with Unicode classes has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _bases() -> tuple[str, str]:
    """Precomposed characters of all scripts with the single characters under their marks, and after them the marks themselves, which have none.

    No character beyond U+2FFFF decomposes, and the only marks there are selectors in U+E0100 to U+E01EF.
    """
    found = (chr(c) for c in range(0xC0, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c))[:1] not in ("", "<"))
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) for c in found]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    marks = [chr(c) for c in (*range(0x300, 0x30000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c)) == "Mn"]
    return "".join([*(a for a, _ in pairs), *marks]), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _bases()


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Lower case, without accents, single spaces.

    Characters that stand for several ones without their marks (Hangul syllables, a few signs of South Asian scripts and of music) stay whole.
    """
    # the table is long, and a text of ASCII has nothing in it
    plain = let(F.lower(strip(text)), lambda x: F.when(F.length(x) == F.octet_length(x), x).otherwise(F.translate(x, ACCENTED, PLAIN)))
    return F.regexp_replace(plain, r"(?U)\s+", " ")


def alias_form(text: Column) -> Column:
    """Normal form in which underscores are spaces and digits don't count."""
    spaced = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"(?U)\d+", "")
    return strip(normalize(spaced))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " ", -1), lambda t: t != "")


def slug(name: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(normalize(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.when(joined != "", joined), F.lit("character"))


def language_sample(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.substring(text, 1, 20000)), F.lit(" "))


def marker_score(sample: Column, markers: list[str]) -> Column:
    """How often the words occur between spaces in a sample, without overlaps; counted by the bytes that go with them."""
    count = lambda m: (F.octet_length(sample) - F.octet_length(F.replace(sample, F.lit(f" {m} "), F.lit("")))) / (len(m.encode()) + 2)
    return sum((count(m) for m in markers[1:]), count(markers[0])).cast("long")


def detect_language(text: Column) -> Column:
    """By the words that the first 20000 characters have; ``detected`` is the form for tables."""
    scores = lambda s: F.struct(marker_score(s, V.SPANISH_MARKERS).alias("es"), marker_score(s, V.ENGLISH_MARKERS).alias("en"))
    label = lambda n: F.when((n["es"] >= n["en"]) & (n["es"] > 0), "es").when(n["en"] > n["es"], "en").otherwise("source")
    return let(let(language_sample(text), scores), label)


def detected(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with es, en (how often the markers of each occur in the first 20000 characters) and language.

    Generators of one row keep the optimizer from writing the sample and the scores out wherever they are used.
    """
    sampled = docs.select("*", F.explode(F.array(language_sample(F.col(text)))).alias("__sample"))
    counts = F.struct(marker_score(F.col("__sample"), V.SPANISH_MARKERS).alias("es"), marker_score(F.col("__sample"), V.ENGLISH_MARKERS).alias("en"))
    scored = sampled.select(*docs.columns, F.explode(F.array(counts)).alias("__n")).select(*docs.columns, F.col("__n.es").alias("es"), F.col("__n.en").alias("en"))
    return scored.withColumn("language", F.when((F.col("es") >= F.col("en")) & (F.col("es") > 0), "es").when(F.col("en") > F.col("es"), "en").otherwise("source"))


def language_label(code: Column) -> Column:
    out = F.lit(V.OTHER_LANGUAGE)
    for k, v in V.LANGUAGE_LABELS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def window_around(text: Column, start: Column, stop: Column, width: int) -> Column:
    """Characters around [start, stop), 0-based, with dots where something is cut off."""
    half = max(80, width // 2)
    lo, hi = F.greatest(F.lit(0), start - half), F.least(F.length(text), stop + half)
    cut = strip(F.substring(text, lo + 1, hi - lo))
    return F.concat(F.when(lo > 0, "...").otherwise(""), cut, F.when(hi < F.length(text), "...").otherwise(""))


def head(text: Column, n: int) -> Column:
    clean = strip(text)
    return F.when(F.length(clean) <= n, clean).otherwise(F.concat(F.regexp_replace(F.substring(clean, 1, n), r"(?U)\s+$", ""), F.lit("...")))


def percent(index: Column, total: Column, start: int, stop: int) -> Column:
    """Progress from start to stop, halves to the even number."""
    share = F.greatest(F.lit(0), F.least(index, total)) / F.when(total > 0, total)
    return F.coalesce(F.lit(start) + F.bround(share * (stop - start)).cast("int"), F.lit(start))


def render(template: Column, values: dict[str, Column]) -> Column:
    """{{KEY}} replaced by its value, key after key."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), v.cast("string"))
    return template


def error_message(raw: Column) -> Column:
    """The message inside a provider's error, or the error itself."""
    quoted = F.regexp_extract(raw, r"'error':\s*\{\s*'message':\s*'([^']*)'", 1)
    return F.coalesce(F.when(quoted != "", quoted), F.get_json_object(raw, "$.error.message"), raw)


def mebibytes(chars: Column) -> Column:
    return F.format_number(chars / 1024 / 1024, 2)


def short_hash(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 12)
