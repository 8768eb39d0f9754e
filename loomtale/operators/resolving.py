"""Pairs that only a model can decide: the facts it is shown, and the table of its decisions.

``rounds`` plays the order-dependent merge of each component again and again.  Where it needs a decision that isn't in
the table yet, it hands the pair out as a row and goes on as if the answer were no.  The rows of all components get their facts
by joins, distinct ones are asked in Arrow batches, and their answers are written before anyone reads them: by a hash
of all that the model was shown, so nothing is asked twice, however often a pass or a task runs again (but for a task
that dies while it asks: a task holds at most ``ASKED`` pairs).  Only components that wait for an answer are played again.  A result
that depends on an answer is only ever made with it, so it equals that of asking one by one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import retrieval
from .lineage import cut

#: (a, b, score) -> a decision, as a bool, a dict with should_merge, confidence and reason, or the JSON text of one.
#: a and b are dicts: what ``consolidation`` scores by (canonical, names, entity_type, gender, age, conflicted, chunks,
#: n_references), the character's facts (the keys of ``FACTS``), shared (what both names have in common), why (the
#: reasons of the score) and source (snippets and mentions, if there are chunks).
Resolver = Callable[[dict, dict, float], object]
ASKED = 64

#: What a resolver is told of a character.
FACTS = (
    "canonical_name", "display_name", "entity_type", "aliases", "identity_names", "specific_appellations", "titles_roles_descriptors", "references",
    "appearance", "personality_behavior", "social_context", "motivations_goals", "scene_context",
)

KEY = "doc_id string, component string"
ANSWERS = KEY + ", ask string, answer string"
ASKS = "ask string, left array<string>, right array<string>, a string, b string, score double, why array<string>"


def coerced(answer: object) -> dict:
    """A resolver's answer as should_merge (true only if it says so), confidence (low if unknown) and reason."""
    if isinstance(answer, str):
        answer = json.loads(answer)
    if not isinstance(answer, dict):
        answer = {"should_merge": answer}
    level, reason = answer.get("confidence"), answer.get("reason")
    return {"should_merge": answer.get("should_merge") is True, "confidence": level if level in ("low", "medium", "high") else "low", "reason": reason if isinstance(reason, str) else ""}


def pair_terms(canonical: str = "canonical_name", display: str = "display_name") -> Column:
    """The names by which a character of a pair is looked for: canonical, display, appellations; then aliases (with spaces for underscores) and identity values that are new, case aside."""
    first = F.concat(F.array(canonical, display), "specific_appellations")
    later = F.concat(F.transform("aliases", lambda v: F.replace(v, F.lit("_"), F.lit(" "))), F.transform("identity_names", lambda n: n["value"]))
    clean = lambda c: F.filter(F.transform(F.filter(c, lambda v: v.isNotNull()), strip), lambda v: v != "")
    new = lambda c, known: F.filter(c, lambda v, i: ~F.exists(known, lambda k: F.lower(k) == F.lower(v)) & (F.array_position(F.transform(c, F.lower), F.lower(v)) == i + 1))
    return F.concat(clean(first), new(clean(later), clean(first)))


def facts(found: DataFrame) -> DataFrame:
    """Consolidated characters (with ``display_name``) to doc_id, references, terms and ``facts``, a struct of FACTS."""
    kind = dict((f.name, f.dataType) for f in found.schema.fields)["traits"].valueType
    items = lambda f: F.coalesce(F.try_element_at("traits", F.lit(f)), F.array().cast(kind)).alias(f)
    scalar = lambda f: F.try_element_at("scalars", F.lit(f)).alias(f)
    parts = {
        "appearance": F.struct(scalar("gender"), scalar("apparent_age"), items("physical_traits"), items("clothing_accessories"), items("distinctive_markers")),
        "personality_behavior": F.struct(items("personality_traits"), items("emotional_state"), items("behavioral_tendencies")),
        "social_context": F.struct(items("role_status"), items("relationships")),
        "scene_context": F.struct(items("locations"), items("actions"), items("notes")),
        "titles_roles_descriptors": items("titles_roles_descriptors"), "motivations_goals": items("motivations_goals"),
    }
    return found.select("doc_id", "references", pair_terms().alias("terms"), F.struct(*[parts.get(k, F.col(k)).alias(k) for k in FACTS]).alias("facts"))


def _shown(asks: DataFrame, merged: Callable[[DataFrame], DataFrame], chunks: DataFrame | None) -> DataFrame:
    """``asks`` with the JSON of both sides, a_shown and b_shown, and their hash.

    ``merged`` gives the consolidated characters of (doc_id, key, group_key, member), with their key as doc_id.
    """
    side = lambda name, of: asks.select("doc_id", F.to_json(F.struct("doc_id", "component", "ask", F.lit(name).alias("side"))).alias("key"), F.posexplode(of).alias("member", "group_key"))
    members = cut(side("a", "left").unionByName(side("b", "right")))
    told = cut(facts(merged(members)).withColumnRenamed("doc_id", "key"))
    if chunks is not None:
        books = members.select("doc_id", "key").distinct()
        source = retrieval.source_context(told.join(books, "key").select("doc_id", "key", "references", "terms"), chunks)
        told = told.join(source.select("key", F.struct("snippets", "mentions").alias("source")), "key", "left")
    else:
        told = told.withColumn("source", F.create_map().cast("map<string,string>"))
    told = told.select("key", F.to_json(F.struct("facts", "source")).alias("shown"))
    out = asks
    for name in ("a", "b"):
        keyed = F.to_json(F.struct("doc_id", "component", "ask", F.lit(name).alias("side")))
        out = out.withColumn("key", keyed).join(told.withColumnRenamed("shown", f"{name}_shown"), "key").drop("key")
    seen = F.concat_ws("\n", "a", "b", "a_shown", "b_shown", F.col("score").cast("string"), F.to_json("why"))
    return out.withColumn("hash", F.sha2(seen.cast("binary"), 256))


def _asked(shown: DataFrame, resolver: Resolver) -> DataFrame:
    """(hash, answer): each distinct hash is asked once; the answer is JSON of a decision, or of an error."""

    def side(plain: str, told: str, why: list[str]) -> dict:
        more = json.loads(told)
        return json.loads(plain) | more["facts"] | {"source": more.get("source") or {}, "why": list(why)}

    def answer(row: dict) -> str:
        a, b = (side(row[x], row[f"{x}_shown"], row["why"]) for x in ("a", "b"))
        shared = sorted(set(a["names"]) & set(b["names"]))
        try:
            return json.dumps(coerced(resolver(a | {"shared": shared}, b | {"shared": shared}, row["score"])))
        except Exception as e:  # noqa: BLE001 - the provider's errors leave the pair open
            return json.dumps({"error": str(e)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"hash": rows["hash"], "answer": [answer(r) for r in rows.to_dict("records")]})

    distinct = shown.dropDuplicates(["hash"]).select("hash", "a", "b", "a_shown", "b_shown", "score", "why")
    distinct = cut(distinct)
    parts = max(1, -(-distinct.count() // ASKED))
    return cut(distinct.repartition(parts, "hash").mapInPandas(run, "hash string, answer string"))


def rounds(play: Callable[[DataFrame, DataFrame], DataFrame], members: DataFrame, pairs: DataFrame, resolver: Resolver, merged: Callable[[DataFrame], DataFrame], chunks: DataFrame | None) -> list[DataFrame]:
    """The tables of all components' results; members, pairs and results have doc_id and component.

    ``play(members, facts)`` gives a component's results, or rows with ``ask`` where it waits; facts are pairs and answers.
    """
    spark = members.sparkSession
    answers = spark.createDataFrame([], ANSWERS)
    known = spark.createDataFrame([], "hash string, answer string")
    done = []
    while True:
        facts_of = pairs.unionByName(answers.select("doc_id", "component", F.col("ask").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<string>").alias("why"), "answer"))
        played = cut(play(members, facts_of))
        done.append(played.where("ask is null"))
        asks = played.where("ask is not null")
        if asks.isEmpty():
            return done
        shown = cut(_shown(asks, merged, chunks))
        known = cut(known.unionByName(_asked(shown.join(known, "hash", "left_anti"), resolver)))
        new = shown.join(known, "hash").select("doc_id", "component", "ask", "answer")
        answers = cut(answers.unionByName(new))
        waiting = asks.select("doc_id", "component").distinct()
        members, pairs = members.join(waiting, ["doc_id", "component"], "left_semi"), pairs.join(waiting, ["doc_id", "component"], "left_semi")
