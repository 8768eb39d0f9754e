"""Which characters are worth a card, and cards in their final form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import vocabulary as V
from ..functions.text import alias_form, normalize, slug, strip
from .keys import opened, sealed

# How much of each field counts as substance.
SUBSTANCE = {
    "gender": 1, "apparent_age": 1, "physical_traits": 3, "clothing_accessories": 2, "distinctive_markers": 2, "personality_traits": 2,
    "behavioral_tendencies": 2, "role_status": 2, "relationships": 3, "motivations_goals": 2, "titles_roles_descriptors": 2,
    "locations": 2, "actions": 2, "notes": 2,
}


def substance(counts: Column) -> Column:
    """The capped sum over a map field -> number of items."""
    parts = [F.least(F.coalesce(F.try_element_at(counts, F.lit(f)), F.lit(0)).cast("int"), F.lit(cap)) for f, cap in SUBSTANCE.items()]
    return sum(parts[1:], parts[0])


def is_anecdotal(canonical_norm: Column, entity_type: Column, confidence: Column, refs: Column, names: Column, aliases: Column, appellations: Column, actions: Column, locations: Column) -> Column:
    """Numbers of references, concrete names, aliases and so on; the rules for dropping a character."""
    bare = (refs < 2) & (names < 1)
    unnamed = (entity_type != "named") & bare & (aliases == 0) & (appellations == 0) & (actions + locations == 0)
    weak = (confidence == "low") & (refs <= 1) & (names < 1) & (aliases == 0) & (appellations == 0)
    return (I.is_descriptive(canonical_norm) & bare) | unnamed | weak


def is_eligible(canonical: Column, group: Column, individual: Column, named: Column, s: Column, r: Column, aliases: Column) -> Column:
    """Whether a character gets a card; s is its substance, r its references."""
    single = ~group & ((named & (r >= 1) & (s >= 1)) | (individual & (r >= 1) & (s >= 2)) | (named & (s >= 3)))
    always = ((r >= 3) & (s >= 1)) | (named & (r >= 2) & (s >= 2)) | (named & (s >= 4)) | ((aliases >= 2) & (r >= 2) & (s >= 2))
    return ~normalize(canonical).isin(V.PLACEHOLDER_NAMES) & (single | always)


def clean_strings(values: Column) -> Column:
    return F.filter(F.transform(F.filter(values, lambda v: v.isNotNull()), strip), lambda v: v != "")


def normalize_cards(cards: DataFrame) -> DataFrame:
    """Cards with defaults filled in: canonical_name, main_name, aliases, description, image_prompt, confidence, warnings."""
    main = F.coalesce(F.nullif(strip(F.col("main_name")), F.lit("")), F.col("canonical_name"))
    aliases = F.filter(clean_strings(F.col("aliases")), lambda a: alias_form(a) != alias_form(F.col("__main")))
    unique = F.filter(F.col("aliases"), lambda a, i: F.array_position(F.transform("aliases", alias_form), alias_form(a)) == i + 1)
    out = cards.withColumn("__main", main).withColumn("aliases", F.coalesce(aliases, F.array().cast("array<string>")))
    level = F.when(F.lower(strip(F.col("confidence"))).isin("low", "medium", "high"), F.lower(strip(F.col("confidence")))).otherwise("medium")
    return out.withColumns(
        {
            "id": slug(F.col("__main")),
            "main_name": F.col("__main"),
            "aliases": unique,
            "description": F.coalesce(strip(F.col("description")), F.lit("")),
            "image_prompt": F.coalesce(strip(F.col("image_prompt")), F.lit("")),
            "confidence": level,
            "warnings": F.coalesce(clean_strings(F.col("warnings")), F.array().cast("array<string>")),
        }
    ).drop("__main")


CARD = "main_name string, aliases array<string>, description string, image_prompt string, confidence string, warnings array<string>"
Generator = Callable[[dict], dict]


#: What a generator is told of a character.
PAYLOAD = ("canonical_name", "entity_type", "aliases", "identity_names", "specific_appellations", "traits", "scalars", "confidence", "needs_llm_review", "reasons", "references")


def payload(characters: DataFrame) -> DataFrame:
    """``characters`` with ``payload``, JSON of PAYLOAD, references_count and, where there is one, ``source``."""
    more = ["source"] if "source" in characters.columns else []
    facts = F.struct(*PAYLOAD, F.size("references").alias("references_count"), *more)
    return characters.withColumn("payload", F.to_json(facts))


def plain_card(character: dict) -> dict:
    """A card without a model: a sentence for each field that has values."""
    single = {k: [x["value"]] for k, x in (character.get("scalars") or {}).items()}
    lists = {k: [x["value"] for x in v] for k, v in (character.get("traits") or {}).items()}
    named = {"names": [x["value"] for x in character.get("identity_names") or []]}
    facts = [f"{k}: {', '.join(v)}" for k, v in sorted((named | single | lists).items()) if v]
    name = character["canonical_name"]
    return {"main_name": name, "aliases": list(character.get("aliases") or []), "description": ". ".join(facts), "image_prompt": ", ".join([name, *facts]), "confidence": character.get("confidence"), "warnings": []}


def generate_cards(characters: DataFrame, generator: Generator = plain_card) -> DataFrame:
    """The generator's card for each character (a row with ``payload``, or all its columns); a failure gives a low card with a warning.

    Calls run in Arrow batches, one for each row, wherever it is; ``Pipeline.cards`` gives eligible characters only.
    """
    if "payload" not in characters.columns:
        characters = characters.withColumn("payload", F.to_json(F.struct("*")))
    review = F.col("needs_llm_review") if "needs_llm_review" in characters.columns else F.lit(False)
    kind = characters.schema["doc_id"].dataType
    rows = sealed(characters).select("doc_id", "canonical_name", review.alias("needs_llm_review"), "payload")

    def one(row: dict) -> dict:
        try:
            card = generator(json.loads(row["payload"]))
        except Exception as e:  # noqa: BLE001 - the provider's errors end in the card
            card = {"main_name": row["canonical_name"], "aliases": [], "description": "", "image_prompt": "", "confidence": "low", "warnings": [str(e)]}
        if row.get("needs_llm_review"):
            card = card | {"confidence": "low", "warnings": [*card["warnings"], "identity needs review"]}
        return card

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = pd.DataFrame([one(r) for r in rows.to_dict("records")], columns=["main_name", "aliases", "description", "image_prompt", "confidence", "warnings"])
            yield pd.concat([rows[["doc_id", "canonical_name"]].reset_index(drop=True), made], axis=1)

    return opened(normalize_cards(rows.mapInPandas(run, "doc_id string, canonical_name string, " + CARD)), kind)
