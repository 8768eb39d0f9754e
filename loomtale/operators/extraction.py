"""Observations of characters by a pluggable extractor, one call for each chunk."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_repair import first_object

#: The model's answer to a chunk, as text.
Extractor = Callable[[str], str]

_VALUE = "struct<value:string,source:string,evidence_quote:string>"
_TRAIT = "array<struct<value:string,category:string,persistence:string,source:string,evidence_quote:string>>"
CHARACTER = (
    "struct<local_id:string,display_name:string,reference_type:string,"
    f"identity:struct<name_variants:array<{_VALUE}>,mentions:array<struct<surface_form:string,mention_type:string,evidence_quote:string>>,"
    "titles_roles_descriptors:array<struct<value:string,type:string,source:string,evidence_quote:string>>>,"
    f"appearance:struct<gender:{_VALUE},apparent_age:{_VALUE},physical_traits:{_TRAIT},clothing_accessories:{_TRAIT},distinctive_markers:{_TRAIT}>,"
    f"personality_behavior:struct<personality_traits:{_TRAIT},emotional_state:{_TRAIT},behavioral_tendencies:{_TRAIT}>,"
    f"social_context:struct<role_status:{_TRAIT},relationships:array<struct<target:string,relation:string,source:string,evidence_quote:string>>>,"
    f"motivations_goals:{_TRAIT},scene_context:struct<locations:array<{_VALUE}>,actions:array<{_VALUE}>,notes:array<{_VALUE}>>>"
)
ANSWER = f"struct<chunk_index:int,characters:array<{CHARACTER}>>"

_NAME = re.compile(r"(?<![.!?]\s)(?<!^)(?<!\n)\b[A-ZÁÉÍÓÚÑ][a-záéíóúñü]{2,}(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñü]{2,}){0,2}")


def capitalised_names(text: str) -> str:
    """A deterministic extractor without a model: capitalised names inside sentences."""
    names = dict.fromkeys(m.group() for m in _NAME.finditer(text))
    found = [{"local_id": f"char_{i}", "display_name": n, "reference_type": "named", "identity": {"name_variants": [{"value": n, "source": "explicit"}]}} for i, n in enumerate(names)]
    return json.dumps({"characters": found}, ensure_ascii=False)


def extract(chunks: DataFrame, extractor: Extractor = capitalised_names) -> DataFrame:
    """(doc_id, chunk_index, error, characters): answers parsed leniently; a failed chunk keeps its error.

    Chunks are independent, so calls run wherever the chunk's row is, batch by batch.
    """

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            found = first_object(extractor(text))
        except Exception as e:  # noqa: BLE001 - the provider's errors end in the row
            return None, str(e)
        return found, None if found is not None else "no JSON object in the answer"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            answers = [one(t) for t in rows["chunk_text"]]
            yield rows[["doc_id", "chunk_index"]].assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    raw = chunks.select("doc_id", "chunk_index", "chunk_text").mapInPandas(run, f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, chunk_index int, answer string, error string")
    parsed = raw.withColumn("parsed", F.from_json("answer", ANSWER))
    return parsed.select("doc_id", "chunk_index", "error", F.coalesce("parsed.characters", F.array().cast(f"array<{CHARACTER}>")).alias("characters"))
