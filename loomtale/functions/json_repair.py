"""JSON objects out of model answers: fences, and text around the object."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^\s*```(?:json)?\s*(.*?)\s*```\s*$", re.DOTALL | re.IGNORECASE)


def first_object(text: str | None) -> str | None:
    """The answer's JSON object in compact form; null if there is none."""
    if text is None:
        return None
    if m := _FENCE.match(text):
        text = m.group(1)
    try:
        value = json.loads(text)
    except ValueError:
        at = text.find("{")
        try:
            value = json.JSONDecoder().raw_decode(text, at)[0] if at >= 0 else None
        except ValueError:
            value = None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None


def json_object(answer: Column) -> Column:
    """The object as JSON text, for from_json or get_json_object; answers go through Python in Arrow batches."""

    def objects(answers: pd.Series) -> pd.Series:
        return answers.map(first_object)

    return F.pandas_udf(objects, "string")(answer)
