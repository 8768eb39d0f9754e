"""Guardrails as columns: the first rule that fails names the error, null means none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import strip


def extension(name: Column) -> Column:
    """The lower-case last extension, empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def upload_error(name: Column, size: Column) -> Column:
    return F.coalesce(
        F.when(~F.coalesce(extension(name).isin(V.FILE_TYPES), F.lit(False)), "unsupported"),
        F.when(F.coalesce(size, F.lit(0)) <= 0, "empty"),
        F.when(size > V.MAX_UPLOAD_BYTES, "too_large"),
    )


def text_error(text: Column) -> Column:
    """Of the text that a file has given."""
    return F.coalesce(F.when(text.isNull() | (strip(text) == ""), "blank"), F.when(F.length(strip(text)) < V.MIN_TEXT_CHARS, "too_short"))


def prompt_error(prompt: Column) -> Column:
    return F.coalesce(
        F.when(prompt.isNull() | (strip(prompt) == ""), "empty"),
        F.when(F.length(prompt) > V.MAX_PROMPT_CHARS, "too_long"),
        F.when(F.regexp_count(prompt, F.lit(r"(?U)\S+")) < V.MIN_PROMPT_WORDS, "too_few_words"),
        F.when(prompt.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control_characters"),
    )


def passed(df: DataFrame, error: Column) -> DataFrame:
    return df.where(error.isNull())
