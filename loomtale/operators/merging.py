"""Merges on long tables: one row for each observed value, one aggregation for each kind of merge.

traits: doc_id, group_key, section, field, value, chunk_index, local_id, ord and any attributes.
``ord`` orders a document's observations; every "first" is the least of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.identity import is_descriptive, is_generated_id
from ..functions.text import normalize, tokens
from .lineage import once

GROUP = ("doc_id", "group_key")


def _with_references(observed: DataFrame, by: tuple[str, ...], **least: tuple[Column, Column]) -> DataFrame:
    """``by``, ord (the least), for each of ``least`` its value where its order is least, and references; one aggregation by reference, one of those."""
    first = observed.groupBy(*by, "chunk_index", "local_id").agg(F.min("ord").alias("ord"), *[F.min(F.struct(order.alias("at"), value.alias("value"))).alias(k) for k, (value, order) in least.items()])
    places = F.array_sort(F.collect_list(F.struct("ord", "chunk_index", "local_id")))
    references = F.transform(places, lambda r: F.struct(r["chunk_index"].alias("chunk_index"), r["local_id"].alias("local_id"))).alias("references")
    out = first.groupBy(*by).agg(F.min("ord").alias("ord"), *[F.min(k).alias(k) for k in least], references)
    return out.select(*by, "ord", *[F.col(f"{k}.value").alias(k) for k in least], "references")


def _keyed(items: DataFrame) -> DataFrame:
    """``items`` with value_norm, without those that have none."""
    return once(items, value_norm=normalize(F.col("value"))).where(F.coalesce(F.col("value_norm"), F.lit("")) != "")


def merge_references(observed: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """``by`` and references: distinct (chunk_index, local_id), in the order first seen."""
    return _with_references(observed, by).drop("ord")


def merge_values(traits: DataFrame, attributes: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each distinct normal value of a field (and normal ``keys``): the first item's value and attributes, all references."""
    keyed = _keyed(traits)
    keyed = once(keyed, **{f"{k}_norm": F.coalesce(normalize(F.col(k)), F.lit("")) for k in keys}) if keys else keyed
    by = (*GROUP, "section", "field", "value_norm", *[f"{k}_norm" for k in keys])
    whole = _with_references(keyed, by, item=(F.struct("value", *attributes), F.col("ord")))
    return whole.select(*by, "ord", *[F.col(f"item.{c}").alias(c) for c in ("value", *attributes)], "references")


def merge_scalars(traits: DataFrame) -> DataFrame:
    """One row for each group and field: the first value with its references, and the other values with theirs, in order."""
    by = (*GROUP, "section", "field")
    values = _with_references(_keyed(traits), (*by, "value_norm"), value=(F.col("value"), F.col("ord")))
    out = values.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "value", "references"))).alias("v"))
    others = F.transform(F.slice("v", 2, F.size("v")), lambda v: F.struct(v["value"].alias("value"), v["references"].alias("references")))
    first = F.col("v")[0]
    return out.select(*by, first["value"].alias("value"), first["references"].alias("references"), F.size(first["references"]).cast("long").alias("n_references"), others.alias("conflicts"))


def type_rank(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in V.IDENTITY_TYPES]), kind), F.lit(0))


def merge_identity_names(names: DataFrame) -> DataFrame:
    """names: doc_id, group_key, value, type, chunk_index, local_id, ord.  One row for each normal value, the strongest type."""
    return _with_references(_keyed(names), (*GROUP, "value_norm"), value=(F.col("value"), F.col("ord")), type=(F.col("type"), F.struct(-type_rank(F.col("type")), "ord")))


def canonical_order() -> Column:
    """The place of an identity name among those of its character by type, tokens, length, references, then the first; null if it can't be canonical."""
    normal = F.col("value_norm")
    valid = ~is_descriptive(normal) & ~is_generated_id(F.col("value")) & (F.col("type") != "title")
    return F.when(valid, F.struct(-type_rank(F.col("type")), -F.size(tokens(normal)), -F.length("value"), -F.size("references"), "ord"))


def canonical_names(merged: DataFrame) -> DataFrame:
    """(doc_id, group_key, canonical_name): the best identity name of those that have one."""
    return once(merged, place=canonical_order()).where("place is not null").groupBy(*GROUP).agg(F.min_by("value", "place").alias("canonical_name"))


def append_unique(values: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Values distinct by normal form, the first spelling of each, in order, as an array."""
    keyed = values.withColumn("value_norm", normalize(F.col("value"))).where(F.coalesce(F.col("value_norm"), F.lit("")) != "")
    first = keyed.groupBy(*by, "value_norm").agg(F.min("ord").alias("ord"), F.min_by("value", "ord").alias("value"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("values"))


def confidence(needs_review: Column, n_reasons: Column, n_references: Column, n_aliases: Column) -> Column:
    return F.when(needs_review | (n_reasons > 0), "low").when((n_references >= 3) | (n_aliases >= 2), "high").otherwise("medium")


def append_unique_objects(items: DataFrame, key: str, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Structs (column ``item``) distinct by the normal form of one of their fields, the first of each, in order, as an array."""
    keyed = items.withColumn("key_norm", normalize(F.col(f"item.{key}"))).where(F.coalesce(F.col("key_norm"), F.lit("")) != "")
    first = keyed.groupBy(*by, "key_norm").agg(F.min("ord").alias("ord"), F.min_by("item", "ord").alias("item"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]).alias("items"))
