"""Quality metrics of extracted characters against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize


def name_metrics(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 over (case_id, name) rows, names compared in normal form."""
    p = predicted.select("case_id", normalize(F.col("name")).alias("n")).distinct().withColumn("p", F.lit(1))
    e = expected.select("case_id", normalize(F.col("name")).alias("n")).distinct().withColumn("e", F.lit(1))
    both = p.join(e, ["case_id", "n"], "full")
    counts = both.agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("hits"), F.count("p").alias("found"), F.count("e").alias("wanted"))
    precision, recall = F.try_divide("hits", "found"), F.try_divide("hits", "wanted")
    return counts.select("hits", "found", "wanted", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("hits"), F.col("found") + F.col("wanted")).alias("f1"))


def alias_accuracy(resolved: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of expected (case_id, canonical, alias) that sit in the canonical name's cluster (case_id, cluster, name)."""
    r = resolved.select("case_id", "cluster", normalize(F.col("name")).alias("n")).distinct()
    e = expected.select("case_id", normalize(F.col("canonical")).alias("c"), normalize(F.col("alias")).alias("a"))
    home = e.join(r.withColumnsRenamed({"n": "c"}), ["case_id", "c"], "left").join(r.withColumnsRenamed({"n": "a", "cluster": "other"}), ["case_id", "a"], "left")
    per_alias = home.groupBy("case_id", "c", "a").agg(F.coalesce(F.bool_or(F.col("cluster") == F.col("other")), F.lit(False)).alias("ok"))
    return per_alias.agg(F.try_divide(F.count_if("ok"), F.count(F.lit(1))).alias("alias_accuracy"))


def leaks(outputs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """How many (case_id, substring) occur in the outputs (case_id, text) of their case."""
    hit = outputs.join(forbidden, "case_id").where(F.contains("text", "substring"))
    return hit.agg(F.count(F.lit(1)).alias("leak_count"))
