"""Document ids of any type, null among them, as strings that are never null while tables are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def sealed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` with the key as JSON: equal keys, null ones too, meet in joins and groups of whatever kind."""
    return df.withColumn(key, F.to_json(F.struct(F.col(key).alias("key"))))


def opened(df: DataFrame, kind: DataType, key: str = "doc_id") -> DataFrame:
    """The inverse of ``sealed``."""
    return df.withColumn(key, F.from_json(key, StructType([StructField("key", kind)]))["key"])
