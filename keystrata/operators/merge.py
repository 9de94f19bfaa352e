"""Merges of put-logs and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import latest, pairs


def merge_versions(*logs: DataFrame) -> DataFrame:
    """Union of the version sets: distinct (k, rec)."""
    return pairs(reduce(DataFrame.unionByName, [x.select("k", "rec") for x in logs]))


def merge_latest(*tables: DataFrame) -> DataFrame:
    """Any number of tables into one record per key, in one shuffle."""
    return latest(reduce(DataFrame.unionByName, [x.select("k", "rec") for x in tables]))


def outer_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tables of one record per key: k, rec (the greater) and side: left, right or both."""
    a, b = left.select("k", F.col("rec").alias("l_rec")), right.select("k", F.col("rec").alias("r_rec"))
    side = F.when(F.col("r_rec").isNull(), "left").when(F.col("l_rec").isNull(), "right").otherwise("both")
    return a.join(b, "k", "full_outer").select("k", F.greatest("l_rec", "r_rec").alias("rec"), side.alias("side"))
