"""The put-log: one row per put, in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.codec import encode


def put_log(df: DataFrame, seq: Column, k: Column, t: Column, v: Column, *keep: Column) -> DataFrame:
    """seq, k BINARY, t BIGINT, v BINARY and the encoded record rec; rows with a null key, time or value are no puts."""
    out = df.select(seq.cast("long").alias("seq"), k.cast("binary").alias("k"), t.cast("long").alias("t"), v.cast("binary").alias("v"), *keep)
    return out.where("k IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL").withColumn("rec", encode("t", "v"))
