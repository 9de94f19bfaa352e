"""The latest view kept up by Structured Streaming.

State is one record per key. Each micro-batch appends the keys that it changed to a table; a reader takes the
maximum again, which is right in any order and after any repeat, so the sink needs no transaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.views import latest
from ..sources.shared import names_in, remove


def maintain_latest(log_stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that appends changed (k, rec) to table; a batch that is run again replaces its own files."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return latest(log_stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start()


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema("k binary, rec binary, batch bigint").parquet(table).groupBy("k").agg(F.max("rec").alias("rec"))


def compact_latest(spark: SparkSession, table: str) -> None:
    """Replace the batches written so far by one, so that a reader's work follows the keys and not the batches ever written.

    The merged rows get the next free negative number, and only then are the old batches deleted: a reader in between sees
    records twice, which changes no maximum. Run it while no query writes to the table.
    """
    names = [n for n in names_in(spark, table) if n.startswith("batch=")]
    if len(names) < 2:
        return
    number = min(0, *(int(n[6:]) for n in names)) - 1
    read_latest(spark, table).write.mode("errorifexists").parquet(f"{table}/batch={number}")
    for n in names:
        remove(spark, f"{table}/{n}")
