"""Line dedup with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, spare, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: F.Column) -> F.Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line long enough: id and text hash of its document, position, two independent hashes of its key."""
    key = F.col("k")
    return (
        docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
        .select("doc_id", "t", "p", line_key(F.col("line")).alias("k"))
        .where(F.length("k") >= min_chars)
        .select("doc_id", "t", "p", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the text's shared lines dropped: every column of docs, text replaced where a line went, plus n_lines and n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least min_chars
    code points in at least min_docs documents go from all documents but the one of largest doc_id.
    Rows that repeat a doc_id are one document: they count once, and all rows of the
    largest doc_id keep the line. Rows without doc_id are one document below all others; if a key is in them only, they all
    keep it. A null or empty text is one empty line. A very long text is split like any other: its lines are rows of their own,
    and only their hashes and places travel. No rows give no rows.
    names has the names of the two new columns; columns of those names are replaced.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # written, so that texts are split and hashed once
    lines = written(_keys(whole, min_chars), "lines")
    # distinct by key and document, which spreads a hot line over all tasks, then counted with partial sums
    once = lines.select("h1", "h2", "doc_id").distinct()
    shared = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    # written, so that a line which is in very many documents can be split in the join
    shared = written(shared, "shared-lines")
    goes = (
        lines.join(shared, ["h1", "h2"]).where(F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "t").agg(F.collect_set("p").alias("gone"))
    )
    own = {n: spare(docs, n) for n in ("ld_id", "ld_t", "ld_gone", "ld_lines")}
    i, t, gone, split = (F.col(own[n]) for n in ("ld_id", "ld_t", "ld_gone", "ld_lines"))
    goes = goes.select(F.col("doc_id").alias(own["ld_id"]), F.col("t").alias(own["ld_t"]), F.col("gone").alias(own["ld_gone"]))
    out = docs.join(goes, docs["doc_id"].eqNullSafe(i) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == t), "left")
    out = out.withColumn(own["ld_lines"], F.split(F.coalesce("text", F.lit("")), "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    return (
        out.withColumn(names[0], F.size(split).cast("long"))
        .withColumn(names[1], F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn("text", F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda p: F.element_at(split, p + 1)), "\n")))
        .drop(*own.values())
    )


OP4_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT doc_id, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
s AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.p, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN s USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
