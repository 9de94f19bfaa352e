"""A corpus pipeline: toxicity, line dedup, near-duplicate documents, repeated passages, packing.

Each stage is written as Parquet in the shared folder and read again as the next one's documents. All stages take
rows with nulls in any column, and extra columns of any name, which they pass on (but the last, which returns pieces); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import read_documents, spare, written
from keystrata.llm.jaccard import jaccard_components
from keystrata.llm.lines import dedup_lines
from keystrata.llm.packing import pack
from keystrata.llm.queries import vocabulary
from keystrata.llm.substring import dedup_substrings
from keystrata.llm.toxicity import THRESHOLD, train_detector


def _recounted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars as the text now is."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the detector scores below its threshold.

    A null or empty text scores low and stays; repeated rows score alike, so all stay or all go; a very long text is scored
    whole. A score of exactly the threshold goes.
    """
    score = spare(docs, "score")
    scored = train_detector(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).scores(docs, score)
    return scored.where(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them, that of the largest doc_id.

    A null or empty text is one empty line, which is too short to go, and stays null or empty. Rows of one doc_id are one
    document; rows without one are one document below all others. n_chars follows the text where it isn't null.
    """
    return _recounted(dedup_lines(docs, names=(spare(docs, "n_lines"), spare(docs, "n_dropped"))), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of least doc_id; documents without an id stay.

    Texts without words (null, empty) link with nothing and stay. Rows of one doc_id are one document: all stay or all go. Ties
    can't occur, as ids differ. A very long text is one set like any other.
    """
    found = jaccard_components(docs)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier, in a smaller doc_id or before in the same one, go.

    A null or empty text, and any in which nothing goes, stays as it is. Rows of one doc_id are one document; a null doc_id comes
    before all others. Of equal passages the first one stays. n_chars follows the text where it isn't null.
    """
    names = tuple(spare(docs, n) for n in ("n_words", "n_removed", "kept"))
    return _recounted(dedup_substrings(docs, names=names), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    A null or empty text is one piece of its end id; very long texts are cut into pieces; repeated rows and rows without
    doc_id are packed each. Pieces of one length take the planned slots in order of doc_id and piece.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A detector trained by a kernel machine is beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
