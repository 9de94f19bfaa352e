"""The pipeline's stages against plain Python, each on what the stage before kept."""

from collections import defaultdict

import pytest
from test_native import brute_lines
from test_near import brute_jaccard, brute_substrings

import corpus_pipeline
from keystrata.llm.common import written
from keystrata.llm.toxicity import THRESHOLD, train_detector

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], FOLDER), "stage"))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxicity_decides_by_score(spark, stages):
    detector = train_detector(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r["doc_id"] for r in detector.scores(stages[0]).collect() if r["score"] < THRESHOLD}
    assert {i for i, _ in pairs(stages[1])} == kept
    assert sorted(pairs(stages[1])) == sorted(p for p in pairs(stages[0]) if p[0] in kept)


def test_lines(stages):
    assert sorted(pairs(stages[2])) == sorted((i, t) for i, t, _, _ in brute_lines(pairs(stages[1])))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_copies(stages):
    keep = {i for i, _, c in brute_jaccard(pairs(stages[2])) if i == c}
    assert sorted(pairs(stages[3])) == sorted(p for p in pairs(stages[2]) if p[0] in keep)


def test_passages(stages):
    before = dict(pairs(stages[3]))
    expected = {i: kept if gone else before[i] for i, _, gone, kept in brute_substrings(list(before.items()), 20)}
    assert dict(pairs(stages[4])) == expected


def test_packing(stages):
    used, documents = defaultdict(list), defaultdict(list)
    for r in stages[5].collect():
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert set(documents) == {i for i, _ in pairs(stages[4])}
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(stages[5])


def test_messy_and_empty(spark, messy, nothing):
    for docs in (messy, nothing):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = written(stage(spark, kept, FOLDER), "stage")
            assert kept.columns == docs.columns
        assert (corpus_pipeline.pack_sequences(spark, kept, FOLDER).count() > 0) == (docs is messy)
