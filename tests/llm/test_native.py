"""Line dedup and quality rules against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest

from keystrata.llm import quality
from keystrata.llm.lines import dedup_lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].add(i)
    out = []
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            k = key(line)
            top = max((x for x in holders[k] if x is not None), default=None)
            if len(k) < min_chars or len(holders[k]) < min_docs or top is None or i == top:
                kept.append(line)
        out.append((i, "\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept)))
    return out


def some(x):
    return sorted(x, key=str)


def test_line_dedup(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    out = dedup_lines(messy)
    assert set(messy.columns) <= set(out.columns)
    got = some((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert got == some(brute_lines(rows))
    assert any(x[3] for x in got)
    assert dedup_lines(nothing).count() == 0


def test_line_dedup_ties_and_names(spark):
    line = "this line is in all of the documents"
    rows = [(1, line), (2, line + "\nX"), (3, f" {line.upper()}\n{line}"), (3, line), (None, line)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, n_lines string")
    out = dedup_lines(df, names=("a", "b")).collect()
    assert some((r["doc_id"], r["text"], r["a"], r["b"]) for r in out) == some(brute_lines(rows))
    assert {r["n_lines"] for r in out} == {"mine"}


def test_rows_of_one_document_count_once(spark):
    """As SQL counts distinct documents: two documents, one of them in two rows, are too few."""
    line = "this line is in all of the documents"
    rows = [(1, line), (1, f"{line}\nagain"), (2, line), (5, f"{line} of three"), (6, f"{line} of three"), (6, f"x\n{line} of three"), (7, f"{line} of three")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert some((r["doc_id"], r["text"]) for r in out) == some([(1, line), (1, f"{line}\nagain"), (2, line), (5, ""), (6, ""), (6, "x"), (7, f"{line} of three")])


def test_line_dedup_equals_its_sql_on_repeated_ids(messy):
    """The SQL takes all rows of an id as one document: it must drop as many lines of it as all its rows lose."""
    import duckdb

    from keystrata.llm.lines import OP4_SQL

    documents = messy.where("doc_id IS NOT NULL").select("doc_id", "text").toPandas()  # noqa: F841 (the SQL reads it)
    expected = {r[0]: (r[1], r[2]) for r in duckdb.sql(OP4_SQL).fetchall()}
    got = defaultdict(lambda: (0, 0))
    for r in dedup_lines(messy.where("doc_id IS NOT NULL")).collect():
        got[r["doc_id"]] = tuple(a + b for a, b in zip(got[r["doc_id"]], (r["n_lines"], r["n_dropped"])))
    assert len(documents) > len(expected) and dict(got) == expected


def brute_features(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def test_base_features(messy, nothing, labels):
    got = some((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality_rules(messy, labels).collect())
    assert got == some((r["doc_id"], *brute_features(r["text"])) for r in messy.collect())
    assert quality.quality_rules(nothing, labels).count() == 0
    assert quality.quality_rules(messy, labels.where("false")).where("kept AND base_failed").count() == 0


def tail(x, n, p):
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))


def test_cutoffs_are_certified(spark, monkeypatch):
    monkeypatch.setattr(quality, "RULES", {"symbols_a_word": [2.0, 1.0, 0.5, 0.1], "chars_a_word": [40.0, 5.0]})
    values = [(i, s, 100, 700, [0, 5, 30, 60, 150][i % 5 if i < 100 else 0] if s == "a" else 0) for s in "ab" for i in range(900)]
    df = spark.createDataFrame([(i + 10_000 * (s == "b"), s, n, c, y, 0, 0, 5, False) for i, s, n, c, y in values], "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_text_lines long, base_failed boolean")
    good = df.selectExpr("doc_id", "1 AS quality").where("doc_id % 9 <> 0")
    alpha, delta = 0.1, 0.05
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.certified_cutoffs(df, good, alpha, delta).collect()}
    expected = {}
    for s in "ab":
        own = [(y / n, c / n) for i, t, n, c, y in values if t == s and (i + 10_000 * (s == "b")) % 9]
        for k, (rule, cutoffs) in enumerate(quality.RULES.items()):
            for cutoff in cutoffs:
                x = sum(v[k] > cutoff for v in own)
                if tail(x, len(own), alpha / 2) > delta / 4:
                    break
                expected[s, rule] = cutoff
    assert got == expected and got["a", "symbols_a_word"] != got["b", "symbols_a_word"]


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_line_dedup", "op7_quality_rules", "op8_jaccard_join"])
def test_query_equals_sql(spark, oracle, name):
    from comparing import same_rows

    from keystrata.llm import queries as llm

    folder, con = oracle
    same_rows(llm.queries()[name](spark, folder), con.sql(llm.oracle_sql()[name]).df())
