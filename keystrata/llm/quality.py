"""Quality rules whose cutoffs come with a guarantee, with DataFrame functions only.

Each rule rejects a document whose value is above a cutoff. Cutoffs are chosen per stratum (the
language) on labelled documents: for a cutoff with x false rejections among n good documents, the
exact binomial test P(Bin(n, a) <= x) <= level shows that its false-rejection rate is under a.
A rule's cutoffs are tested from the most lenient on, and testing stops at the first that fails
(fixed-sequence testing, which needs no further correction); the level is divided by the number of
rules and strata (Bonferroni), and the tolerated rate by the number of rules. So with probability
1 - delta, all strata at once lose at most alpha of their good documents to these rules.
A stratum with too few labels gets no cutoff, and keeps what passes the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, WORD_GAP, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ALPHA, DELTA = 0.02, 0.05
#: Rules and their cutoffs, the most lenient first.
RULES: dict[str, list[float]] = {
    "symbols_a_word": [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08],
    "dup_line_share": [0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.29, 0.25, 0.2, 0.15, 0.1],
    "chars_a_word": [40.0, 25.0, 18.0, 14.0, 12.0, 10.0],
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def rule_values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_a_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_text_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "chars_a_word": F.col("word_chars") / words,
    }


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the base counts of each text (null: no words, no lines).

    Windows of 8 words are compared by 64-bit hashes within their document.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id", "stratum",
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
    )
    d = d.select(
        "doc_id", "stratum", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_text_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # positions of windows found twice or more, from neighbours in hash order
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
    d = d.select(
        *[c for c in d.columns if c != "windows"],
        F.when(F.size("windows") > F.size(F.array_distinct("windows")), placed).alias("s"),
    )
    twice = F.array_sort(F.transform(F.filter(F.col("s"), lambda x, k: same("s", k, k - 1) | same("s", k, k + 1)), lambda x: x["i"]))
    d = d.select(*[c for c in d.columns if c != "s"], F.when(F.col("s").isNotNull(), twice).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(-1000).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n")), lambda a: a["n"])
    return d.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_text_lines",
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the strictest certified cutoff of each rule.

    labels: doc_id and quality; documents of quality 1 are the good ones, a repeated doc_id counts
    once and as good if any of its labels says so, null labels are ignored.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    values, rate = rule_values(), alpha / len(RULES)
    tests = [(rule, k, cutoff) for rule, cutoffs in RULES.items() for k, cutoff in enumerate(cutoffs)]
    per = features.where(~F.col("base_failed")).join(good, "doc_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(values[rule] > cutoff, 1)).alias(f"x_{rule}_{k}") for rule, k, cutoff in tests])
    # one row a stratum: the window that counts them is as small
    per = per.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    each = per.select("stratum", "strata", "n", F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("k"), F.lit(cutoff).alias("cutoff"), F.col(f"x_{rule}_{k}").alias("x")) for rule, k, cutoff in tests])))
    log_odds, n = F.lit(rate / (1 - rate)), F.col("n").cast("double")
    step = lambda a, k: F.struct((a["t"] + F.log((n - k) / (k + 1.0)) + F.log(log_odds)).alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))
    start = F.struct((n * F.log(F.lit(1.0 - rate))).alias("t"), F.lit(0.0).alias("s"))
    tail = F.when(F.col("x") < n * rate, F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("x")), start, step, lambda a: a["s"])).otherwise(F.lit(1.0))
    passed = each.withColumn("ok", (tail <= delta / (len(RULES) * F.col("strata"))).cast("int"))
    run = F.min("ok").over(Window.partitionBy("stratum", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return passed.withColumn("run", run).where("run = 1").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """features with kept: false if a base rule fails or a value is above its stratum's certified cutoff."""
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES])
    above = [F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False)) for rule, value in rule_values().items()]
    fails = above[0]
    for a in above[1:]:
        fails = fails | a
    return features.join(wide, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~fails).drop(*[f"cut_{rule}" for rule in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: the base counts, base_failed and kept.

    A null or empty text has no words and fails. A null and an empty language are one stratum. A very long text is judged whole. Rows are
    judged singly, repeated ones alike; a null doc_id has no label; other columns are ignored.
    """
    features = written(base_features(docs), "quality")
    return judged(features, certified_cutoffs(features, labels, alpha, delta))


def _sql() -> str:
    values = {
        "symbols_a_word": "n_symbols / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_text_lines, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)", "chars_a_word": "word_chars / greatest(n_words, 1)",
    }
    rate, level = ALPHA / len(RULES), DELTA / len(RULES)
    grid = ", ".join(f"('{rule}', {k}, CAST({c} AS DOUBLE))" for rule, cs in RULES.items() for k, c in enumerate(cs))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in values.items()) + " END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM h),
t AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r WHERE c >= 2),
c AS (SELECT doc_id, CAST(sum(least(8, coalesce(gap, 8))) AS BIGINT) AS n FROM t GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_text_lines
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
grid AS (SELECT * FROM (VALUES {grid}) AS v(rule, k, cutoff)),
good AS (SELECT b.* FROM b JOIN labels l USING (doc_id) WHERE l.quality = 1 AND NOT base_failed),
x AS (SELECT stratum, rule, k, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS x FROM good, grid GROUP BY ALL),
p AS (SELECT *, CASE WHEN x >= n * {rate} THEN 1.0 ELSE list_sum(list_transform(range(x + 1), lambda j:
        exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln(1 - {rate})))) END AS tail FROM x),
q AS (SELECT *, min(CASE WHEN tail <= {level} / (SELECT count(DISTINCT stratum) FROM x) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY k) AS run FROM p),
u AS (SELECT stratum, rule, min(cutoff) AS cut FROM q WHERE run = 1 GROUP BY stratum, rule),
bad AS (SELECT DISTINCT b.doc_id FROM b JOIN u USING (stratum) WHERE {value} > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM b
"""


OP7_SQL = _sql()
