"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two strings sums over their common subsequences of LENGTH letters, gaps allowed within SPAN
letters, each weighted by DECAY to the power of its extent in either string; so "id-iot", "idxiot" and "idiot" are
close. Strings are a sentence's units: words as letters (case, look-alike digits and inserted
signs undone, their ends marked), long ones in overlapping parts, and runs of single letters joined. The kernel of a
unit is between the unit and landmark units.

Training sentences are the distinct sentences of a bounded sample of labelled documents, labelled as their document (clean if any
clean document has the sentence, so copies count once). Not all sentences of a toxic document are
toxic; units that are in significantly many toxic sentences (binomial tails, Benjamini-Hochberg)
are the positive examples, units of clean sentences the negative ones, with the hardest negatives
added in rounds. The machine is linear in the Nystroem features of landmarks, hence in subsequences: one table of
weights scores any unit. A document's score is a logistic function of its largest
margin and of how many of its units are beyond zero.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_number, release, tidy, whole_text, written

LENGTH, SPAN, DECAY = 4, 8, 0.6
LETTERS = 32
#: Labelled documents that training reads, at most about so many of each kind, drawn by a hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Of that sample the machine is fitted on at most so many positive units (the most significant ones) and clean units (half of them the
#: most common, half drawn by hash), and in each round on HARD more clean ones, those of all with the greatest margins.
LANDMARKS, POSITIVES, NEGATIVES, HARD, ROUNDS = 192, 2000, 8000, 2000, 3
#: False discoveries among positive units; ridge of the machine.
RATE, RIDGE = 0.05, 1.0
PART, STEP = 24, 12
THRESHOLD = 0.3
REMEMBERED = 200_000
#: Digits and signs that stand for letters.
ALIKE = str.maketrans("0134578@$!", "oieastbasi")
NO_UNIT = -4.0
SENTENCE = re.compile(r"[.!?\n]+")
SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_OFFSETS = np.array([(0, *x) for x in itertools.combinations(range(1, SPAN), LENGTH - 1)])
_WEIGHTS = DECAY ** (_OFFSETS[:, -1] - (LENGTH - 1.0))


def letters(token: str) -> str:
    """A token's letters in lower case; accents stay, as they tell words apart."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token)
    token = token.lower()
    inner = token.strip("!$@#*.,;:?\"'()[]{}|-_")
    if not inner.isalpha():
        inner = "".join(c for c in inner.translate(ALIKE) if c.isalpha())
    return inner


def parts(word: str) -> list[str]:
    if len(word) < 2:
        return []
    return [word] if len(word) <= PART else [word[i : i + PART] for i in range(0, len(word) - STEP, STEP)]


def spelled(text: str) -> list[str]:
    """Letters of words written letter by letter."""
    return [w for m in SPELLED.findall(text) for w in parts("".join(letters(x) for x in m.split()))]


def units(text: str) -> list[str]:
    return [*dict.fromkeys([p for t in text.split() for p in parts(letters(t))] + spelled(text))]


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, each between its marks and with SPAN blanks (-1) behind; places of symbols; words' sizes with marks."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32)
    # accented letters share four symbols; letters of other scripts are spread over those of a to z, so that their words differ as much as Latin ones
    code = np.where((code >= 97) & (code <= 122), code - 97, np.where(code < 0x250, 26 + code % 4, code * 7 % 26))
    starts = np.cumsum(sizes + SPAN) - sizes - SPAN
    flat = np.full(int((sizes + SPAN).sum()), -1, np.int32)
    before = np.cumsum(sizes - 2) - (sizes - 2)
    flat[np.repeat(starts + 1 - before, sizes - 2) + np.arange(len(code))] = code
    flat[starts], flat[starts + sizes - 1] = 30, 31
    return flat, np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), sizes


def _norms(sizes: np.ndarray) -> np.ndarray:
    """Norms of words in subsequence space, which depend on their sizes alone (a subsequence that a word has twice counts as two)."""
    return np.sqrt(np.maximum(((_WEIGHTS**2) * np.maximum(sizes[:, None] - _OFFSETS[:, -1], 0)).sum(1), 1e-9))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all gapped subsequences of all words, their weights divided by the word's norm, and word numbers."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    flat, at, sizes = _laid_out(words)
    owner = np.repeat(np.arange(len(words)), sizes)
    codes, weights, owners = [], [], []
    for offsets, weight in zip(_OFFSETS, _WEIGHTS):
        ok = np.flatnonzero(flat[at + offsets[-1]] >= 0)
        code = flat[at[ok]].astype(np.int64)
        for o in offsets[1:]:
            code = code << 5 | flat[at[ok] + o]
        codes.append(code)
        weights.append(np.full(len(ok), weight))
        owners.append(owner[ok])
    code, weight, own = (np.concatenate(x) for x in (codes, weights, owners))
    return code, weight / _norms(sizes)[own], own


class Machine:
    """Kernel machine in subsequence space: a weight for each code, and a bias."""

    def __init__(self, positive: list[str], common: list[str], by_hash: list[str], hardest: Callable[["Machine", int], list[tuple[str, float]]]):
        """common, by_hash: clean units to start from; hardest gives those of all clean units with the greatest margins."""
        self.table, self.bias = np.zeros(LETTERS**LENGTH, np.float32), -1.0
        if not positive or not common:
            return
        negative = [*dict.fromkeys(common + by_hash)]
        half = LANDMARKS // 2
        marks = [*dict.fromkeys(positive[:half] + by_hash[:half])]
        code, weight, own = subsequences(marks)
        met = np.unique(code)
        place = np.full(LETTERS**LENGTH, -1, np.int32)
        place[met] = np.arange(len(met), dtype=np.int32)
        land = np.zeros((len(marks), len(met)), np.float32)
        np.add.at(land, (own, place[code]), weight)
        value, vector = np.linalg.eigh((land @ land.T).astype(np.float64))
        good = value > 1e-6 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])

        def nystroem(words: list[str]) -> np.ndarray:
            out = []
            for i in range(0, len(words), 100):
                code, weight, own = subsequences(words[i : i + 100])
                dense = np.zeros((len(words[i : i + 100]), len(met)), np.float32)
                hit = place[code] >= 0
                np.add.at(dense, (own[hit], place[code[hit]]), weight[hit])
                out.append((dense @ land.T).astype(np.float64) @ root)
            return np.vstack(out)

        for _ in range(ROUNDS):
            x = np.vstack([nystroem(positive), nystroem(negative)])
            y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
            w, self.bias = self._fit(x, y)
            self.table[:] = 0
            self.table[met] = (root @ w) @ land
            known = set(negative)
            hard = [word for word, margin in hardest(self, HARD) if margin > -0.9 and word not in known]
            if not hard:
                break
            negative += hard

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Support vector machine with squared hinge loss, by Newton steps; the two kinds weigh alike."""
        x = np.hstack([x, np.ones((len(x), 1))])
        cost = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y)
        ridge = np.full(x.shape[1], RIDGE)
        ridge[-1] = 1e-3
        w = np.zeros(x.shape[1])
        loss = lambda w: 0.5 * (ridge * w * w).sum() + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
        now = loss(w)
        for _ in range(50):
            slack = np.maximum(0, 1 - y * (x @ w))
            live = slack > 0
            gradient = ridge * w - 2 * x.T @ (cost * y * slack)
            step = np.linalg.solve(np.diag(ridge) + 2 * (x[live].T * cost[live]) @ x[live], gradient)
            rate = 1.0
            while rate > 1e-6 and (then := loss(w - rate * step)) > now:
                rate /= 2
            if rate <= 1e-6 or now - then < 1e-9 * abs(now):
                break
            w, now = w - rate * step, then
        return w[:-1], float(w[-1])

    def margins(self, words: list[str]) -> np.ndarray:
        """What subsequences() and the table give, summed at each word's places without listing the subsequences."""
        out = []
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            flat, at, sizes = _laid_out(part)
            symbol = [flat[at + o] for o in range(SPAN)]
            there = [x >= 0 for x in symbol]
            symbol = [np.maximum(x, 0) for x in symbol]
            sums = np.zeros(len(at), np.float32)
            for a in range(1, SPAN - 2):
                two = symbol[0] << 5 | symbol[a]
                for b in range(a + 1, SPAN - 1):
                    three = (two << 5 | symbol[b]) << 5
                    for c in range(b + 1, SPAN):
                        sums += self.table[three | symbol[c]] * (there[c] * np.float32(DECAY ** (c - LENGTH + 1)))
            out.append(np.bincount(np.repeat(np.arange(len(part)), sizes), sums, len(part)) / _norms(sizes) + self.bias)
        return np.concatenate(out) if out else np.zeros(0)


class Scorer:
    """Features of documents: largest margin, units beyond zero (log), and their share. Remembers tokens' margins."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def features(self, texts: list[str]) -> np.ndarray:
        tokens = [set(t.split()) for t in texts]
        new = [*set().union(*tokens).difference(self.known)]
        split = [parts(letters(t)) for t in new]
        flat = [p for ps in split for p in ps]
        margins, at = self.machine.margins(flat).tolist(), 0
        for t, ps in zip(new, split):
            self.known[t] = max(margins[at : at + len(ps)], default=NO_UNIT)
            at += len(ps)
        out = np.empty((len(texts), 3))
        for i, (text, own) in enumerate(zip(texts, tokens)):
            m = np.fromiter(map(self.known.__getitem__, own), float, len(own))
            m = np.append(m, NO_UNIT)
            if extra := spelled(text):
                m = np.concatenate([m, self.machine.margins(extra)])
            beyond = np.count_nonzero(m > 0)
            out[i] = max(-2.0, min(2.0, float(m.max()))), math.log1p(beyond), math.log1p(beyond) / math.log(3 + len(own))
        for t in new[max(0, REMEMBERED - len(self.known) + len(new)) :]:
            del self.known[t]
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.5 * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.5 * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _log_tail(t: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """log P(Bin(n, rate) >= t) by its Chernoff bound, which is above it; 0 where t is no more than expected."""
    q = t / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = q * np.log(q / rate) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - rate)), 0)
    return np.where(q > rate, -n * kl, 0.0)


def sample_labels(labels: DataFrame, folds: int, held: int) -> DataFrame:
    """doc_id, toxic of at most about SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents outside the held-out fold."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(doc_number() % folds != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}  # two rows
    share = lambda kind, most: min(1.0, most / max(1, n.get(kind, 0)))
    cut = F.when(F.col("toxic") == 1, share(1, SAMPLE_TOXIC)).otherwise(share(0, SAMPLE_CLEAN))
    return own.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)) < cut)


def _hardest(clean: DataFrame, machine: Machine, most: int) -> list[tuple[str, float]]:
    """Of all clean units the `most` with the greatest margins, each with it, in that order."""
    shared = clean.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            margin = shared.value.margins(batch.column(0).to_pylist())
            top = np.argsort(-margin, kind="stable")[:most]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(top)), pa.array(margin[top].astype(np.float64))], names=["unit", "margin"])

    rows = clean.select("unit").mapInArrow(tidy(run), "unit string, margin double").orderBy(F.col("margin").desc(), "unit").limit(most).toArrow()
    return list(zip(rows["unit"].to_pylist(), rows["margin"].to_pylist()))


class Detector:
    """Trained on labelled documents: doc_id, text, toxic."""

    def __init__(self, train: DataFrame):
        train = train.select("doc_id", whole_text().alias("text"), F.col("toxic").cast("int").alias("toxic")).persist()

        def sentences(batches):
            for batch in batches:
                out: list[list] = [[], [], []]
                for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    for s in SENTENCE.split(text):
                        if own := units(s):
                            for col, v in zip(out, (xxhash.xxh64_intdigest(" ".join(own)) - (1 << 63), toxic, own)):
                                col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.string()))], names=["s", "toxic", "units"])

        each = train.mapInArrow(tidy(sentences), "s bigint, toxic int, units array<string>").groupBy("s").agg(F.min("toxic").alias("toxic"), F.first("units").alias("units"))
        stats = written(each.select("toxic", F.explode("units").alias("unit")).groupBy("unit").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")), "units")
        sums = stats.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
        rate = min(0.9, max(1e-6, (sums["t"] or 0) / max(1, sums["n"] or 0)))
        n_tests = stats.where("t >= 2").count()
        test = stats.where("t >= 2").toArrow().to_pandas()  # at most the units of a bounded sample
        positive: list[str] = []
        if len(test):
            test["p"] = _log_tail(test["t"].to_numpy(float), test["n"].to_numpy(float), rate)
            test = test.sort_values(["p", "unit"])
            passed = np.flatnonzero(test["p"].to_numpy() <= np.log(RATE * np.arange(1, len(test) + 1) / n_tests))
            test = test.iloc[: passed.max() + 1 if len(passed) else 0]
            positive = test[test["t"] >= 0.7 * test["n"]]["unit"].head(POSITIVES).tolist()
        del test
        spark = train.sparkSession
        clean = stats.where("n > t").join(F.broadcast(spark.createDataFrame([(w,) for w in positive], "unit string")), "unit", "left_anti")
        first = lambda *order: clean.orderBy(*order, "unit").select("unit").limit(NEGATIVES // 2).toArrow()["unit"].to_pylist()
        self.machine = Machine(positive, first(F.col("n").desc()), first(F.xxhash64("unit")), lambda machine, most: _hardest(clean, machine, most))
        release(train.sparkSession)
        self.positive = positive
        rows = self._features(train).toArrow().to_pandas()  # bounded by the sample
        train.unpersist()
        x, y = np.array(rows["x"].tolist(), float).reshape(-1, 3), rows["toxic"].to_numpy(float)
        self.weights = logistic(x, y, np.ones(len(y))) if len(set(y)) == 2 else np.array([0.0, 0.0, 0.0, -3.0])

    def _features(self, train: DataFrame) -> DataFrame:
        shared = train.sparkSession.sparkContext.broadcast(self.machine)

        def run(batches):
            s = Scorer(shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    x = s.features(batch.column(0).slice(at, 256).to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, 256), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

        return train.select("text", "toxic").mapInArrow(tidy(run), "toxic int, x array<double>")

    def scores(self, docs: DataFrame, column: str = "score") -> DataFrame:
        """docs with each row's score as one more column."""
        shared = docs.sparkSession.sparkContext.broadcast((self.machine, self.weights))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double"
        text = docs.columns.index("text")

        def run(batches):
            machine, w = shared.value
            s = Scorer(machine)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    x = s.features([t or "" for t in part.column(text).to_pylist()])
                    score = 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, column])

        return docs.mapInArrow(tidy(run), schema)


def train_detector(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Detector:
    """On labelled documents whose crc32(doc_id as text) mod folds isn't `held`."""
    sample = sample_labels(labels, folds, held)
    return Detector(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # some SAMPLE_TOXIC + SAMPLE_CLEAN rows


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.3).

    Rows are scored by their text alone; a null or empty text has no units and scores low. A very long text is scored whole: its
    distinct tokens are its units. Repeated
    rows score alike; a null doc_id has no label and counts as empty text for held_out. With no labels of
    either kind all scores are the same low one. Other columns are ignored. No rows give no rows.
    """
    detector = train_detector(docs, labels, folds, held)
    rows = docs.select("doc_id", whole_text().alias("text"), (doc_number() % folds == held).alias("held_out"))
    return detector.scores(rows).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


__all__ = ["Detector", "score_toxicity", "train_detector"]
