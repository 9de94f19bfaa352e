"""Hierarchical Pitman-Yor language model with seating sampled by Gibbs.

Each training word, and the start of a text, is a context: its restaurant serves the words that follow it, and the end.
The parent of these restaurants draws a token in two steps. A restaurant for each class of contexts (the class of the word
before, or the start) serves classes: each of the most frequent words, the end, and the other words by
their endings. Class restaurants share one parent over classes. A word of an ending is then drawn from the ending's
restaurant, whose base spells it byte by byte, backwards, so that the ending comes first and the
rest is drawn given it: spelling restaurants for four bytes share parents for three bytes, and so on to one root. All
contexts that the words have get restaurants: the most frequent ones are seated by the driver and sent to every worker, the
others are seated side by side, by their last three bytes, and joined to the words that have them.
The customers of a parent are the tables of its children, down to the spelling of each table of the words.

Seating is sampled as the number of tables t of each dish's c customers. With the discount fixed at
1/2, the number of seatings has the closed form (2c-t-1)! / ((c-t)! (t-1)!) 4^(t-c), so each
Gibbs step draws t from its conditional: exactly while its spread is up to 10 tables, and beyond (dishes of many hundreds
of customers) over a grid of 65 numbers of tables, a fifth of the spread apart. Dishes of a level are drawn side by side, given
the totals of the sweep before. Discount and strength are constants. Predictive probabilities are averaged over the sweeps
after the burn-in.

All counts cover all training documents. Texts are tokenised once, into chunks: the distinct words of some thousand
documents, and their tokens as numbers into these. Pairs of a context and a word travel as arrays by chunk and bucket of the context
(a frequent context's by the pair), twice: first the tables that all pairs have are drawn, for the parents' customers; when the
parents' seating is sampled, each bucket samples its restaurants once more and scores all tokens. A pair that
occurs once has one table, so only the others are drawn, and tables are counted as customers less what these others save. The
classes are a fixed number, so their counts fit the driver.
"""

from __future__ import annotations

import math
import time
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_number, qualified, release, remove, shared_path, tidy, whole_text, written
from .hashing import LOWER, hashed_words, mix

DISCOUNT, STRENGTH = 0.5, 1.0
#: Frequent words and endings of other words: a class and a context each.
FREQUENT, ENDINGS = 1000, 200
#: Words sent to every worker, the most frequent ones, and bytes that they may have; the others are joined.
DIRECT, DIRECT_BYTES = 200_000, 8 << 20
BURN_IN, SAMPLES = 4, 6
#: Pairs that are sent to every worker (20 bytes each) are those with more than 1 / DIRECT_PAIRS of all tokens, so there are no more than this; the others' tokens go to the pair's bucket.
DIRECT_PAIRS = 1_000_000
#: Sweeps over the pairs after the parents' last: first those that are dropped.
PAIR_BURN_IN, PAIR_SAMPLES = 1, 2
#: Sweeps over the words, which start with a table for each: first those that are dropped.
WORD_BURN_IN, WORD_SAMPLES = 2, 2
SYMBOLS, END, START, SIDE = 257, 256, 257, 258
#: Spelling contexts of 4 bytes, and of 3, whose restaurants are sent to every worker, the most frequent ones; the others' are joined.
KEPT = 100_000
#: Cells of the other spelling contexts that are seated at once, about; and sweeps over them: first those that are dropped.
SEATED = 200_000
REST_BURN_IN, REST_SAMPLES = 1, 2
#: Distinct cells that a counting task holds before it passes them on.
HELD = 1_000_000
#: Bytes of text, and documents, of a chunk (a longer document is a chunk of its own).
CHUNK_BYTES, CHUNK_DOCS = 4 << 20, 50_000
#: Tokens that a bucket of contexts has on average at most, however large the splits of the input are: a task holds a whole bucket.
BUCKET_TOKENS = 1_000_000
#: Of codes and payloads: Spark's rows, batches, shuffles and files hold them compressed.
_ZSTD = pa.Codec("zstd", 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series from 8 on; below, shifted up by the recurrence."""
    x = np.asarray(x, np.float64)
    y = np.where(x < 8, x + 8, x)
    z = 1 / y
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + z * (1 / 12 - z * z * (1 / 360 - z * z * (1 / 1260 - z * z / 1680)))
    small = x < 8
    if small.any():
        s = x[small]
        p = s.copy()
        for k in range(1, 8):
            p = p * (s + k)
        out[small] -= np.log(p)
    return out


#: log of the number of seatings of c customers at t tables, for c and t up to 8.
_SMALL = np.full((9, 9), -np.inf)
for _c in range(1, 9):
    for _t in range(1, _c + 1):
        _SMALL[_c, _t] = math.lgamma(2 * _c - _t) - math.lgamma(_c - _t + 1) - math.lgamma(_t) + _t * math.log(4)


def draw_tables(c: np.ndarray, a: np.ndarray, u: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Numbers of tables for c >= 1 customers each: a is the weight of a new table, (strength + discount x tables of other dishes) x parent's probability, u uniform.

    others: the tables of the restaurant's other dishes. Each own table makes a further one likelier, so the conditional is the
    number of seatings in t tables, times a^t, times the product of 1 + j / (strength / discount + others) for j below t;
    without others the last product is left out. The mode is found by a closed form for a^t and iteration, and t is drawn by
    inversion over a grid around it, of step 1 unless the spread is over 10.
    """
    c, a = c.astype(np.float64), np.maximum(a.astype(np.float64), 1e-300)
    x_of = None if others is None else STRENGTH / DISCOUNT + others.astype(np.float64)
    out = np.ones(len(c))
    few = np.flatnonzero((c > 1) & (c <= 8))
    for at in range(0, len(few), 100_000):
        k = few[at : at + 100_000]
        logs = np.arange(1, 9) * np.log(a[k])[:, None] + _SMALL[c[k].astype(int), 1:]
        if x_of is not None:
            logs += np.cumsum(np.log1p(np.arange(8) / x_of[k][:, None]), 1)
        p = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
        out[k] = np.minimum(1 + (p < (u[k] * p[:, -1])[:, None]).sum(1), c[k])
    many = np.flatnonzero(c > 8)
    for at in range(0, len(many), 4000):
        k = many[at : at + 4000]
        n, w = c[k], a[k]
        x, mode = np.full(len(k), np.inf) if x_of is None else x_of[k], np.zeros(len(k))
        for _ in range(1 if x_of is None else 24):
            near = w * (1 + mode / x)
            b = 2 * n - 1 + 4 * near
            mode = np.clip(8 * near * n / (b + np.sqrt(np.maximum(b * b - 16 * near * n, 0))), 1, n)
        mode = np.clip(np.round(mode), 1, n)
        curve = 1 / mode + 1 / np.maximum(n - mode, 0.5) - 1 / np.maximum(2 * n - mode, 1) - 1 / (x + mode)
        step = np.maximum(1, np.floor(1 / np.sqrt(np.maximum(curve, 1e-12)) / 5))
        low = np.maximum(mode - 32 * step, 1)
        t = low[:, None] + np.arange(65) * step[:, None]
        logs, one = np.empty(t.shape), step == 1
        if one.any():
            # by the ratio of one more table to so many
            v, m = t[one, :-1], n[one, None]
            more = 1 if x_of is None else 1 + v / x[one, None]
            logs[one, 0] = 0
            with np.errstate(divide="ignore"):
                logs[one, 1:] = np.cumsum(np.log(4 * w[one, None] * more * np.maximum(m - v, 0) / (np.maximum(2 * m - v - 1, 1) * v)), 1)
        if not one.all():
            v, m, g = np.minimum(t, n[:, None])[~one], n[~one, None], w[~one, None]
            far = v * np.log(g) + lgamma(2 * m - v) - lgamma(m - v + 1) - lgamma(v) + v * math.log(4)
            if x_of is not None:
                y = x[~one, None]
                far += np.where(y > 1e8, v * (v - 1) / (2 * y), lgamma(y + v) - lgamma(y) - v * np.log(y))
            logs[~one] = far
        logs = np.where(t <= n[:, None], logs, -np.inf)
        t = np.minimum(t, n[:, None])
        p = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
        pick = (p < (u[k] * p[:, -1])[:, None]).sum(1)
        out[k] = t[np.arange(len(k)), np.minimum(pick, 64)]
    return out


class Seating:
    """A hierarchy of levels of restaurants, from the longest contexts to the root.

    direct: for each level (rows, dishes, counts) of customers that come by themselves; up: for each level but the
    last, the row of each row's parent. A level's customers are its direct ones and its children's tables.
    """

    def __init__(self, direct: list[tuple[np.ndarray, np.ndarray, np.ndarray]], up: list[np.ndarray], dishes: int, seed: int):
        self.up, self.dishes, self.rng = up, dishes, np.random.default_rng(seed)
        self.cells: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        for i, (r, k, c) in enumerate(direct):
            cells = r.astype(np.int64) * dishes + k
            from_below = up[i - 1][self.cells[-1] // dishes] * dishes + self.cells[-1] % dishes if i else cells[:0]
            all_ = np.unique(np.concatenate([cells, from_below]))
            self.own.append(np.bincount(np.searchsorted(all_, cells), c, len(all_)))
            self.at.append(np.searchsorted(all_, from_below))
            self.cells.append(all_)
        self.tables = [np.ones(len(c)) for c in self.cells]

    def customers(self, i: int) -> np.ndarray:
        return self.own[i] + (np.bincount(self.at[i], self.tables[i - 1], len(self.cells[i])) if i else 0)

    def n_rows(self, i: int) -> int:
        return len(self.up[i]) if i < len(self.up) else 1

    def shares(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, its cells' own parts of their probabilities, and its rows' weights of their parents."""
        out = []
        for i in range(len(self.cells)):
            r, c, n = self.cells[i] // self.dishes, self.customers(i), self.n_rows(i)
            t = np.minimum(self.tables[i], c)
            all_ = STRENGTH + np.bincount(r, c, n)
            out.append(((c - DISCOUNT * t) / all_[r], (STRENGTH + DISCOUNT * np.bincount(r, t, n)) / all_))
        return out

    def at_cells(self, shares: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """For each level, its cells' probabilities; a cell's parent has that cell too."""
        out = [np.full(len(self.cells[-1]), 1 / self.dishes)]
        for i in range(len(self.cells) - 1, -1, -1):
            own, back = shares[i]
            out.append(own + back[self.cells[i] // self.dishes] * (out[-1][self.at[i + 1]] if i + 1 < len(self.cells) else out[-1]))
        return out[:0:-1]

    def mean_shares(self, burn_in: int = BURN_IN, samples: int = SAMPLES) -> list[tuple[np.ndarray, np.ndarray]]:
        """shares(), averaged over the sweeps after the burn-in: each row's sum to 1 as in every sweep."""
        total = None
        for s in range(burn_in + samples):
            self.sweep()
            if s >= burn_in:
                new = self.shares()
                total = new if total is None else [(a + x, b + y) for (a, b), (x, y) in zip(total, new)]
        return [(a / samples, b / samples) for a, b in total]

    def predictive(self, i: int) -> np.ndarray:
        """Dense probabilities of level i: a row for each restaurant."""
        base = np.full((1, self.dishes), 1 / self.dishes, np.float32)
        for j in range(len(self.cells) - 1, i - 1, -1):
            r, k, c, n = self.cells[j] // self.dishes, self.cells[j] % self.dishes, self.customers(j), self.n_rows(j)
            t = np.minimum(self.tables[j], c)
            all_, tables = np.bincount(r, c, n), np.bincount(r, t, n)
            own = (base[self.up[j]] if j < len(self.up) else base) * ((STRENGTH + DISCOUNT * tables) / (STRENGTH + all_)).astype(np.float32)[:, None]
            own[r, k] += ((c - DISCOUNT * t) / (STRENGTH + all_)[r]).astype(np.float32)
            base = own
        return base

    def sweep(self) -> None:
        for i in range(len(self.cells)):
            r, c = self.cells[i] // self.dishes, self.customers(i)
            parent = self.at_cells(self.shares())[i + 1][self.at[i + 1]] if i + 1 < len(self.cells) else np.full(len(c), 1 / self.dishes)
            tables = np.bincount(r, self.tables[i], self.n_rows(i))
            others = np.maximum(tables[r] - self.tables[i], 0)
            self.tables[i] = draw_tables(c, (STRENGTH + DISCOUNT * others) * parent, self.rng.random(len(c)), others)

    def averaged(self, levels: tuple[int, ...] = (0,), burn_in: int = BURN_IN, samples: int = SAMPLES) -> list[np.ndarray]:
        """Predictive probabilities of the levels, averaged over the sweeps after the burn-in."""
        total = [0.0] * len(levels)
        for s in range(burn_in + samples):
            self.sweep()
            if s >= burn_in:
                for n, i in enumerate(levels):
                    total[n] = total[n] + self.predictive(i)
        return [x / samples for x in total]


class Speller:
    """Spelling probabilities by the bytes before: restaurants of all contexts of 4 bytes that are given, and of those of 3, 2, 1 and 0 that are given or met.

    Only cells that have customers are held, and each context's weight of its parent, which gives it all other symbols.
    """

    def __init__(self, cells: list[tuple[np.ndarray, np.ndarray]], classes: "Classes", seed: int):
        """cells: for orders 4, 3, 2, 1: codes (context x SYMBOLS + symbol) and counts of the customers that come by themselves."""
        direct, contexts, below = [], [], np.zeros(0, np.int64)
        for order, (code, count) in zip((4, 3, 2, 1), cells):
            met = np.unique(np.concatenate([code // SYMBOLS, below]))
            contexts.append(met)
            direct.append((np.searchsorted(met, code // SYMBOLS), code % SYMBOLS, count))
            below = met % SIDE ** (order - 1)
        none = np.zeros(0, np.int64)
        direct.append((none, none, np.zeros(0)))
        self.up = [np.searchsorted(contexts[i + 1], contexts[i] % SIDE ** (3 - i)) for i in range(3)] + [np.zeros(len(contexts[3]), np.int64)]
        seating = Seating(direct, self.up, SYMBOLS, seed)
        shares = seating.mean_shares()
        self.contexts = [*contexts, np.zeros(1, np.int64)]
        self.codes = [x[c // SYMBOLS] * SYMBOLS + c % SYMBOLS for x, c in zip(self.contexts, seating.cells)]
        self.log_p = [np.log(p).astype(np.float32) for p in seating.at_cells(shares)]
        self.log_back = [np.log(back).astype(np.float32) for _, back in shares]
        self.first = np.cumsum([0] + [len(c) for c in contexts])
        self.classes, self.log_mass = classes, np.zeros(classes.n)
        self._masses()

    def log_cells(self, context: np.ndarray, symbol: np.ndarray, longest: int = 4) -> np.ndarray:
        """log of the probability of each symbol after a context, of which at most the `longest` last bytes count."""
        out, left = np.zeros(len(context)), np.arange(len(context))
        for order in range(longest, -1, -1):
            codes, contexts = self.codes[4 - order], self.contexts[4 - order]
            x, k = context[left] % SIDE**order, symbol[left]
            if len(codes):
                at = np.minimum(np.searchsorted(codes, x * SYMBOLS + k), len(codes) - 1)
                hit = codes[at] == x * SYMBOLS + k
                out[left[hit]] += self.log_p[4 - order][at[hit]]
                left, x = left[~hit], x[~hit]
            if len(contexts):
                at = np.minimum(np.searchsorted(contexts, x), len(contexts) - 1)
                out[left] += np.where(contexts[at] == x, self.log_back[4 - order][at], 0)
        out[left] -= math.log(SYMBOLS)
        return out

    @cached_property
    def logs(self) -> np.ndarray:
        """A dense row for each context, for spellers of few contexts. Whoever takes them may change them: words are spelled by them from then on."""
        base, out = np.full((1, SYMBOLS), 1 / SYMBOLS), []
        for i in range(4, -1, -1):
            base = np.exp(self.log_back[i])[:, None] * (base[self.up[i]] if i < 4 else base)
            base[np.searchsorted(self.contexts[i], self.codes[i] // SYMBOLS), self.codes[i] % SYMBOLS] = np.exp(self.log_p[i])
            out.append(base)
        return np.log(np.vstack(out[::-1])).astype(np.float32)

    def _log_at(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.logs[self.rows(context), symbol].astype(np.float64) if "logs" in self.__dict__ else self.log_cells(context, symbol)

    def _masses(self, more: np.ndarray | float = 0.0) -> None:
        """log of the mass, for each class of other words, of the strings that are its words: they have its ending and aren't frequent.

        more: for the frequent words, what contexts that aren't held here add to their logs.
        """
        k = self.classes
        mass = np.zeros(k.n)
        start = np.full(1, ((START * SIDE + START) * SIDE + START) * SIDE + START)
        at_start = self._log_at(np.repeat(start, SYMBOLS), np.arange(SYMBOLS))
        for ending, i in k.endings.items():
            last, before = ending[1], ending[0]
            mass[i] = math.exp(at_start[last] + float(self._log_at(start % SIDE**3 * SIDE + last, np.array([before]))[0]))
        mass[k.other] = 1 - math.exp(at_start[END]) - mass[k.first_ending : k.other].sum()
        frequent = list(k.frequent)
        if frequent:
            own = np.exp(self.log_raw(frequent) + more)
            np.subtract.at(mass, [k.endings.get(w[-2:], k.other) for w in frequent], own)
        self.log_mass = np.log(np.maximum(mass, 1e-12))

    def rows(self, context: np.ndarray) -> np.ndarray:
        """The row of logs of the longest suffix of each context of 4 bytes that has one."""
        out = np.full(len(context), self.first[4], np.int64)
        left = np.arange(len(context))
        for i, order in enumerate((4, 3, 2, 1)):
            if not len(left) or not len(self.contexts[i]):
                continue
            c = context[left] % SIDE**order
            at = np.minimum(np.searchsorted(self.contexts[i], c), len(self.contexts[i]) - 1)
            hit = self.contexts[i][at] == c
            out[left[hit]] = self.first[i] + at[hit]
            left = left[~hit]
        return out

    def log_raw(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        context, symbol, owner = spelling(words)
        return np.bincount(owner, self._log_at(context, symbol), len(words))

    def log_of(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's base probability given its ending; the words aren't frequent ones."""
        k = self.classes
        return self.log_raw(words) - self.log_mass[np.fromiter((k.endings.get(w[-2:], k.other) for w in words), np.int64, len(words))]


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte, from the last to the first, and the end of each word: the code of the 4 bytes spelled before, symbol, word number."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 5) - 1
    starts = ends - lengths - 4
    flat = np.full(int(lengths.sum()) + 5 * len(words), START, np.int64)
    before = np.cumsum(lengths) - lengths
    flat[np.repeat(starts + 4 - before, lengths) + np.arange(int(lengths.sum()))] = np.frombuffer(b"".join([w[::-1] for w in words]), np.uint8)
    flat[ends] = END
    at = np.repeat(starts + 4 - before - np.arange(len(words)), lengths + 1) + np.arange(int(lengths.sum()) + len(words))
    context = ((flat[at - 4] * SIDE + flat[at - 3]) * SIDE + flat[at - 2]) * SIDE + flat[at - 1]
    return context, flat[at], np.repeat(np.arange(len(words)), lengths + 1)


class Classes:
    """Numbers of classes, and of contexts alike: 0..F-1 frequent words, F the end as a class and the start as a context, then endings, the last for all others."""

    def __init__(self, frequent: list[bytes], endings: list[bytes]):
        self.frequent, self.edge = {w: i for i, w in enumerate(frequent)}, len(frequent)
        self.first_ending = self.edge + 1
        self.endings = {e: self.first_ending + i for i, e in enumerate(endings)}
        self.other = self.first_ending + len(endings)
        self.n = self.other + 1

    def of(self, word: bytes) -> int:
        i = self.frequent.get(word)
        return i if i is not None else self.endings.get(word[-2:], self.other)


def _spelling_codes(seated: DataFrame) -> DataFrame:
    """code (4 bytes before x SYMBOLS + symbol), c: all bytes and ends of the tables of words, with c = 0 where only words without tables have them; written."""

    def merged(parts):
        code, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return code, np.bincount(back, np.concatenate([c for _, c in parts]), len(code))

    def batch_of(parts):
        code, c = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(c)], names=["code", "c"])

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0))]
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at in range(0, len(words), 20_000):
                context, symbol, owner = spelling(words[at : at + 20_000])
                held.append((context * SYMBOLS + symbol, batch.column(1).slice(at, 20_000).to_numpy()[owner]))
                if sum(len(x) for x, _ in held) > 2 * HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD:
                        yield batch_of(held)
                        held = [(np.zeros(0, np.int64), np.zeros(0))]
        yield batch_of(held)

    return written(seated.select("w", "t").mapInArrow(tidy(run), "code bigint, c double").groupBy("code").agg(F.sum("c").alias("c")), "spelling")


class Rest:
    """The restaurants of spelling contexts that aren't sent to every worker, of 4 bytes, and of 3 where these aren't sent either.

    A bucket has all cells of the contexts of 3 bytes that fall into it, so the contexts' customers are known there. Sent are
    contexts with at least `least` customers, and those of a word's first two bytes, by which endings are weighed; a
    context of 3 bytes has no fewer customers than one of 4 that it ends, so the parent of one that is sent is sent too.
    """

    def __init__(self, code: np.ndarray, c: np.ndarray, least: float):
        def sent(x: np.ndarray, edge: int) -> np.ndarray:
            met, back = np.unique(x, return_inverse=True)
            return ((np.bincount(back, c, len(met)) >= least) | (met // SIDE == edge))[back]

        x4 = code // SYMBOLS
        here = ~sent(x4, (START * SIDE + START) * SIDE + START)
        with_parent = sent(x4 % SIDE**3, START * SIDE + START)
        self.sent, self.sent_c = code[~here], c[~here]
        by = np.argsort(code[here])
        self.code, self.c = code[here][by], c[here][by]
        self.context, self.symbol = self.code // SYMBOLS, self.code % SYMBOLS
        self.row = np.cumsum(np.isin(np.arange(len(self.code)), _runs(self.context))) - 1
        self.cell3, first, self.at = np.unique(self.context % SIDE**3 * SYMBOLS + self.symbol, return_index=True, return_inverse=True)
        self.inner = ~with_parent[here][by][first]  # cells of contexts of 3 bytes that are seated here
        self.row3 = np.unique(self.cell3 // SYMBOLS, return_inverse=True)[1]
        self.t, self.t3 = np.minimum(self.c, 1), None

    @staticmethod
    def _shares(row: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells' own parts, weights of the parents, and tables of the restaurant."""
        all_, tables = STRENGTH + np.bincount(row, c)[row], np.bincount(row, t)[row]
        return (c - DISCOUNT * t) / all_, (STRENGTH + DISCOUNT * tables) / all_, tables

    def run(self, log_cells, sweep: int) -> np.ndarray:
        """The cells' mean probabilities; log_cells(context, symbol, longest): those of contexts that are sent."""
        if not len(self.code):
            return np.zeros(0)
        outer = np.exp(np.where(self.inner, log_cells(self.cell3 // SYMBOLS, self.cell3 % SYMBOLS, 2), log_cells(self.cell3 // SYMBOLS, self.cell3 % SYMBOLS, 3)))
        self.t3, total, some = np.minimum(np.bincount(self.at, self.t), 1.0), np.zeros(len(self.code)), self.c > 0

        def inner():
            own, back, _ = self._shares(self.row3, np.bincount(self.at, self.t), self.t3)
            return np.where(self.inner, own + back * outer, outer)

        for s in range(REST_BURN_IN + REST_SAMPLES):
            _, _, tables = self._shares(self.row, self.c, self.t)
            others = np.maximum(tables - self.t, 0)
            drawn = draw_tables(np.maximum(self.c, 1), (STRENGTH + DISCOUNT * others) * inner()[self.at], _uniform(self.code, self.symbol, 1000 + 20 * sweep + 2 * s), others)
            self.t = np.where(some, drawn, 0.0)
            c3 = np.bincount(self.at, self.t)
            self.t3 = np.minimum(self.t3, c3)
            others = np.maximum(self._shares(self.row3, c3, self.t3)[2] - self.t3, 0)
            drawn = draw_tables(np.maximum(c3, 1), (STRENGTH + DISCOUNT * others) * outer, _uniform(self.cell3, self.cell3 % SYMBOLS, 1001 + 20 * sweep + 2 * s), others)
            self.t3 = np.where(c3 > 0, drawn, 0.0)
            if s >= REST_BURN_IN:
                own, back, _ = self._shares(self.row, self.c, self.t)
                total += own + back * inner()[self.at]
        return total / REST_SAMPLES

    def customers(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Order, codes and counts of what comes to the restaurants that are sent."""
        c3 = np.bincount(self.at, self.t, len(self.cell3)) if len(self.code) else np.zeros(0)
        out, inner = ~self.inner, self.inner
        t3 = self.t3 if self.t3 is not None else c3
        return [(4, self.sent, self.sent_c), (3, self.cell3[out], c3[out]), (2, self.cell3[inner] // SYMBOLS % SIDE**2 * SYMBOLS + self.cell3[inner] % SYMBOLS, t3[inner])]


def _shared_customers(cells: DataFrame) -> float:
    """The customers from which on a context of 4 or 3 bytes is sent to every worker: at most KEPT of each have as many; 0: all are sent."""
    least = 0.0
    if cells.count() <= KEPT:  # no more contexts than cells
        return least
    for size in (4, 3):
        x = F.floor(F.col("code") / SYMBOLS) % SIDE**size
        n = cells.groupBy(x.alias("x")).agg(F.sum("c").alias("n")).where("n > 0").select("n")
        if n.count() > KEPT:
            least = max(least, n.orderBy(F.col("n").desc()).limit(KEPT + 1).agg(F.min("n").alias("n")).first()["n"] + 0.5)
    return least


def _speller(codes: DataFrame, classes: Classes, before: Speller | None, sweep: int) -> tuple[Speller, DataFrame | None]:
    """The speller of all contexts that are sent to every worker, and for the cells of the others (code, more): what they add to its logs; None if all are sent.

    codes (code, c) has all cells of all words. before: the speller of the sweep before, under which the others are seated
    for their customers; without one, under the symbols' shares. The driver gets at most (2 KEPT + 258^2 + 258) x 257 cells
    at any scale, and as many as the words' bytes have.
    """
    spark, cells = codes.sparkSession, written(codes, "cells")
    least = _shared_customers(cells)
    if not least:
        rows = cells.where("c > 0").toArrow()
        code, c = rows["code"].to_numpy(), rows["c"].to_numpy()
        discard(cells)
        by = np.argsort(code)
        none = (np.zeros(0, np.int64), np.zeros(0))
        return Speller([(code[by], c[by]), none, none, none], classes, sweep), None
    dealt = cells.withColumn("bucket", F.pmod(F.xxhash64(F.floor(F.col("code") / SYMBOLS) % SIDE**3), F.lit(max(16, cells.count() // SEATED)))).groupBy("bucket")
    by_symbol = cells.groupBy((F.col("code") % SYMBOLS).alias("k")).agg(F.sum("c").alias("c")).toArrow()
    shares = np.full(SYMBOLS, 1 / SYMBOLS)
    np.add.at(shares, by_symbol["k"].to_numpy(), by_symbol["c"].to_numpy())
    shares = np.log(shares / shares.sum())
    parent = spark.sparkContext.broadcast(before)

    def up(table: pa.Table) -> pa.Table:
        rest = Rest(table["code"].to_numpy(), table["c"].to_numpy(), least)
        rest.run(parent.value.log_cells if parent.value else lambda x, k, _: shares[k], 2 * sweep)
        out = rest.customers()
        return pa.table({"order": pa.array(np.concatenate([np.full(len(x), o, np.int32) for o, x, _ in out])), "code": pa.array(np.concatenate([x for _, x, _ in out])), "c": pa.array(np.concatenate([c for _, _, c in out]))})

    rows = dealt.applyInArrow(up, "order int, code bigint, c double").groupBy("order", "code").agg(F.sum("c").alias("c")).where("c > 0").toArrow().to_pandas().sort_values(["order", "code"])
    none = (np.zeros(0, np.int64), np.zeros(0))
    speller = Speller([*((part["code"].to_numpy(np.int64), part["c"].to_numpy(np.float64)) for o in (4, 3, 2) for part in [rows[rows["order"] == o]]), none], classes, sweep)
    parent.destroy()
    sent = spark.sparkContext.broadcast(speller)

    def down(table: pa.Table) -> pa.Table:
        rest, own = Rest(table["code"].to_numpy(), table["c"].to_numpy(), least), sent.value
        p = rest.run(own.log_cells, 2 * sweep + 1)
        return pa.table({"code": pa.array(rest.code), "more": pa.array(np.log(p) - own.log_cells(rest.context, rest.symbol))})

    more = written(dealt.applyInArrow(down, "code bigint, more double"), "more")
    frequent = list(classes.frequent)
    if frequent:
        added = _with_more(spark.createDataFrame([(w,) for w in frequent], "w binary"), sent, more).toArrow()
        at = dict(zip(added["w"].to_pylist(), added["more"].to_pylist()))
        speller._masses(np.array([at[w] for w in frequent]))
    sent.destroy()
    discard(cells)
    return speller, more


def _with_more(words: DataFrame, speller, more: DataFrame | None) -> DataFrame:
    """words with more: what the contexts that aren't sent add to their logs."""
    if more is None:
        return words.withColumn("more", F.lit(0.0))

    def run(batches):
        sent = speller.value.contexts[0]
        for batch in batches:
            words = batch.column(0).to_pylist()
            context, symbol, owner = spelling(words)
            rest = np.flatnonzero(~np.isin(context, sent))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[rest])), pa.array((context * SYMBOLS + symbol)[rest])], names=["w", "code"])

    asked = words.select("w").mapInArrow(tidy(run), "w binary, code bigint")
    sums = asked.join(more, "code").groupBy("w").agg(F.sum("more").alias("more"))
    return words.join(sums, "w", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))


def _seat_words(rare: DataFrame, speller: Speller, tables: np.ndarray, sweep: int) -> DataFrame:
    """w, c, t, more -> w, c, t, base, k: tables drawn anew, the base probability, the class. A word's random number is its hash, so a task that is run again draws the same."""
    shared = rare.sparkSession.sparkContext.broadcast((speller, tables))

    def run(batches):
        speller, tables = shared.value
        classes = speller.classes
        for batch in batches:
            words, c, t = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            k = np.fromiter((classes.endings.get(w[-2:], classes.other) for w in words), np.int64, len(words))
            base = np.exp(speller.log_of(words) + batch.column(3).to_numpy())
            u = np.fromiter((xxhash.xxh64_intdigest(w, seed=sweep) for w in words), np.uint64, len(words)).astype(np.float64) / 2.0**64
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(draw_tables(c, (STRENGTH + DISCOUNT * (others := np.maximum(tables[k] - t, 0))) * base, u, others)), pa.array(base), pa.array(k)], names=["w", "c", "t", "base", "k"])

    out = rare.select("w", "c", "t", "more").mapInArrow(tidy(run), "w binary, c bigint, t double, base double, k bigint")
    out._sent = shared
    return out


def _tables(seated: DataFrame, classes: Classes) -> np.ndarray:
    """Tables by class."""
    rows = seated.groupBy("k").agg(F.sum("t").alias("t")).toArrow()
    out = np.zeros(classes.n)
    out[rows["k"].to_numpy()] = rows["t"].to_numpy()
    return out


class Direct:
    """What every worker has of the most frequent words, by rank: hashes, classes and counts; the number after the last rank is the edge of texts."""

    def __init__(self, order: list[bytes], counts: np.ndarray, classes: Classes):
        h = _hashes(order)
        by = np.argsort(h)
        self.hashes, self.rank = h[by], by
        self.counts, self.edge, self.classes = counts, len(order), classes
        self.number = np.array([classes.of(w) for w in order] + [classes.edge], np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ranks of direct words, negative numbers of the others."""
        out = (h >> np.uint64(1)).astype(np.int64) - (np.int64(1) << np.int64(62)) - (np.int64(1) << np.int64(62))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.rank[at], out)
        return out

    def classes_of(self, ids: np.ndarray, words: pa.Array) -> np.ndarray:
        out = self.number[np.maximum(ids, 0)]
        rare = np.flatnonzero(ids < 0)
        out[rare] = [self.classes.of(w) for w in words.take(pa.array(rare)).to_pylist()]
        return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return hashed_words(b"\n".join(words), (0,))[2][0]


def _chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) in chunks; written.

    A row: chunk, n_train (training documents come first), n_words, ids, lengths (words of each document), codes (of all words, one
    document after another, numbers into the distinct words: first all lowest bytes, and so on, compressed here, so that a row is small wherever Spark
    holds it), hashes (of the distinct words, the most frequent ones first, whose numbers so are short), words, counts (in training documents).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, used = TaskContext.get().partitionId(), 0, [], 0

        def settle():
            held.sort(key=lambda d: d[1])
            ids, out, texts = zip(*held)
            start, size, (h,) = hashed_words((raw := b"\n".join(texts).translate(LOWER)), (0,))
            ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
            distinct, first, code, many = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            by, place = np.argsort(-many, kind="stable"), np.empty(len(many), np.int64)
            place[by] = np.arange(len(by))
            distinct, first, code = distinct[by], first[by], place[code]
            n_train = out.count(False)
            counts = np.bincount(code[: ends[n_train - 1] if n_train else 0], minlength=len(distinct))
            words = [raw[a : a + n] for a, n in zip(start[first].tolist(), size[first].tolist())]
            cols = [[part << 32 | seq], [n_train], [len(code)], [list(ids)], [np.diff(ends, prepend=0).astype("<i4").tobytes()], [_small(code.astype("<i4").view("u1").reshape(-1, 4).T.tobytes())], [distinct.tobytes()], [words], [counts.astype("<i4").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for batch in batches:
            kinds[3] = pa.list_(batch.schema.field(0).type)
            for at in range(0, batch.num_rows, 64):
                for i, out, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    text = text.encode()
                    if held and (used + len(text) > CHUNK_BYTES or len(held) >= CHUNK_DOCS):
                        yield settle()
                        seq, held, used = seq + 1, [], 0
                    held.append((i, out, text))
                    used += len(text)
        if held:
            yield settle()

    names = ["chunk", "n_train", "n_words", "ids", "lengths", "codes", "hashes", "words", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), None, pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
    schema = f"chunk bigint, n_train bigint, n_words bigint, ids array<{kind}>, lengths binary, codes binary, hashes binary, words array<binary>, counts binary"
    return written(docs.select("doc_id", "held_out", "text").mapInArrow(tidy(run), schema), "chunks")


def _rows(batches):
    """The rows of chunks, one at a time, with binary columns as they are and words as an Arrow array."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {f: (col[i].values if f in ("words", "told") else col[i].as_py()) for f, col in zip(batch.schema.names, batch.columns)}


def _counts(chunks: DataFrame) -> DataFrame:
    """w BINARY, c: all words (without ends) and their counts in training documents, 0 for words that only others have."""

    def run(batches):
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([row["words"], pa.array(np.frombuffer(row["counts"], "<i4").astype(np.int64))], names=["w", "c"])

    return chunks.select("words", "counts").mapInArrow(tidy(run), "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def _numbered(vocabulary: DataFrame, direct) -> DataFrame:
    """w, c, id, k: with each word's number and class."""

    def run(batches):
        d: Direct = direct.value
        for batch in batches:
            ids = d.ids(_hashes(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), pa.array(d.classes_of(ids, batch.column(0)))], names=["w", "c", "id", "k"])

    return vocabulary.select("w", "c").mapInArrow(tidy(run), "w binary, c bigint, id bigint, k bigint")


def _sequence(row: dict, documents: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some documents of a chunk, for each token (words and ends): context and token as numbers into the distinct words, with the edge after the last of these; and its document's number."""
    codes = np.ascontiguousarray(np.frombuffer(_whole(row["codes"]), "u1").reshape(4, -1).T).view("<i4").ravel()
    lengths, edge = np.frombuffer(row["lengths"], "<i4").astype(np.int64), len(row["hashes"]) // 8
    first = int(lengths[: documents.start or 0].sum())
    lengths = lengths[documents]
    full = np.full(int(lengths.sum()) + len(lengths) + 1, edge, np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    full[np.repeat(starts + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = codes[first : first + int(lengths.sum())]
    return full[:-1], full[1:], np.repeat(np.arange(len(lengths)), lengths + 1)


def _uniform(u: np.ndarray, w: np.ndarray, sweep: int) -> np.ndarray:
    """A pair's random number is its hash, so a task that is run again draws the same."""
    x = mix(mix(u.astype(np.uint64), w.astype(np.uint64)), np.full(len(u), (sweep + 1) * 0xD1B54A32D192ED03 % 2**64, np.uint64))
    return x.astype(np.float64) / 2.0**64


def _bucket_of(u: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """By the context; a hot one's by the pair."""
    spread = (u >= 0) & hot[np.maximum(u, 0)]
    return (mix(u.astype(np.uint64), np.where(spread, w, 0).astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % buckets


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _small(data: bytes) -> bytes:
    """Compressed, after its length."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _whole(data: bytes) -> bytes:
    return _ZSTD.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed(*arrays: np.ndarray) -> bytes:
    """Compressed; numbers of 8 bytes by halves: first all low ones, then all high ones, which are alike for direct words and so take no room."""
    halves = [np.ascontiguousarray(x).view("<u4").reshape(-1, 2).T if x.dtype == np.int64 else x for x in arrays]
    return _small(b"".join([np.array([len(arrays), *(x.nbytes for x in halves)], "<i8").tobytes(), *(x.tobytes() for x in halves)]))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = _whole(data), 8 * (1 + len(kinds)), []
    for n, kind in zip(np.frombuffer(data, "<i8", len(kinds), 8).tolist(), kinds):
        x = np.frombuffer(data, "<u4" if kind == "<i8" else kind, n // (4 if kind == "<i8" else np.dtype(kind).itemsize), at)
        out.append(np.ascontiguousarray(x.reshape(2, -1).T).view("<i8").ravel() if kind == "<i8" else x)
        at += n
    return out


class Contexts:
    """The restaurants of a bucket: for pairs in order of (u, w), their customers c and whether u is spread over buckets."""

    def __init__(self, u: np.ndarray, w: np.ndarray, c: np.ndarray, d: Direct, hot: np.ndarray, tables: np.ndarray | None):
        """tables: of direct contexts, for those that are spread; without it their share here stands for the whole."""
        self.u, self.w, self.c = u, w, c
        start = _runs(u) if len(u) else np.zeros(0, np.int64)
        self.many = np.diff(np.append(start, len(u)))
        own = u[start]
        here = np.add.reduceat(c, start).astype(np.float64) if len(start) else np.zeros(0)
        spread = (own >= 0) & hot[np.maximum(own, 0)]
        self.own, self.here, self.spread = own, here, spread
        self.customers = np.where(spread, d.counts[np.maximum(own, 0)], here)
        self.known = None if tables is None else tables[np.maximum(own, 0)]
        self.more = np.flatnonzero(c >= 2)
        self.t = c[self.more].astype(np.float64)

    def saved(self) -> np.ndarray:
        """By context: customers less tables."""
        of = np.repeat(np.arange(len(self.own)), self.many)[self.more]
        return np.bincount(of, self.c[self.more] - self.t, len(self.own))

    def tables(self) -> np.ndarray:
        whole = self.customers - self.saved() * np.where(self.spread, self.customers / np.maximum(self.here, 1), 1)
        return whole if self.known is None else np.where(self.spread, self.known, whole)

    def sweep(self, parent: np.ndarray, sweep: int) -> None:
        """parent: the parent's probability of each pair's word."""
        m = self.more
        others = np.maximum(np.repeat(self.tables(), self.many)[m] - self.t, 0)
        self.t = draw_tables(self.c[m], (STRENGTH + DISCOUNT * others) * parent[m], _uniform(self.u[m], self.w[m], sweep), others)

    def probability(self, parent: np.ndarray) -> np.ndarray:
        """Predictive probability of each pair's word in its context."""
        own = np.maximum(self.c, 0).astype(np.float64)
        own[self.more] -= DISCOUNT * self.t
        own[self.c == 1] -= DISCOUNT
        all_, tables = np.repeat(self.customers, self.many), np.repeat(self.tables(), self.many)
        return (own + (STRENGTH + DISCOUNT * tables) * parent) / (STRENGTH + all_)


def _first_tables(chunks: DataFrame, direct, hot, buckets: int, rare_p: float, threshold: int) -> DataFrame:
    """Tables of all pairs of training tokens, drawn once with words' shares of all tokens as the parent. Written rows (kind, key, c, x):

    0: cell of classes, customers, those saved; 1: word that isn't frequent, -, customers saved; 2: direct context, -, customers saved;
    3: pair with at least `threshold` customers (u << 32 | w), c, -.
    """

    def spread(batches):
        d, is_hot = direct.value, hot.value
        for row in _rows(batches):
            if not row["n_train"]:
                continue
            ids = d.ids(np.frombuffer(row["hashes"], "<u8"))
            k = np.append(d.classes_of(ids, row["words"]), d.classes.edge).astype("<u2")
            ids = np.append(ids, d.edge)
            u, w, _ = _sequence(row, slice(0, row["n_train"]))
            key, c = np.unique(u * len(ids) + w, return_counts=True)
            u, w = key // len(ids), key % len(ids)
            bucket = _bucket_of(ids[u], ids[w], is_hot, buckets)
            by = np.argsort(bucket, kind="stable")
            u, w, c, bucket = u[by], w[by], c[by], bucket[by]
            edges = np.append(_runs(bucket), len(bucket)).tolist()
            rows = [_packed(ids[u[i:j][s := _runs(u[i:j])]], np.diff(np.append(s, j - i)).astype("<i4"), k[u[i:j][s]], ids[w[i:j]], k[w[i:j]], c[i:j].astype("<i4")) for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(rows, pa.binary())], names=["bucket", "payload"])

    def seat(table: pa.Table) -> pa.Table:
        d, is_hot = direct.value, hot.value
        n, total = d.classes.n, max(1, d.counts.sum())
        parts = [_unpacked(x, "<i8", "<i4", "<u2", "<i8", "<u2", "<i4") for x in table.column("payload").to_pylist()]
        u, ku = (np.concatenate([np.repeat(x[i], x[1]) for x in parts]) for i in (0, 2))
        w, kw, c = (np.concatenate([x[i] for x in parts]) for i in (3, 4, 5))
        by = np.lexsort((w, u))
        u, w, ku, kw, c = u[by], w[by], ku[by].astype(np.int64), kw[by].astype(np.int64), c[by].astype(np.int64)
        start = _runs(u, w)
        u, w, ku, kw, c = u[start], w[start], ku[start], kw[start], np.add.reduceat(c, start)
        r = Contexts(u, w, c, d, is_hot, None)
        parent = np.where(w >= 0, d.counts[np.maximum(w, 0)] / total, rare_p)
        for i in range(2):
            r.sweep(parent, i)
        less = np.zeros(len(c))
        less[r.more] = c[r.more] - r.t
        out = []
        cell, back = np.unique(ku * n + kw, return_inverse=True)
        out.append((0, cell, np.bincount(back, c), np.bincount(back, less)))
        rare = np.flatnonzero((less > 0) & (kw >= d.classes.first_ending))
        word, back = np.unique(w[rare], return_inverse=True)
        out.append((1, word, np.zeros(len(word)), np.bincount(back, less[rare], len(word))))
        some = np.flatnonzero(r.own >= 0)
        out.append((2, r.own[some], np.zeros(len(some)), r.saved()[some]))
        great = np.flatnonzero((c >= threshold) & (u >= 0) & (w >= 0))
        out.append((3, u[great] << 32 | w[great], c[great], np.zeros(len(great))))
        cols = [np.concatenate([np.full(len(k), kind) for kind, k, _, _ in out]), *(np.concatenate([x[i] for x in out]) for i in (1, 2, 3))]
        return pa.table({"kind": pa.array(cols[0].astype(np.int32)), "key": pa.array(cols[1].astype(np.int64)), "c": pa.array(cols[2].astype(np.int64)), "x": pa.array(cols[3].astype(np.float64))})

    sent = chunks.select("n_train", "lengths", "codes", "hashes", "words").mapInArrow(tidy(spread), "bucket bigint, payload binary")
    told = sent.groupBy("bucket").applyInArrow(seat, "kind int, key bigint, c bigint, x double")
    # one row of a sum from each bucket
    return written(told.groupBy("kind", "key").agg(F.sum("c").alias("c"), F.sum("x").alias("x")), "tables")


class Model:
    """Trained on the documents (doc_id, text and perhaps held_out) that aren't held out."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        held = F.col("held_out") if "held_out" in docs.columns else F.lit(False)
        docs = docs.select("doc_id", held.alias("held_out"), whole_text().alias("text"))
        parts = docs.rdd.getNumPartitions()
        self.chunks = _chunks(docs)
        release(spark)
        vocabulary = written(_counts(self.chunks), "vocabulary")
        release(spark)
        sums = self.chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
        self.ends = n_docs = sums["n"]
        self.buckets = min(1 << 20, max(16, 4 * parts, -(-sums["words"] // BUCKET_TOKENS)))
        sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
        self.tokens, self.distinct = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
        # words by count: as many rows as there are different counts
        by_count = vocabulary.where("c > 0").groupBy("c").agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("w")).alias("size")).toArrow().to_pandas().sort_values("c", ascending=False)
        fits = (by_count["count"].cumsum() <= DIRECT) & (by_count["size"].cumsum() <= DIRECT_BYTES)
        least = int(by_count["c"][fits].min()) if fits.any() else (1 << 62)
        rows = vocabulary.where(F.col("c") >= least).toArrow()  # at most DIRECT rows of DIRECT_BYTES
        pairs = sorted(zip((-c for c in rows["c"].to_pylist()), rows["w"].to_pylist()))
        order, counts = [w for _, w in pairs], np.array([-c for c, _ in pairs] + [n_docs], np.float64)
        frequent = order[:FREQUENT]
        del rows, pairs
        rare = vocabulary.join(F.broadcast(spark.createDataFrame([(w,) for w in frequent], "w binary")), "w", "left_anti")
        endings = rare.where((F.octet_length("w") > 1) & (F.col("c") > 0)).groupBy(F.substring("w", -2, 2).alias("e")).agg(F.sum("c").alias("c")).orderBy(F.col("c").desc(), "e").limit(ENDINGS).toArrow()["e"].to_pylist()
        self.classes = classes = Classes(frequent, endings)
        d = self.d = Direct(order, counts, classes)
        self.direct = spark.sparkContext.broadcast(d)
        # contexts with a good part of what a bucket has on average
        hot = counts > self.tokens / (4 * self.buckets)
        self.hot = spark.sparkContext.broadcast(hot)
        numbered = written(_numbered(vocabulary, self.direct), "numbered")
        discard(vocabulary)
        release(spark)
        sums = _first_tables(self.chunks, self.direct, self.hot, self.buckets, min(1.0, 0.5 * least / max(1, self.tokens)), max(2, self.tokens // DIRECT_PAIRS + 1))
        release(spark)
        self.direct_t = counts.copy()
        at = sums.where("kind = 2").select("key", "x").toArrow()  # at most DIRECT rows and the edge
        self.direct_t[at["key"].to_numpy()] -= at["x"].to_numpy()
        # classes: their customers are the tables of pairs
        cells = sums.where("kind = 0").select("key", "c", "x").toArrow()  # at most classes.n squared
        matrix = np.zeros(classes.n * classes.n)
        matrix[cells["key"].to_numpy()] = cells["c"].to_numpy() - cells["x"].to_numpy()
        matrix = matrix.reshape(classes.n, classes.n)
        row, col = np.nonzero(matrix)
        none = np.zeros(0, np.int64)
        seating = Seating([(row, col, matrix[row, col]), (none, none, np.zeros(0))], [np.zeros(classes.n, np.int64)], classes.n, 1)
        self.log_class = np.log10(seating.averaged()[0]).astype(np.float32)
        del seating
        self._words(numbered, sums.where("kind = 1").select(F.col("key").alias("id"), F.col("x").alias("less")), matrix.sum(0))
        self._direct_pairs(sums)
        discard(sums)
        release(spark)

    def _words(self, numbered: DataFrame, saved: DataFrame, customers: np.ndarray) -> None:
        """Words that aren't frequent, and their spelling: a word's customers are its tables in all contexts."""
        spark, classes = numbered.sparkSession, self.classes
        seated = numbered.where(F.col("k") >= classes.first_ending).join(saved, "id", "left")
        seated = written(seated.select("w", "k", (F.col("c") - F.coalesce("less", F.lit(0.0))).cast("long").alias("c"), F.when(F.col("c") > 0, 1.0).otherwise(0.0).alias("t")), "seated")
        release(spark)
        # a word with one customer has one table, so its spelling is counted once; words that training doesn't have have none
        alone, some = seated.where("c <= 1"), seated.where("c > 1")
        spelled = alone.select("w", "t")
        if classes.frequent:
            spelled = spelled.unionByName(spark.createDataFrame([(w, 0.0) for w in classes.frequent], "w binary, t double"))
        fixed = _spelling_codes(spelled)
        tables_alone = _tables(alone, classes)
        tables = tables_alone + _tables(some, classes)
        self.spellers, self.new, drawn, mores, p, speller = [], [], [], [], None, None
        for sweep in range(WORD_BURN_IN + WORD_SAMPLES):
            own = _spelling_codes(some)
            speller, more = _speller(fixed.unionByName(own).groupBy("code").agg(F.sum("c").alias("c")), classes, speller, sweep)
            discard(own)
            sent = spark.sparkContext.broadcast(speller)
            seats = _seat_words(_with_more(some, sent, more), speller, tables, sweep)
            some = written(seats, "drawn")
            seats._sent.destroy()  # each speller takes room on every executor's disk
            sent.destroy()
            drawn.append(some)
            tables = tables_alone + _tables(some, classes)
            release(spark)
            if sweep >= WORD_BURN_IN:
                new = (STRENGTH + DISCOUNT * tables) / (STRENGTH + customers)
                self.spellers.append(speller)
                mores.append(more)
                self.new.append(new)
                by_class = F.broadcast(spark.createDataFrame([(i, float(customers[i]), float(new[i])) for i in range(classes.first_ending, classes.n)], "k bigint, n double, new double"))
                x = some.join(by_class, "k").select("w", ((F.col("c") - DISCOUNT * F.col("t")) / (STRENGTH + F.col("n")) + F.col("new") * F.col("base")).alias("p"))
                p = x if p is None else p.unionByName(x)
        discard(fixed)
        # words of one customer or none, under each speller
        model = spark.sparkContext.broadcast((self.spellers, self.new, customers))
        alone = alone.select("w", "k", "c")
        sents = []
        for i, more in enumerate(mores):
            sents.append(spark.sparkContext.broadcast(self.spellers[i]) if more is not None else None)
            alone = _with_more(alone, sents[i], more).withColumnRenamed("more", f"more_{i}")

        def of_one(batches):
            spellers, new, customers = model.value
            for batch in batches:
                words, k, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                own = np.maximum(c - DISCOUNT, 0) / (STRENGTH + customers[k])
                base = sum(f[k] * np.exp(s.log_of(words) + batch.column(3 + i).to_numpy()) for i, (s, f) in enumerate(zip(spellers, new))) / len(spellers)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log10(np.maximum(own + base, 1e-300)))], names=["w", "lp"])

        lp = p.groupBy("w").agg(F.log10(F.sum("p") / WORD_SAMPLES).alias("lp")).unionByName(alone.mapInArrow(tidy(of_one), "w binary, lp double"))
        #: id, c, lp, k of each word, also of those that only held-out texts have: its count, its log probability given its class, and this
        self.words = written(numbered.join(lp, "w", "left").select("id", "c", F.coalesce("lp", F.lit(0.0)).alias("lp"), "k"), "words")
        for x in (model, *sents):
            if x is not None:
                x.destroy()
        for x in (seated, numbered, *drawn, *mores):
            discard(x)
        release(spark)
        self.direct_lp = np.zeros(self.d.edge + 1)
        rows = self.words.where("id >= 0").select("id", "lp").toArrow()  # at most DIRECT rows
        self.direct_lp[rows["id"].to_numpy()] = rows["lp"].to_numpy()

    def _direct_pairs(self, sums: DataFrame) -> None:
        """Seat the pairs that all workers get: keys in order, and customers less discounts."""
        rows = sums.where("kind = 3").select("key", "c").toArrow()  # at most DIRECT_PAIRS
        key, c = rows["key"].to_numpy().astype(np.int64), rows["c"].to_numpy().astype(np.int64)
        by = np.argsort(key)
        key, c = key[by], c[by]
        u, w = key >> 32, key & 0xFFFFFFFF
        parent = 10.0 ** (self.log_class[self.d.number[u], self.d.number[w]].astype(np.float64) + self.direct_lp[w])
        t, total = c.astype(np.float64), np.zeros(len(c))
        for sweep in range(PAIR_BURN_IN + PAIR_SAMPLES):
            others = np.maximum(self.direct_t[u] - t, 0)
            t = draw_tables(c, (STRENGTH + DISCOUNT * others) * parent, _uniform(u, w, 100 + sweep), others)
            total += t * (sweep >= PAIR_BURN_IN)
        self.pairs = (key, c - DISCOUNT * total / PAIR_SAMPLES)


TOLD = [("at", pa.int32()), ("c", pa.int32()), ("lp", pa.float32()), ("k", pa.int32())]


def _known_words(model: Model) -> DataFrame:
    """The chunks with told: for the distinct words that aren't direct, their place, count, log probability and class. Written without the words themselves, in the place of the model's chunks, so that the texts aren't on disk once more while they are scored.

    What is told of a chunk is a small file by its number in the shared folder, and chunks pick it up as they are
    copied: they are neither shuffled nor sorted, so no executor holds many of them, and the disk has no third copy.
    """
    spark, direct = model.chunks.sparkSession, model.direct
    folder = qualified(spark, shared_path(spark, "told-of"))

    def rare(batches):
        for row in _rows(batches):
            ids = direct.value.ids(np.frombuffer(row["hashes"], "<u8"))
            at = np.flatnonzero(ids < 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), row["chunk"])), pa.array(at.astype(np.int32))], names=["id", "chunk", "at"])

    def keep(table: pa.Table) -> pa.Table:
        files, path = fs.FileSystem.from_uri(f"{folder}/{table.column('chunk')[0].as_py()}")
        by = np.argsort(table.column("at").to_numpy(), kind="stable")
        data = _packed(*(table.column(name).to_numpy()[by].astype(kind.to_pandas_dtype()) for name, kind in TOLD))
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}.tmp") as out:
            out.write(data)
        files.move(tmp, path)  # a task that is run again writes the same
        return table.slice(0, 1).select(["chunk"])

    asked = model.chunks.select("chunk", "hashes").mapInArrow(tidy(rare), "id bigint, chunk bigint, at int")
    found = asked.join(model.words.where("id < 0"), "id").select("chunk", "at", F.col("c").cast("int").alias("c"), F.col("lp").cast("float").alias("lp"), F.col("k").cast("int").alias("k"))
    n_files = found.groupBy("chunk").applyInArrow(keep, "chunk bigint").count()
    del asked, found
    _settle_disk(spark)
    chunks = model.chunks.drop("counts", "words")

    def told(batches):
        for batch in batches:
            for i, row in enumerate(_rows([batch])):
                many = int((direct.value.ids(np.frombuffer(row["hashes"], "<u8")) < 0).sum())
                cols = [np.zeros(0, kind.to_pandas_dtype()) for _, kind in TOLD]
                if many:
                    files, path = fs.FileSystem.from_uri(f"{folder}/{row['chunk']}")
                    with files.open_input_stream(path) as f:
                        cols = _unpacked(f.read(), "<i4", "<i4", "<f4", "<i4")
                if len(cols[0]) != many:
                    raise ValueError(f"chunk {row['chunk']} has {many} words that aren't direct, and is told of {len(cols[0])}")
                structs = pa.StructArray.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(cols, TOLD)], [name for name, _ in TOLD])
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.ListArray.from_arrays(pa.array([0, many], pa.int32()), structs)], names=[*one.schema.names, "told"])

    kind = chunks.schema.simpleString().removeprefix("struct<").removesuffix(">")
    out = written(chunks.mapInArrow(tidy(told), f"{kind}, told array<struct<at:int,c:int,lp:float,k:int>>"), "told")
    if n_files:
        remove(spark, folder)
    discard(model.chunks)
    return out


def _settle_disk(spark) -> None:
    """Shuffle files of the plans before leave the disk."""
    for _ in range(2):  # Spark's listeners refer to the last plan for a moment, and so to its shuffle files
        time.sleep(1)
        release(spark)


def score_documents(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on rows whose crc32(doc_id as text) mod folds isn't `held` (a null id counts as empty text),
    and scores all. Tokens are words (A-Z lower-cased) and one end; a null or empty text is its end
    alone; a very long text is a chunk of its own. Repeated rows train and are scored each. Other columns are ignored; with no
    training rows all tokens are unknown; no rows give no rows. Words are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    model = Model(docs.select("doc_id", (doc_number() % folds == held).alias("held_out"), "text"))
    n, v, buckets, direct, hot = model.tokens, model.distinct, model.buckets, model.direct, model.hot
    scale = math.log10(n + 0.5 * (v + 1))
    sent = spark.sparkContext.broadcast((model.log_class, model.direct_lp, model.direct_t, model.pairs, model.ends))

    def spread(batches):
        d, is_hot = direct.value, hot.value
        log_class, direct_lp, direct_t, (keys, ns), ends = sent.value
        keys, ns = np.append(keys, 1 << 62), np.append(ns, 0)
        back = (STRENGTH + DISCOUNT * direct_t) / (STRENGTH + d.counts)

        def one(row: dict, kind: pa.DataType) -> pa.RecordBatch:
            ids = d.ids(np.frombuffer(row["hashes"], "<u8"))
            k = np.append(d.number[np.maximum(ids, 0)], d.classes.edge)
            at, told_c, told_lp, told_k = (x.to_numpy() for x in row["told"].flatten())
            c, lp = np.where(ids >= 0, d.counts[np.maximum(ids, 0)], 0.0), direct_lp[np.maximum(ids, 0)]
            c[at], lp[at], k[at] = told_c, told_lp, told_k
            ids, c, lp = np.append(ids, d.edge), np.append(c, ends), np.append(lp, 0.0)
            u, w, doc = _sequence(row, slice(0, None))
            many = len(row["ids"])
            base = np.bincount(doc, np.log10(c + 0.5)[w] - scale, many)
            known = np.bincount(doc[c[w] > 0], minlength=many)
            # tokens of direct pairs are scored here
            key = np.where((ids[u] >= 0) & (ids[w] >= 0), ids[u] << 32 | ids[w], -1)
            place = np.searchsorted(keys, key)
            hit = keys[place] == key
            x, y = ids[u[hit]], ids[w[hit]]
            own = np.bincount(doc[hit], np.log10(ns[place[hit]] / (STRENGTH + d.counts[x]) + back[x] * 10.0 ** (log_class[k[u[hit]], k[w[hit]]] + lp[w[hit]])), many)
            head = _packed(np.array([row["n_train"]], "<i8"), np.bincount(doc, minlength=many).astype("<i8"), known.astype("<i8"), base, own)
            rows = [(row["chunk"], -1 - row["chunk"], head, row["ids"])]
            u, w, doc = u[~hit], w[~hit], doc[~hit]
            item, times = np.unique((u * len(ids) + w) * many + doc, return_counts=True)
            key, doc = item // many, item % many
            first = _runs(key)
            docs_of = np.diff(np.append(first, len(key)))
            u, w = key[first] // len(ids), key[first] % len(ids)
            bucket = _bucket_of(ids[u], ids[w], is_hot, buckets)
            by = np.argsort(bucket, kind="stable")
            # items in the order of their pairs' buckets
            order = np.repeat(first[by] - (np.cumsum(docs_of[by]) - docs_of[by]), docs_of[by]) + np.arange(len(key))
            doc, times, docs_of, u, w, bucket = doc[order].astype("<u2"), times[order].astype("<i4"), docs_of[by], u[by], w[by], bucket[by]
            parent = (log_class[k[u], k[w]] + lp[w]).astype("<f4")
            edges = np.append(_runs(bucket), len(bucket)).tolist()
            ends_of = np.append(0, np.cumsum(docs_of))
            for i, j in zip(edges[:-1], edges[1:]):
                a, b = ends_of[i], ends_of[j]
                s = _runs(u[i:j])
                rows.append((row["chunk"], int(bucket[i]), _packed(np.array([row["n_train"]], "<i8"), ids[u[i:j][s]], np.diff(np.append(s, j - i)).astype("<i4"), ids[w[i:j]], parent[i:j], docs_of[i:j].astype("<i4"), doc[a:b], times[a:b]), None))
            chunk, bucket, payload, doc_ids = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary()), pa.array(doc_ids, kind)], names=["chunk", "bucket", "payload", "ids"])

        for batch in batches:
            kind = batch.schema.field("ids").type
            yield from (one(row, kind) for row in _rows([batch]))

    def score(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["chunk", "payload", "ids"])
        d, is_hot, direct_t = direct.value, hot.value, sent.value[2]
        parts = [_unpacked(x, "<i8", "<i8", "<i4", "<i8", "<f4", "<i4", "<u2", "<i4") for x in table.column("payload").to_pylist()]
        pairs_of, items_of = [len(x[3]) for x in parts], [len(x[6]) for x in parts]
        u = np.concatenate([np.repeat(x[1], x[2]) for x in parts])
        w, parent, docs_of, doc, times = (np.concatenate([x[i] for x in parts]) for i in (3, 4, 5, 6, 7))
        chunk, pair = np.repeat(np.arange(len(parts)), items_of), np.repeat(np.arange(len(u)), docs_of)
        trained = doc < np.repeat([int(x[0][0]) for x in parts], items_of)
        c = np.bincount(pair, times * trained, len(u)).astype(np.int64)
        by = np.lexsort((w, u))
        start = _runs(u[by], w[by])
        group = np.empty(len(u), np.int64)
        group[by] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(u))))
        r = Contexts(u[by][start], w[by][start], np.add.reduceat(c[by], start), d, is_hot, direct_t)
        parent, p = 10.0 ** parent[by][start].astype(np.float64), 0.0
        for sweep in range(PAIR_BURN_IN + PAIR_SAMPLES):
            r.sweep(parent, 10 + sweep)
            if sweep >= PAIR_BURN_IN:
                p = p + r.probability(parent)
        value = times * np.log10(np.maximum(p / PAIR_SAMPLES, 1e-300))[group[pair]]
        at, back = np.unique(chunk << 16 | doc, return_inverse=True)
        value, edges = np.bincount(back, value), np.searchsorted(at, np.arange(len(parts) + 1) << 16).tolist()
        out = [_packed((at[i:j] & 0xFFFF).astype("<u2"), value[i:j]) for i, j in zip(edges[:-1], edges[1:])]
        return pa.table({"chunk": table.column("chunk"), "payload": pa.array(out, pa.binary()), "ids": pa.nulls(len(out), table.schema.field("ids").type)})

    def settle(table: pa.Table) -> pa.Table:
        all_ids, payloads = table.column("ids"), table.column("payload").to_pylist()
        head = next(i for i in range(len(payloads)) if all_ids[i].is_valid)
        n_train, lengths, known, base, own = _unpacked(payloads[head], "<i8", "<i8", "<i8", "<f8", "<f8")
        own = own.copy()
        for i, x in enumerate(payloads):
            if i != head:
                doc, value = _unpacked(x, "<u2", "<f8")
                own[doc] += value
        return pa.table({"doc_id": all_ids[head].values, "held_out": pa.array(np.arange(len(own)) >= n_train[0]), "n_tokens": pa.array(lengths), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(own)})

    told = _known_words(model)
    _settle_disk(spark)
    told = told.mapInArrow(tidy(spread), f"chunk bigint, bucket bigint, payload binary, ids array<{id_kind}>")
    scored = told.groupBy("bucket").applyInArrow(score, f"chunk bigint, payload binary, ids array<{id_kind}>")
    out = scored.groupBy("chunk").applyInArrow(settle, f"doc_id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
