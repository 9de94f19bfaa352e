"""Substring dedup with suffix automata over shards of repeated text.

1. Each window of 20 words is anchored at its least 8-word hash; equal windows have equal anchors. Anchors
   that occur once in the whole corpus are found by hash buckets, and their windows leave.
2. Windows side by side with one anchor form a segment. Equal segments fold into one, with its
   first place. Segments are dealt by anchor into shards of bounded size: all text in which a
   window could occur again is in the window's own shard.
3. A shard streams its segments in order of their first places through a suffix automaton of those
   before. The matching statistic at a word is the length of the longest suffix that
   occurs there; where it reaches 20, the window that ends at that word occurs earlier.
4. A segment that occurs again is streamed once more when the automaton has it: these statistics stand for all of its later
   copies. So every removal is one that the automaton found; hashes (two independent ones of 64 bits) only bring copies together.

Broadcasting one automaton to all tasks would grow with the corpus, so a shard's text goes just to the
task that streams the segments which can match it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, spare, tidy, written
from .hashing import REST, as_long, bucket_count, hashes_of_texts, repeated_hashes, span_names, windows

WINDOW, ANCHOR = 20, 8
SEEDS = (0, 1)
#: Segments (of some 26 words) in a shard on average, and distinct segments of one anchor beyond which its windows are dealt singly.
SHARD, CROWDED = 3000, 1000
#: Crowded anchors are broadcast if they are no more than this (9 bytes each).
BROADCAST_ROWS = 100_000


class SuffixAutomaton:
    """Of any number of sequences; grows a sequence at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _add(self, length: int, link: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c) -> int:
        """A copy of q for the strings of at most length[p] + 1."""
        nxt, link = self.next, self.link
        copy = self._add(self.length[p] + 1, link[q], dict(nxt[q]))
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def insert(self, sequence: list) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._add(length[last] + 1, 0, {}), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new

    def statistics(self, sequence: list) -> list[int]:
        """For each place, the length of the longest suffix up to it that occurs in an inserted sequence."""
        nxt, link, length, at, n, out = self.next, self.link, self.length, 0, 0, []
        for c in sequence:
            while at and c not in nxt[at]:
                at = link[at]
                n = length[at]
            q = nxt[at].get(c)
            if q is not None:
                at, n = q, n + 1
            out.append(n)
        return out


    def has(self, sequence: list) -> bool:
        """Does it occur whole? Then its statistics are 1, 2, 3 and so on, and no suffix link is followed."""
        nxt, at = self.next, 0
        for c in sequence:
            at = nxt[at].get(c)
            if at is None:
                return False
        return True


def sliced(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str) -> list[bytes]:
    """bytes.split() parts at just the six bytes of the contract."""
    return text.encode().split()


def anchor_runs(h: np.ndarray, sizes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows side by side with one anchor (the leftmost place of their least hash), in documents whose words' hashes stand one after another: first window, end, anchor's hash, document."""
    none = np.zeros(0, np.int64)
    a = windows(h, anchor)
    span = window - anchor + 1
    n = len(a) - span + 1
    if n <= 0:
        return none, none, a[:0], none
    best, size = a, 1
    while 2 * size <= span:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    best = np.minimum(best[:n], best[span - size : span - size + n])
    # a document's windows, and a run's, end before the next one's begin
    first = np.cumsum(sizes) - sizes
    has = np.flatnonzero(sizes >= window)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = best[1:] != best[:-1]
    edge[first[has]] = True
    edge[first[has] + sizes[has] - window + 1] = True
    inside = np.zeros(n + 1, np.int8)
    inside[first[has]] += 1
    inside[first[has] + sizes[has] - window + 1] -= 1
    inside = np.cumsum(inside).astype(bool)
    cut = np.flatnonzero(edge)
    start = cut[inside[cut]]
    end = cut[np.searchsorted(cut, start, side="right")] if len(start) else start
    runs, steps = [], np.arange(span)
    while len(start):
        place = start + (a[start[:, None] + steps] == best[start][:, None]).argmax(1)
        stop = np.minimum(end, place + 1)
        runs.append((start, stop))
        more = stop < end  # the same hash again, further right
        start, end = stop[more], end[more]
    if not runs:
        return none, none, a[:0], none
    start, stop = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    return start, stop, best[start], np.searchsorted(first, start, side="right") - 1


def _together(texts: list[str], seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words of all texts, once for each seed, and how many each text has."""
    each = list(hashes_of_texts(texts, seeds=seeds))
    return [np.concatenate(x) for x in zip(*each)], np.array([len(x[0]) for x in each], np.int64)


def _anchor_maker(window: int, anchor: int):
    def make(texts: list[str]):
        (h,), sizes = _together(texts, SEEDS[:1])
        _, _, best, doc = anchor_runs(h, sizes, window, anchor)
        order = np.lexsort((best, doc))
        best, doc = best[order], doc[order]
        new = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]))) if len(best) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(best)))
        edges = np.searchsorted(doc[new], np.arange(len(texts) + 1)).tolist()
        for i, j in zip(edges[:-1], edges[1:]):
            yield best[new[i:j]], times[i:j] > 1

    return make


def _segments(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, text, bits, repeated -> a row per segment with a repeated anchor: s1, s2 (its hash), doc, start, wins."""

    def run(batches):
        for part in sliced(batches):
            hashes, sizes = _together(part.column(1).to_pylist(), SEEDS)
            start, stop, best, doc = anchor_runs(hashes[0], sizes, window, anchor)
            hot, repeated = np.zeros(len(start), bool), part.column(3)
            edges = np.searchsorted(doc, np.arange(len(sizes) + 1)).tolist()
            for k, (i, j, bits) in enumerate(zip(edges[:-1], edges[1:], part.column(2).to_pylist())):
                if j > i:
                    hot[i:j] = np.isin((best[i:j] >> np.uint64(64 - REST - bits)).astype(np.int64), np.asarray(repeated[k].values))
            start, stop, doc = start[hot], stop[hot], doc[hot]
            names = span_names(hashes, start, stop + window - 1)
            ids, first = np.array(part.column(0).to_pylist(), np.int64), np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(ids[doc]), pa.array((start - first[doc]).astype(np.int32)), pa.array((stop - start).astype(np.int32))], names=["s1", "s2", "doc", "start", "wins"])

    return marked.select("doc_id", "text", "bits", "repeated").mapInArrow(tidy(run), "s1 bigint, s2 bigint, doc bigint, start int, wins int")


def _with_words(first: DataFrame, texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """Distinct segments with their anchors and words, read at their first places."""

    def run(batches):
        for part in sliced(batches):
            texts, rows = part.column(1).to_pylist(), []
            hashes, sizes = _together(texts, SEEDS)
            first = np.cumsum(sizes) - sizes
            for i, doc in enumerate(part.column(0).to_pylist()):
                s1, s2, start, wins, again = (x.to_numpy(zero_copy_only=False) for x in part.column(2)[i].values.flatten())
                ok = start + wins + window - 1 <= sizes[i]  # another text of the same id may be shorter, or another
                rows.append(tuple(x[ok] for x in (s1, s2, np.full(len(s1), doc), start, wins, again, start + first[i], np.full(len(s1), i))))
            s1, s2, docs, start, wins, again, place, which = (np.concatenate(x) for x in zip(*rows))
            least = windows(hashes[0], anchor)
            own = least[place[:, None] + np.arange(window - anchor + 1)].min(1).view(np.int64) if len(place) else s1
            a, b = span_names(hashes, place, place + wins + window - 1)
            ok = np.flatnonzero((a == s1) & (b == s2))
            words, last, spans = [], -1, []
            for k in ok.tolist():
                if which[k] != last:
                    last = which[k]
                    words = words_of(texts[last])
                spans.append(b" ".join(words[start[k] : start[k] + wins[k] + window - 1]).decode())
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*(x[ok] for x in (s1, s2, own, docs, start, wins, again)), spans], kinds)], names=["s1", "s2", "anchor", "doc", "start", "wins", "again", "words"])

    wanted = first.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("s1", "s2", "start", "wins", "again")).alias("wanted"))
    keyed = texts.select(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc"), "text")
    return keyed.join(wanted, keyed["doc"] == wanted["of"]).select("doc", "text", "wanted").mapInArrow(tidy(run), "s1 bigint, s2 bigint, anchor bigint, doc bigint, start int, wins int, again boolean, words string")


def _streamed(units: DataFrame, window: int) -> DataFrame:
    """units: shard, s1, s2, j, doc, start, words, again -> s1, s2, j, earlier and later.

    earlier: for each window of the unit, does it occur in a unit before? later: for a unit with again, did it match whole when it was streamed once more?
    """

    def stream(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("start", "ascending"), ("s1", "ascending"), ("s2", "ascending")])
        automaton, out, later = SuffixAutomaton(), [], []
        for words, again in zip(table.column("words").to_pylist(), table.column("again").to_pylist()):
            words = words.encode().split(b" ")
            out.append([n >= window for n in automaton.statistics(words)[window - 1 :]])
            automaton.insert(words)
            later.append(again and automaton.has(words))
        return pa.table({"s1": table.column("s1"), "s2": table.column("s2"), "j": table.column("j"), "earlier": pa.array(out, pa.list_(pa.bool_())), "later": pa.array(later, pa.bool_())})

    return units.select("shard", "s1", "s2", "j", "doc", "start", "words", "again").groupBy("shard").applyInArrow(stream, "s1 bigint, s2 bigint, j int, earlier array<boolean>, later boolean")


def removed_windows(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """texts: doc_id BIGINT, text. A row per doc_id with windows that occur earlier: doc, runs of (start, n).

    A null doc_id is ordered before all others, as the least long.
    """
    spark = texts.sparkSession
    flags = written(repeated_hashes(texts, lambda: _anchor_maker(window, anchor), bucket_count(texts), values=True), "anchors")
    release(spark)
    per = flags.groupBy("doc_id").agg(F.first("bits").alias("bits"), F.flatten(F.collect_list("repeated")).alias("repeated")).withColumnRenamed("doc_id", "flagged")
    marked = texts.join(per, texts["doc_id"].eqNullSafe(per["flagged"])).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    segments = written(_segments(marked, window, anchor), "segments")
    discard(flags)
    release(spark)
    first = segments.groupBy("s1", "s2").agg(F.min(F.struct("doc", "start")).alias("at"), F.first("wins").alias("wins"), (F.count(F.lit(1)) > 1).alias("again")).select("s1", "s2", "at.doc", "at.start", "wins", "again")
    first = written(first, "first")
    release(spark)
    once = written(_with_words(first, texts, window, anchor), "distinct")
    release(spark)
    # an anchor of many distinct segments, as at the edges of a common passage, is dealt window by window
    crowded = written(once.groupBy("anchor").count().where(F.col("count") > CROWDED).select("anchor", F.lit(True).alias("crowded")), "crowded")
    dealt = once.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded, "anchor", "left")
    shards = max(1, -(-once.count() // SHARD))
    whole = dealt.where("crowded IS NULL").withColumn("j", F.lit(0)).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    split = F.split("words", " ")
    single = dealt.where("crowded").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wins") - 1)))
    single = single.withColumn("words", F.array_join(F.slice(split, F.col("j") + 1, F.lit(window)), " ")).withColumn("start", F.col("start") + F.col("j"))
    # equal windows of a crowded anchor fold again, so a window that is everywhere is one row of its shard
    alone = single.groupBy("words").agg(F.min(F.struct("doc", "start", "s1", "s2", "j")).alias("m"), (F.max("again") | (F.count(F.lit(1)) > 1)).alias("again")).select("words", "m.*", "again").withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))
    told = written(_streamed(whole, window), "told")
    windows_told = written(alone.drop("again", "shard").join(_streamed(alone, window), ["s1", "s2", "j"]).select("words", F.col("s1").alias("f1"), F.col("s2").alias("f2"), F.col("j").alias("fj"), "earlier", "later"), "told")
    # the first place of a window has its earlier ones, all others what it found when streamed once more
    here = (F.col("s1") == F.col("f1")) & (F.col("s2") == F.col("f2")) & (F.col("j") == F.col("fj"))
    apart = single.join(windows_told, "words").select("s1", "s2", "j", F.when(here, F.col("earlier")[0]).otherwise(F.col("later")).alias("gone"), "later")
    apart = apart.groupBy("s1", "s2").agg(F.array_sort(F.collect_list(F.struct("j", "gone"))).alias("e"), F.every("later").alias("later")).select("s1", "s2", F.transform("e", lambda x: x["gone"]).alias("earlier"), "later")
    earlier = told.select("s1", "s2", "earlier", "later").unionByName(apart)
    # written, so that segments that are in very many documents can be split in the join
    fate = written(first.select("s1", "s2", F.col("doc").alias("d0"), F.col("start").alias("a0")).join(earlier, ["s1", "s2"]), "fate")
    release(spark)
    at_first = (F.col("doc") == F.col("d0")) & (F.col("start") == F.col("a0"))
    met = segments.join(fate, ["s1", "s2"])
    copies = met.where(~at_first & F.col("later")).select("doc", "start", F.col("wins").alias("n"))
    some = met.where(at_first & F.array_contains("earlier", True)).select("doc", "start", F.posexplode("earlier").alias("j", "gone")).where("gone").select("doc", (F.col("start") + F.col("j")).alias("start"), F.lit(1).alias("n"))
    out = written(copies.unionByName(some).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "runs")
    for used in (segments, first, once, crowded, told, windows_told, fate):
        discard(used)
    release(spark)
    return out


def dedup_substrings(docs: DataFrame, window: int = WINDOW, names: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """docs with repeated passages removed: every column of docs, text replaced by the kept words joined by blanks where words went, plus n_words, n_removed and kept (the kept words joined by one blank, of every text).

    Words are runs without the bytes 20 and 09-0D. A word goes if a window of `window` words that
    covers it also starts earlier: in a smaller doc_id, or before it in the same one; windows are judged on the
    input. A null or empty text has no words. Rows that repeat a doc_id are one document: they
    are judged alike and equal rows don't remove each other; a null doc_id precedes all
    others. A very long text is one document like any other: its segments go to many shards. No rows give no rows. Texts in which nothing goes are left as they are. names has the names of the three new
    columns; columns of those names are replaced.
    """
    runs = removed_windows(as_long(docs), window)
    key, gone = spare(docs, "sd_doc"), spare(docs, "sd_runs")
    runs = runs.select(F.col("doc").alias(key), F.col("runs").alias(gone))
    joined = docs.join(runs, F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)).cast("long")) == F.col(key), "left")

    joined = joined.drop(key, *[c for c in docs.columns if c.lower() in {n.lower() for n in names}])
    fields = [f for f in joined.schema if f.name != gone]
    at_text, at_gone = joined.columns.index("text"), joined.columns.index(gone)

    def run(batches):
        for part in sliced(batches):
            new: list[list] = [[], [], [], []]
            for t, g in zip(part.column(at_text).to_pylist(), part.column(at_gone)):
                words = words_of(t or "")
                if g.is_valid and len(g):
                    edge = np.zeros(len(words) + 1, np.int64)
                    start, n = (np.asarray(x, np.int64) for x in g.values.flatten())
                    n = np.minimum(n, len(words) - window + 1 - start)  # another text of the same id may be longer
                    start, n = start[n > 0], n[n > 0]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    kept = b" ".join([words[i] for i in left.tolist()]).decode()
                    n_gone = len(words) - len(left)
                else:
                    kept, n_gone = b" ".join(words).decode(), 0
                for col, v in zip(new, (kept if n_gone else t, len(words), n_gone, kept)):
                    col.append(v)
            columns = [pa.array(new[0], pa.string()) if i == at_text else c for i, c in enumerate(part.columns) if i != at_gone]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(new[1], pa.int64()), pa.array(new[2], pa.int64()), pa.array(new[3], pa.string())], names=[*(f.name for f in fields), *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{names[0]}` bigint, `{names[1]}` bigint, `{names[2]}` string"
    return joined.mapInArrow(tidy(run), schema)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM g),
f AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY s) < (doc_id, i) AS gone FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE gone),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT a.doc_id, a.word, a.i, c.i IS NOT NULL AS gone FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.i = a.i),
s AS (SELECT doc_id, count(*) AS n_words, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""
