"""Exact n-gram Jaccard join and its components.

1. Sets that are equal fold into the one of least id. A set can only have a link if enough of its
   shingles occur in another set; the rest are alone and leave.
2. Sets that remain are indexed by their prefixes under one order of shingles (frequent ones
   last): linked sets share a shingle in their prefixes.
3. Set relations skip most of the work. In a few turns, each set is compared with one pivot of its lists; sets
   linked so far form a block of the index lists. A list of a single block is skipped whole. Two blocks
   that meet in a list are compared by their roots: as 1 - J is a metric, with radii r of the blocks,
   a root distance D > 1/4 + r1 + r2 means that no member of one links with a member of the other,
   and D <= 1/4 joins them at once. Only blocks between these are opened, and there the
   known distances of members to their roots answer for most pairs again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, tidy, written
from .components import components
from .hashing import as_long, bucket_count, hashes_of_texts, mix, repeated_hashes, windows

SHINGLE, NUM, DEN = 5, 75, 100
#: Shingles in so many sets come last in the order; at most so many of them (8 bytes each) are broadcast, the most frequent. Any order is exact.
FREQUENT, FREQUENT_MOST = 48, 1_000_000
#: Bits of a set's bitmap.
BITS = 2048
#: First places of prefixes that are compared to tell whether two sets have met before.
EARLY = 16
#: Turns in which each set meets one pivot, before blocks are compared.
STARS = 3
#: Pairs of one set that are verified by one task.
TOGETHER = 1000


def set_maker(k: int):
    """In a worker: texts to (sorted distinct shingle hashes, signature)."""

    def make(texts: list[str]):
        for (h,) in hashes_of_texts(texts, lower=True):
            if len(h) >= k:
                s = np.unique(windows(h, k))
            elif len(h):
                one = np.full(1, len(h), np.uint64)
                for x in h:
                    one = mix(one, np.full(1, x, np.uint64))
                s = mix(one, np.full(1, 77, np.uint64))
            else:
                s = h
            yield s, xxhash.xxh3_128_digest(s.tobytes())

    return make


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """BITS bits, of which each token sets one: two sets differ in at least as many tokens as their bitmaps do in bits."""
    out = np.zeros(BITS, np.uint8)
    out[(tokens.view(np.uint64) >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(out).view(np.int64)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """rep, sig, text -> rep, n, tokens, bits, for texts whose set has the signature."""

    def run(batches):
        make = set_maker(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, s) for i, sig, (s, own) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), make(part.column(2).to_pylist())) if sig == own]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()), pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64())), pa.array([bitmap(s) for _, s in rows], pa.list_(pa.int64()))], names=["rep", "n", "tokens", "bits"])

    return texts.select("rep", "sig", "text").mapInArrow(tidy(run), "rep bigint, n bigint, tokens array<bigint>, bits array<bigint>")


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """token, rep, n, pos of the prefixes: pos counts from 0 in the order."""
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.col("count").desc(), "token").limit(FREQUENT_MOST).toArrow().to_pandas()  # at most FREQUENT_MOST rows
    top = top.sort_values(["count", "token"])
    order = np.argsort(top["token"].to_numpy(np.int64))
    frequent = sets.sparkSession.sparkContext.broadcast((top["token"].to_numpy(np.int64)[order], (order + 1).astype(np.int32)))

    def run(batches):
        token, rank = frequent.value
        for batch in batches:
            reps, ns, sets_ = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out = []
            for i, n in enumerate(ns):
                s = np.asarray(sets_[i].values)
                if len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    late = np.where(token[at] == s, rank[at], 0)
                else:
                    late = np.zeros(len(s), np.int32)
                out.append(s[np.lexsort((s, late))][: n - (num * n + den - 1) // den + 1])
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ns, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["rep", "n", "prefix"])

    lists = sets.select("rep", "n", "tokens").mapInArrow(tidy(run), "rep bigint, n bigint, prefix array<bigint>")
    return lists.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Distinct pairs (a, b) with common and total, the sizes of their intersection and union; written.

    The set of a is sent once for each TOGETHER of its pairs, so a pivot of many is shared by tasks.
    """
    pairs = written(pairs, f"{name}-pairs")
    per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("salts"))
    left = per.join(sets, F.col("a") == F.col("rep")).select("a", F.col("tokens").alias("ta"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    right = pairs.join(per, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts"))).join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb")), "b")
    both = right.join(left, ["a", "salt"])
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    out = written(both.select("a", "b", common.alias("common"), (F.size("ta") + F.size("tb")).alias("sizes")).select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("total")), name)
    discard(pairs)
    release(sets.sparkSession)
    return out


def _linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    return pairs.where(F.lit(den) * F.col("common") >= F.lit(num) * F.col("total")).select("a", "b")


def _fits(num: int, den: int):
    """May two entries of a list be the first common shingle of a linked pair? By sizes n, m and positions i, j."""
    n, m, i, j = (F.col(c) for c in ("n", "m", "i", "j"))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((num + den) * F.least(n - i, m - j) >= num * (n + m))


def _blocks(links: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, root of every set under the links; written."""
    found = components(links)
    return written(sets.select("rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("root")), "blocks")


def _meeting(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entries, with their blocks, of lists in which blocks meet; a list of one block is skipped whole."""
    placed = entries.join(blocks, "rep")
    lists = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return placed.join(lists, "token")


def _rep_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among distinct sets that give the components of all their links."""
    spark = sets.sparkSession
    all_entries = _prefixes(sets, num, den)
    shared = all_entries.groupBy("token").count().where("count > 1").select("token")
    entries = written(all_entries.join(shared, "token"), "entries")
    release(spark)
    blocks = written(sets.select("rep").distinct().withColumn("root", F.col("rep")), "blocks")
    links, placed = None, written(entries.join(blocks, "rep"), "placed")
    for turn in range(STARS):
        # each set meets one set of another block: the pivot of most of its lists, drawn by another hash in each turn
        pivot = placed.groupBy("token").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("h"), F.col("rep").alias("pivot"), F.col("root").alias("pivot_root"))).alias("m")).select("token", "m.pivot", "m.pivot_root")
        votes = placed.join(pivot, "token").where("root <> pivot_root").groupBy("rep", "pivot").count()
        star = votes.groupBy("rep").agg(F.max(F.struct("count", "pivot")).alias("m")).select(F.col("m.pivot").alias("a"), F.col("rep").alias("b"))
        new = _linked(_verified(star, sets, "star"), num, den)
        links = written(new if links is None else links.unionByName(new), "links")
        blocks = _blocks(links, sets)
        discard(placed)
        placed = written(_meeting(entries, blocks), "placed")
        release(spark)
        if placed.isEmpty():
            return links
    # distances of members to their roots
    member = blocks.where("root <> rep").select(F.col("root").alias("a"), F.col("rep").alias("b"))
    far = _verified(member.join(placed.select("root").distinct(), member["a"] == F.col("root"), "left_semi"), sets, "reach").select(F.col("b").alias("rep"), (1 - F.col("common") / F.col("total")).alias("far")).groupBy("rep").agg(F.max("far").alias("far"))
    placed = written(placed.join(far, "rep", "left").withColumn("far", F.coalesce("far", F.lit(0.0))), "placed")
    reach = blocks.join(far, "rep").groupBy("root").agg(F.max("far").alias("radius"))
    # blocks that meet in a list where their ranges of sizes and positions leave a chance
    ranges = placed.groupBy("token", "root").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep"), F.max("far").alias("slack"))
    # each block brings a bitmap: that of its set, if it has one in the list, or its root's, from which its sets in the list are no farther than slack
    alone = F.col("c") == 1
    ranges = ranges.withColumn("rep", F.when(alone, F.col("rep")).otherwise(F.col("root"))).withColumn("slack", F.when(alone, 0.0).otherwise(F.col("slack")))
    ranges = ranges.join(sets.select("rep", F.col("n").alias("size"), "bits"), "rep")
    # two sets, each alone of its block in a list, that share a shingle before it have met in that one's list: sets bring the EARLY first shingles of their prefixes
    single = sets.groupBy("rep").count().where("count = 1").select("rep")
    heads = entries.where(F.col("pos") < EARLY).join(single, "rep", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("pos", "token")).alias("head"))
    early = F.when(F.col("c") == 1, F.filter("head", lambda h: h["pos"] < F.col("n0") - F.col("rest"))["token"])
    ranges = ranges.join(heads, "rep", "left").withColumn("early", early).drop("rep", "c", "head")
    x, y = ranges.alias("x"), ranges.alias("y")
    # sets that differ in so many tokens at least are 2 apart / (total + apart) from each other at least
    apart = sum((F.bit_count(F.get("x.bits", F.lit(i)).bitwiseXOR(F.get("y.bits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    total = F.col("x.size") + F.col("y.size")
    may = 2 * apart <= (1 - num / den + F.col("x.slack") + F.col("y.slack") + 1e-9) * (total + apart)
    fresh = F.coalesce(~F.arrays_overlap("x.early", "y.early"), F.lit(True))
    meet = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & (den * F.col("x.n1") >= num * F.col("y.n0")) & (den * F.col("y.n1") >= num * F.col("x.n0")) & ((num + den) * F.least("x.rest", "y.rest") >= num * (F.col("x.n0") + F.col("y.n0"))) & may & fresh)
    meet = written(meet.select("x.token", F.col("x.root").alias("a"), F.col("y.root").alias("b")), "meet")
    near = _verified(meet.select("a", "b").distinct(), sets, "roots")
    ra, rb = reach.select(F.col("root").alias("a"), F.col("radius").alias("ra")), reach.select(F.col("root").alias("b"), F.col("radius").alias("rb"))
    gap, slack, zero = F.lit(1 - num / den), F.lit(1e-9), F.lit(0.0)
    doubtful = near.where(F.lit(den) * F.col("common") < F.lit(num) * F.col("total")).withColumn("d", 1 - F.col("common") / F.col("total")).join(ra, "a", "left").join(rb, "b", "left")
    doubtful = doubtful.where((F.coalesce("ra", zero) + F.coalesce("rb", zero) > 0) & (F.col("d") <= gap + F.coalesce("ra", zero) + F.coalesce("rb", zero) + slack)).select("a", "b", "d")
    # what is left is opened list by list
    p = placed.select("token", F.col("rep").alias("p"), F.col("n"), F.col("pos").alias("i"), F.col("root").alias("a"), F.col("far").alias("fa"))
    q = placed.select("token", F.col("rep").alias("q"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("root").alias("b"), F.col("far").alias("fb"))
    opened = meet.join(doubtful, ["a", "b"]).join(p, ["token", "a"]).join(q, ["token", "b"]).where(_fits(num, den) & (F.col("d") <= gap + F.col("fa") + F.col("fb") + slack)).where("fa + fb > 0")
    rest = _verified(opened.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), sets, "opened")
    return links.unionByName(_linked(near, num, den)).unionByName(_linked(rest, num, den))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id (the least doc_id reachable by links).

    A-Z are lower-cased; a text's set has its distinct k-word shingles, or its whole sequence if it
    has fewer words. Sets of J >= num/den are linked; a text without words has an empty set and no
    link. Rows that repeat a doc_id are one document with several sets. A row without doc_id takes no part and
    has a null component. A very long text is one set of all its shingles. No rows give no rows. Other columns are ignored.

    Shingles are compared by 64-bit hashes of words' 64-bit hashes, so two different ones are taken as equal once in 2^64.
    """
    spark = docs.sparkSession
    texts = as_long(docs)
    sized = written(repeated_hashes(texts, lambda: set_maker(k), bucket_count(texts)), "sets-sized")
    release(spark)
    known = sized.where("n > 0 AND doc_id IS NOT NULL")
    reps = written(known.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.first("n").alias("n"), F.max("n_repeated").alias("u")), "reps")
    able = reps.where(F.lit(den) * F.col("u") >= F.lit(num) * F.col("n")).select("rep", "sig")
    sets = written(_sets(texts.join(able, texts["doc_id"] == able["rep"]), k).dropDuplicates(["rep", "tokens"]), "sets", "lz4")
    release(spark)
    # a doc_id with several texts is several sets of one node: number the sets by their least member, or by one of their own
    same = known.join(reps.where("rep <> other").select("sig", "rep"), "sig").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(_rep_links(sets, num, den).unionByName(same))
    comp = found.groupBy("node").agg(F.min("component").alias("component_id"))
    return sized.join(comp, sized["doc_id"] == comp["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
