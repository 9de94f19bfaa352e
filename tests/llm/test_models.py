"""Language model and toxicity: exact parts against brute force, the rest on held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from keystrata.llm import lm, toxicity


def test_tables_have_their_exact_distribution():
    """A dish of 9 customers whose new table weighs a: seat them one by one."""
    d, c, a = lm.DISCOUNT, 9, 1.7
    drawn = np.bincount(lm.draw_tables(np.full(40_000, c), np.full(40_000, a), np.random.default_rng(1).random(40_000)).astype(int), minlength=c + 1) / 40_000
    # seatings counted by the recurrence: the last customer opens a table or joins one of t with c - 1 others
    ways = {1: 1.0}
    for n in range(1, c):
        ways = {t: ways.get(t - 1, 0) + (n - t * d) * ways.get(t, 0) for t in range(1, n + 2)}
    p = np.array([0] + [ways[t] * a**t for t in range(1, c + 1)])
    assert np.abs(drawn - p / p.sum()).max() < 0.01


def test_large_counts_stay_in_bounds():
    c = np.array([1, 2, 10**3, 10**7, 10**12])
    for a in (1e-9, 1.0, 1e6):
        for u in (0.0, 0.5, 0.999999):
            t = lm.draw_tables(c, np.full(5, a), np.full(5, u))
            assert (t >= 1).all() and (t <= c).all()


def ways(c, d):
    """Seatings of c customers at t tables, by the recurrence: the last one opens a table or joins one of t with c - 1 others."""
    out = {1: 1.0}
    for n in range(1, c):
        out = {t: out.get(t - 1, 0) + (n - t * d) * out.get(t, 0) for t in range(1, n + 2)}
    return out


def test_a_restaurant_has_its_exact_distribution():
    """Dishes drawn in turn give the joint distribution of tables that the Pitman-Yor process has, listed in full."""
    d, theta, counts, parent, chains = lm.DISCOUNT, lm.STRENGTH, (4, 11, 2), (0.3, 0.05, 0.2), 30_000
    exact = Counter()
    seatings = [ways(c, d) for c in counts]
    for t in ((x, y, z) for x in seatings[0] for y in seatings[1] for z in seatings[2]):
        exact[t] = math.prod(w[k] * p**k for w, k, p in zip(seatings, t, parent)) * math.prod(theta + d * i for i in range(sum(t)))
    whole, rng = sum(exact.values()), np.random.default_rng(3)
    tables = np.tile(np.array(counts, float)[:, None], (1, chains))
    for _ in range(30):
        for k, c in enumerate(counts):
            others = tables.sum(0) - tables[k]
            tables[k] = lm.draw_tables(np.full(chains, c), (theta + d * others) * parent[k], rng.random(chains), others)
    drawn = Counter(map(tuple, tables.T.astype(int).tolist()))
    assert max(abs(drawn[t] / chains - p / whole) for t, p in exact.items()) < 0.01
    # a great dish alone, where the mode is far from that without its own tables' weight
    c = 400
    t = lm.draw_tables(np.full(4000, c), np.full(4000, theta * 0.5), rng.random(4000), np.zeros(4000))
    logs = [math.lgamma(2 * c - k) - math.lgamma(c - k + 1) - math.lgamma(k) + k * math.log(4) + k * math.log(0.5) + sum(math.log(theta + d * i) for i in range(k)) for k in range(1, c + 1)]
    weight = np.exp(np.array(logs) - max(logs))
    mean = (weight * np.arange(1, c + 1)).sum() / weight.sum()
    assert abs(t.mean() - mean) < 0.02 * mean


@pytest.mark.parametrize("direct", [3, 200_000])
def test_score_against_plain_sums(spark, monkeypatch, direct):
    """In a corpus without a pair that occurs twice nothing is drawn for pairs: each score follows from the parents' tables, token by token."""
    monkeypatch.setattr(lm, "DIRECT", direct)
    monkeypatch.setattr(lm, "FREQUENT", 4)
    monkeypatch.setattr(lm, "ENDINGS", 3)
    models, init = [], lm.Model.__init__
    monkeypatch.setattr(lm.Model, "__init__", lambda self, docs: (models.append(self), init(self, docs))[1])
    rng, seen, rows = random.Random(5), set(), []
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    for i in range(80):
        out, last = [], None
        for w in rng.sample(words, 25):
            if (last, w) not in seen and (last is not None or not any(r[1].split()[:1] == [w] for r in rows)):
                out.append(w)
                seen.add((last, w))
                last = w
        if (last, None) not in seen and out:
            seen.add((last, None))
            rows.append((i, " ".join(out)))
    rows += [(i, text + " unheard-of words") for i, text in [(200 + k, rows[k][1]) for k in range(8)] if zlib.crc32(str(i).encode()) % 5 == 1]
    got = {r["doc_id"]: (r["held_out"], r["score"]) for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    (model,), k = models, models[0].classes
    lp = {r["id"]: r["lp"] for r in model.words.collect()}
    train = [["", *t.split(), ""] for i, t in rows if not got[i][0]]
    pairs = Counter(p for t in train for p in zip(t, t[1:]))
    uses = Counter(u for t in train for u in t[:-1])
    assert set(pairs.values()) == {1} and any(h for h, _ in got.values())
    number = lambda w: int(model.d.ids(lm._hashes([w.encode()]))[0])
    for i, text in rows:
        total, t = 0.0, ["", *text.split(), ""]
        for u, w in zip(t, t[1:]):
            ku, kw = (k.of(x.encode()) if x else k.edge for x in (u, w))
            if w and number(w) in lp:
                of_class = lp[number(w)]
            else:
                of_class = math.log10(sum(n[kw] * math.exp(s.log_of([w.encode()])[0]) for s, n in zip(model.spellers, model.new)) / len(model.spellers)) if w else 0.0
            own = (1 - lm.DISCOUNT) * pairs[u, w]
            total += math.log10((own + (lm.STRENGTH + lm.DISCOUNT * uses[u]) * 10 ** (float(model.log_class[ku, kw]) + of_class)) / (lm.STRENGTH + uses[u]))
        assert math.isclose(total, got[i][1], rel_tol=1e-4), (i, text)


def test_lgamma():
    x = np.array([0.5, 1, 2, 3.3, 7.9, 8, 20, 1e6])
    assert np.allclose(lm.lgamma(x), [math.lgamma(v) for v in x], atol=1e-8)


def test_restaurants_are_probabilities():
    rng = np.random.default_rng(0)
    rows, cols = np.nonzero(rng.random((12, 7)) < 0.5)
    none = np.zeros(0, np.int64)
    s = lm.Seating([(rows, cols, rng.integers(1, 90, len(rows))), (np.array([1]), np.array([3]), np.array([5.0])), (none, none, np.zeros(0))], [np.arange(12) % 3, np.zeros(3, np.int64)], 7, 1)
    for level in s.averaged((0, 1, 2)):
        assert np.allclose(level.sum(1), 1, atol=1e-5) and (level > 0).all()


def test_spelling_sums_to_one_in_each_class():
    """Over an alphabet of two letters, all words of a class have mass 1."""
    words = [b"ab", b"abab", b"ba", b"b", b"aab", b"bba"] * 5
    context, symbol, _ = lm.spelling(words)
    code, count = np.unique(context * lm.SYMBOLS + symbol, return_counts=True)
    classes = lm.Classes([b"ab"], [b"ab", b"ba"])
    s = lm.Speller([(code, count.astype(float))] + [(np.zeros(0, np.int64), np.zeros(0))] * 3, classes, 1)
    assert np.allclose(np.exp(s.logs).sum(1), 1, atol=1e-4)
    # make all other letters impossible, then sum over all words of up to 13 letters and bound what is longer
    s.logs[:, [x for x in range(256) if x not in b"ab"]] = -80
    s.logs -= np.log(np.exp(s.logs).sum(1, keepdims=True))
    s._masses()
    mass = Counter()
    level = [b"a", b"b"]
    for _ in range(13):
        for w, p in zip(level, np.exp(s.log_of(level))):
            if w != b"ab":
                mass[classes.endings.get(w[-2:], classes.other)] += p
        level = [x + w for w in level for x in (b"a", b"b")]
    assert all(0.97 < mass[k] <= 1.0001 for k in (classes.endings[b"ab"], classes.endings[b"ba"], classes.other))


def test_spelling_contexts_that_are_not_sent_count_too(spark, monkeypatch):
    """The first byte of a word follows from the four after it, and from no fewer: all contexts count, whether workers hold them or not."""
    rng = random.Random(3)
    words = ["".join(rng.choice("wxyz") + "".join(x)).encode() for x in itertools.product("abcd", repeat=4)]
    other = [bytes([next(y for y in b"wxyz" if y != w[0])]) + w[1:] for w in words]
    classes = lm.Classes([words[0]], [])
    codes = lm._spelling_codes(spark.createDataFrame([(w, 20.0) for w in words] + [(w, 0.0) for w in other], "w binary, t double"))
    logs, mass = {}, {}
    for kept in (100_000, 5):
        monkeypatch.setattr(lm, "KEPT", kept)
        speller = None
        for sweep in range(2):
            speller, more = lm._speller(codes, classes, speller, sweep)
        assert (more is None) == (kept > 5) and len(speller.contexts[0]) < (1000 if kept > 5 else 20)
        rows = lm._with_more(spark.createDataFrame([(w,) for w in words + other], "w binary"), spark.sparkContext.broadcast(speller), more).toArrow()
        added = dict(zip(rows["w"].to_pylist(), rows["more"].to_pylist()))
        logs[kept] = speller.log_raw(words + other) + [added[w] for w in words + other]
        mass[kept] = speller.log_mass
        # the right first byte against a wrong one: two bytes of context would tell them apart by chance only
        assert (logs[kept][:256] - logs[kept][256:]).min() > 2
    assert np.abs(logs[5] - logs[100_000])[:256].max() < 0.5 and np.abs(mass[5] - mass[100_000]).max() < 0.01


def test_chunks_are_scored_without_their_words(messy, monkeypatch):
    """Rare words, also those of held-out texts alone, are told with class and probability; the model's chunks leave the disk."""
    monkeypatch.setattr(lm, "DIRECT", 50)
    monkeypatch.setattr(lm, "FREQUENT", 20)
    model = lm.Model(messy.select("doc_id", "text", (lm.doc_number() % 5 == 1).alias("held_out")))
    counts = {bytes(h): w for r in model.chunks.select("hashes", "words").collect() for h, w in zip(np.frombuffer(r["hashes"], "V8"), r["words"])}
    told = lm._known_words(model)
    assert not {"words", "counts"} & set(told.columns)
    for r in told.collect():
        h, ids = np.frombuffer(r["hashes"], "V8"), model.d.ids(np.frombuffer(r["hashes"], "<u8"))
        assert sorted(x["at"] for x in r["told"]) == np.flatnonzero(ids < 0).tolist()
        assert all(x["k"] == model.classes.of(bytes(counts[bytes(h[x["at"]])])) and x["lp"] < 0 for x in r["told"])
    with pytest.raises(Exception):
        model.chunks.collect()


def test_chunks_are_small_rows_that_are_never_shuffled(spark, monkeypatch):
    """Executors hold chunks compressed, and what is told of their words comes to them."""
    plans, write = {}, lm.written
    monkeypatch.setattr(lm, "written", lambda df, name, *x: (plans.update({name: df._jdf.queryExecution().toString()}), write(df, name, *x))[1])
    monkeypatch.setattr(lm, "DIRECT", 50)
    monkeypatch.setattr(lm, "FREQUENT", 20)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(400))) for i in range(60)]
    model = lm.Model(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    (chunk,) = model.chunks.collect()
    assert chunk["n_words"] == 60 * 400 and len(chunk["codes"]) < 2 * chunk["n_words"]
    (told,) = lm._known_words(model).collect()
    assert len(told["told"]) == len(told["hashes"]) // 8 - 50 > 0
    assert "Exchange" not in plans["told"] and "Join" not in plans["told"]


def test_buckets_are_bounded_whatever_the_splits(messy, monkeypatch):
    class Enough(Exception):
        pass

    def stop(chunks, direct, hot, buckets, *_):
        raise Enough(buckets)

    monkeypatch.setattr(lm, "_first_tables", stop)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 100)
    words = sum(len((r["text"] or "").encode().split()) for r in messy.collect())
    with pytest.raises(Enough) as found:
        lm.Model(messy.coalesce(1).select("doc_id", "text"))
    assert found.value.args[0] >= words // 100 > 16


def test_restaurants_that_are_not_sent_sum_to_one():
    rng = np.random.default_rng(2)
    contexts = np.unique(rng.integers(0, 4, (40, 4)) @ lm.SIDE ** np.arange(4))
    code = (contexts[:, None] * lm.SYMBOLS + np.arange(lm.SYMBOLS)).ravel()
    c = np.where(rng.random(len(code)) < 0.05, rng.integers(1, 60, len(code)), 0).astype(float)
    for least in (200.0, 1e9):
        rest = lm.Rest(code, c, least)
        p = rest.run(lambda x, k, longest: np.full(len(x), -math.log(lm.SYMBOLS)), 0)
        sums = np.bincount(np.unique(rest.context, return_inverse=True)[1], p)
        assert len(sums) and np.allclose(sums, 1) and (least < 1e9) == (len(rest.sent) > 0)
        own = {order: c.sum() for order, _, c in rest.customers()}
        assert own[4] + rest.c.sum() == c.sum() and 0 < own[2] <= rest.c.sum()


def brute_base(rows, folds=5, held=1):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = [(zlib.crc32(("" if i is None else str(i)).encode()) % folds == held, (t or "").encode().translate(low).split() + [b""]) for i, t in rows]
    counts = Counter(w for h, ws in tokens if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (i, _), (h, ws) in zip(rows, tokens)]


@pytest.mark.parametrize("direct", [5, 200_000])
def test_lm_base(messy, nothing, monkeypatch, direct):
    monkeypatch.setattr(lm, "DIRECT", direct)
    monkeypatch.setattr(lm, "FREQUENT", 20)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    rows = lm.score_documents(messy).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=key)
    expected = sorted(brute_base([(r["doc_id"], r["text"]) for r in messy.collect()]), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    if direct > 5:
        assert lm.score_documents(nothing).count() == 0


def test_words_are_averaged_after_burn_in(messy, monkeypatch):
    sweeps, seat = [], lm._seat_words
    monkeypatch.setattr(lm, "FREQUENT", 20)
    monkeypatch.setattr(lm, "_seat_words", lambda rare, speller, tables, sweep: sweeps.append(speller) or seat(rare, speller, tables, sweep))
    model = lm.Model(messy.select("doc_id", "text"))
    assert 0 < len(model.spellers) < len(sweeps) and model.spellers == sweeps[-len(model.spellers) :] and len(model.new) == len(model.spellers)
    assert lm.KEPT >= 10_000


def test_pairs_of_rare_words_count(spark, monkeypatch):
    """x1 is always followed by y1, x2 by y2, and so on, all words being of one class: only pairs of words can tell."""
    monkeypatch.setattr(lm, "FREQUENT", 2)
    rng = random.Random(4)
    name = lambda kind, i: f"{kind}{chr(97 + i // 26)}{chr(97 + i % 26)}zz"
    rows = [(i, " ".join(f"{name('x', j)} {name('y', j)} the" for j in rng.choices(range(100), k=30))) for i in range(200)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows += [(held[0], " ".join(f"{name('x', j)} {name('y', j)} the" for j in range(100))), (held[1], " ".join(f"{name('x', j)} {name('y', (j + 37) % 100)} the" for j in range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for direct, direct_pairs in ((200_000, 1_000_000), (20, 5)):
        monkeypatch.setattr(lm, "DIRECT", direct)
        monkeypatch.setattr(lm, "DIRECT_PAIRS", direct_pairs)
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
        assert got[held[0]] > got[held[1]] + 100


def test_lm_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_documents(docs).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_kernel_tolerates_gaps():
    def k(a, b):
        c, w, o = toxicity.subsequences([a, b])
        v = [Counter(), Counter()]
        for code, weight, own in zip(c.tolist(), w.tolist(), o.tolist()):
            v[own][code] += weight
        return sum(v[0][code] * v[1][code] for code in v[0]) / math.sqrt(sum(x * x for x in v[0].values()) * sum(x * x for x in v[1].values()))

    assert math.isclose(k("idiot", "idiot"), 1)
    assert k("idiot", "idiiot") > 0.5 and k("idiot", "idxiot") > 0.2 > k("idiot", "table")


def test_margins_sum_the_subsequences():
    """The machine's sums at places equal the listed subsequences' weights, word by word."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgéüжды中文") for _ in range(rng.randrange(2, 25))) for _ in range(300)]
    machine = toxicity.Machine([], [], [], None)
    machine.table[:] = np.random.default_rng(1).normal(size=len(machine.table))
    machine.bias = 0.25
    code, weight, own = toxicity.subsequences(words)
    assert np.allclose(machine.margins(words), np.bincount(own, machine.table[code] * weight, len(words)) + 0.25, atol=1e-5)


def test_kernel_of_unrelated_words_is_small_in_any_script():
    rng = random.Random(8)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(map(chr, range(0x4E00, 0x4F00)))):
        words = ["".join(rng.choice(letters) for _ in range(8)) for _ in range(200)]
        code, weight, own = toxicity.subsequences(words)
        cells = defaultdict(list)
        for c, w, o in zip(code.tolist(), weight.tolist(), own.tolist()):
            cells[c].append((o, w))
        total = sum(w * v for x in cells.values() for o, w in x for q, v in x if o != q)
        assert total / (200 * 199) < 0.005
    assert toxicity.units("you id iot") == ["you", "id", "iot"] and toxicity.units("傻瓜") == ["傻瓜"]


def test_units_undo_disguise():
    assert toxicity.units("You 1d10t!!") == ["you", "idiot"]
    assert "idiot" in toxicity.units("an i d i o t here") and "idiot" in toxicity.units("i-d.i*o_t")
    assert toxicity.units("") == toxicity.units("* 12 ##") == []


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    hit = got["predicted"] == 1
    assert (hit & (got["toxic"] == 1)).sum() > 0.85 * (got["toxic"] == 1).sum()
    assert (hit & (got["toxic"] == 0)).sum() < 0.03 * (got["toxic"] == 0).sum()
    assert ((got["score"] >= 0.3) == hit).all()


def test_planted_gaps_are_found(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeounthrsl") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    sentence = lambda bad="": " ".join([rng.choice(words) for _ in range(12)] + ([bad] if bad else [])) + "."
    bad = ["grumpface", "dimwit", "blockhead"]
    rows = [(i, " ".join(sentence(rng.choice(bad) if i % 4 == 0 and rng.random() < 0.5 else "") for _ in range(8)) + (f" {bad[i % 3]}" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    new = [(1000, sentence("grump-face")), (1001, sentence("d i m w i t")), (1002, sentence("bl0ckhead")), (1003, sentence("dimmwit")), (1004, sentence()), (1005, "")]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(rows + new, "doc_id long, text string"), labels).collect()}
    assert [got[i]["predicted"] for i in range(1000, 1006)] == [1, 1, 1, 1, 0, 0]


def test_all_clean_units_are_mined(messy, labels, monkeypatch):
    found, init = [], toxicity.Machine.__init__

    def spied(self, positive, common, by_hash, hardest):
        init(self, positive, common, by_hash, hardest)
        found.append((set(positive), [w for w, _ in hardest(self, 1_000_000)]))

    monkeypatch.setattr(toxicity.Machine, "__init__", spied)
    toxicity.train_detector(messy, labels)
    kind = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            kind[r["doc_id"]] = max(r["toxic"], kind.get(r["doc_id"], 0))
    sentences = {}
    for r in messy.collect():
        if r["doc_id"] in kind:
            for x in toxicity.SENTENCE.split(r["text"] or ""):
                own = tuple(toxicity.units(x))
                sentences[own] = min(kind[r["doc_id"]], sentences.get(own, 1))
    (positive, mined), = found
    assert len(mined) == len(set(mined)) and set(mined) == {w for own, toxic in sentences.items() if not toxic for w in own} - positive


def test_toxicity_messy(spark, messy, nothing, labels):
    got = toxicity.score_toxicity(messy, labels).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in got)
    assert {r["predicted"] for r in toxicity.score_toxicity(messy, labels.where("false")).collect()} == {0}
    assert toxicity.score_toxicity(nothing, labels).count() == 0
