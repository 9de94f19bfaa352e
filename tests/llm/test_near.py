"""Jaccard join, components and substring dedup against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from keystrata.llm import components, hashing, jaccard, substring
from keystrata.llm.jaccard import jaccard_components, set_maker
from keystrata.llm.substring import SuffixAutomaton, dedup_substrings


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    rng.shuffle(chain)
    links = chain + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p if p[0] != p[1]}
    assert got == reach(nodes, links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_jaccard(rows):
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = reach({i for i, _ in known}, links)
    return sorted(((i, len(shingles(t)), root.get(i)) for i, t in rows), key=str)


def family(rng, n, vocabulary=400):
    """Groups of near copies with chains of edits, exact copies, a common passage."""
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(30)]
    docs = []
    while len(docs) < n:
        own = [rng.choice(words) for _ in range(rng.choice([3, 12, 40, 90]))]
        if rng.random() < 0.3:
            own = own[:10] + passage + own[10:]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            docs.append(" ".join(own))
            if rng.random() < 0.8:
                for _ in range(rng.randrange(4)):
                    own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.2:
                own = own[: max(1, int(len(own) * 0.9))]
    rng.shuffle(docs)
    return list(enumerate(docs[:n]))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, monkeypatch, seed):
    monkeypatch.setattr(hashing, "CHUNK_HASHES", 400)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    monkeypatch.setattr(jaccard, "STARS", seed)
    rows = family(random.Random(seed), 240)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute_jaccard(rows)


def test_jaccard_without_turns_opens_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STARS", 1)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_jaccard(rows)


def test_jaccard_messy(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert sorted(map(tuple, jaccard_components(messy).collect()), key=str) == brute_jaccard(rows)
    assert jaccard_components(nothing).count() == 0


def test_repeated_hashes(spark, monkeypatch):
    monkeypatch.setattr(hashing, "CHUNK_HASHES", 200)
    rows = family(random.Random(3), 150)
    got = hashing.repeated_hashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lambda: set_maker(5), 16).collect()
    times = Counter(s for _, t in rows for s in shingles(t))
    expected = {i: (len(shingles(t)), sum(times[s] > 1 for s in shingles(t))) for i, t in rows}
    assert {r["doc_id"]: (r["n"], r["n_repeated"]) for r in got} == expected


def test_suffix_automaton():
    rng = random.Random(6)
    for _ in range(200):
        known = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))) for _ in range(3)]
        a = SuffixAutomaton()
        for k in known:
            a.insert(list(k))
        s = "".join(rng.choice("abc") for _ in range(15))
        expected = [max(n for n in range(i + 2) if any(s[i + 1 - n : i + 1] in k for k in known)) for i in range(len(s))]
        assert a.statistics(list(s)) == expected
        assert a.has(list(s)) == any(s in k for k in known) and a.has([])


def thue_morse(n):
    """Two words of n letters that agree under any polynomial hash modulo a power of two, if n is large enough."""
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_words_that_polynomials_confuse(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = []
    for n in (512, 1024, 4096):
        for k, odd in enumerate(thue_morse(n)):
            rows.append((10 * n + k, " ".join(words[:10] + [odd] + words[10:19])))
    rows += [(1, " ".join(words)), (2, " ".join(words)), (3, "")]
    hashes = [h[0] for h in hashing.hashes_of_texts([w for n in (64, 512, 1024, 4096) for w in thue_morse(n)])]
    assert len({int(h[0]) for h in hashes}) == 8
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == brute_substrings(rows, 20)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_jaccard(rows)


def test_hashes_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\x0bÉé\x1cZ") for _ in range(rng.randrange(0, 60))) for _ in range(200)] + ["x" * 5000, "", " "]
    for lower in (False, True):
        low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
        seen = {}
        for text, (a, b) in zip(texts, hashing.hashes_of_texts(texts, lower, (0, 1))):
            words = (text.encode().translate(low) if lower else text.encode()).split()
            assert len(a) == len(b) == len(words)
            for w, x, y in zip(words, a.tolist(), b.tolist()):
                assert seen.setdefault(w, (x, y)) == (x, y) and x != y
        assert len(set(seen.values())) == len(seen)


def test_anchor_runs_of_many_documents():
    """Every window has the leftmost place of its least hash as its anchor, and no run crosses documents."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 3, 19, 20, 21, 60]))) for _ in range(40)] + ["r " * 90]
    (h,), sizes = substring._together(texts, (0,))
    start, stop, best, doc = substring.anchor_runs(h, sizes, 20, 8)
    covered = {}
    for i, j, x, d in zip(start.tolist(), stop.tolist(), best.tolist(), doc.tolist()):
        covered |= {k: (i, x, d) for k in range(i, j)}
    at, anchors = 0, hashing.windows(h, 8).tolist()
    for d, n in enumerate(sizes.tolist()):
        last = None
        for k in range(at, at + n - 19):
            least = min(anchors[k : k + 13])
            place = anchors.index(least, k)
            run, x, owner = covered.pop(k)
            assert x == least and owner == d and (run == last[0] if last and last[1] == place else run == k)
            last = (run, place)
        at += n
    assert not covered


def brute_substrings(rows, window):
    key = lambda i: (i is not None, i or 0)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, (key(i), k)), (key(i), k))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (key(i), k) for j in range(k, k + window)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [2, 1000])
def test_substrings(spark, monkeypatch, crowded):
    monkeypatch.setattr(hashing, "CHUNK_HASHES", 100)
    monkeypatch.setattr(substring, "CROWDED", crowded)
    monkeypatch.setattr(substring, "SHARD", 20)
    rng = random.Random(crowded)
    rows = family(rng, 120, 60) + [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(90)))) for i in range(20)] + [(2000, "r " * 100)]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == brute_substrings(rows, 20)


def test_substrings_messy(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    out = dedup_substrings(messy, names=("a", "b", "c"))
    assert out.columns == [*messy.columns, "a", "b", "c"]
    got = out.collect()
    expected = brute_substrings(rows, 20)
    assert sorted(((r["doc_id"], r["a"], r["b"], r["c"]) for r in got), key=str) == expected and any(x[2] for x in expected)
    before = defaultdict(set)
    for i, t in rows:
        before[i].add(t)
    for r in got:
        assert r["text"] in before[r["doc_id"]] if not r["b"] else r["text"] == r["c"]
    assert dedup_substrings(nothing).count() == 0
