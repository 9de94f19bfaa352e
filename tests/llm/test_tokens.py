"""BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keystrata.llm import bpe, dac, packing
from keystrata.llm.bpe_op import encode_decode
from keystrata.llm.common import shared_path
from keystrata.llm.tokens import StretchEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  a  b\n\n c \n", "foo  <|endoftext|>bar <|endoftext|>", "\xa0x  y\t\tz  ", "don't we'll I'd'", "a" * 5000 + " " + "ab" * 300, "日本語 テスト ñ É é \x1c x\x1d\x1ey <|startoftext|>", " \n \n", "\x00a \x00b\x00", "İstanbul ΣΑΣ", "12 345²", "x  　 y", "́c a \x85b"]


@pytest.fixture(scope="module")
def libraries():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(BYTE), StretchEncoder(BYTE, "byte"), StretchEncoder(WORD, "word")


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\ta'sxE<|>endoftext\x00\x85", max_size=60), st.sampled_from(ODD)))
def test_same_ids_as_the_library(libraries, own, text):
    codec, by_byte, by_word = own
    byte, word = libraries[BYTE], libraries[WORD]
    expected = byte.encode(text, add_special_tokens=False).ids
    [mine] = codec.encode_batch([text])
    assert ids(mine) == expected
    assert codec.decode(mine).decode("utf-8", "replace") == byte.decode(expected, skip_special_tokens=False)
    assert ids(by_byte.encode_batch([text])[0]) == expected
    assert ids(by_word.encode_batch([text])[0]) == word.encode(text, add_special_tokens=False).ids


def test_pair_test_agrees_with_merging(own):
    codec, rng = own[0], random.Random(3)
    sound = list(codec.sound.items())
    pairs = [(rng.choice(sound), rng.choice(sound)) for _ in range(3000)]
    # neighbours of real words as well
    text = [w.encode() for w in "the attention interesting unbelievable whatsoever reindex".split()]
    pairs += [((w[:k], codec.sound[w[:k]]), (w[k:], codec.sound[w[k:]])) for w in text for k in range(1, len(w)) if w[:k] in codec.sound and w[k:] in codec.sound]
    good = codec.compatible(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    assert good.any() and not good.all()
    for (a, b), ok in zip(pairs, good):
        assert ok == (codec.merge(a[0] + b[0]) == [a[1], b[1]])


def test_long_merging_is_short_merging(own):
    codec = own[0]
    for word in (b"a" * 500, b"ab" * 200, b"thequickbrown" * 20):
        whole = codec._merge_long([codec.byte_id[b] for b in word])
        assert b"".join(codec.bytes_of[i] for i in whole) == word
    for word in (b"interesting", b"aaaaaaa", b"reestablish"):
        assert codec._merge_long([codec.byte_id[b] for b in word]) == codec.merge(word)


def test_memory_bound_changes_nothing(monkeypatch, own):
    from keystrata.llm import stretches

    monkeypatch.setattr(stretches, "REMEMBERED", 3)
    fresh = StretchEncoder(BYTE, "byte")
    texts = ["a b c d e f", "c d x y a", "a a a"]
    assert fresh.encode_batch(texts) == own[1].encode_batch(texts) == [fresh.encode_batch([t])[0] for t in texts]
    assert len(fresh.known) <= 3


def test_encode_decode_rows(spark, messy, nothing, libraries):
    got = encode_decode(messy, BYTE, keep=True).collect()
    key = lambda r: (str(r["doc_id"]), r["decoded"])
    rows = sorted(messy.collect(), key=lambda r: (str(r["doc_id"]), r["text"] or ""))
    assert len(got) == len(rows)
    for a, b in zip(sorted(got, key=key), rows):
        expected = libraries[BYTE].encode(b["text"] or "", add_special_tokens=False).ids
        assert (a["doc_id"], a["ids"], a["n_tokens"], a["decoded"]) == (b["doc_id"], expected, len(expected), b["text"] or "")
        assert a["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert a["decoded_sha256"] == hashlib.sha256((b["text"] or "").encode()).hexdigest()
    assert encode_decode(nothing, BYTE).count() == 0


@pytest.mark.parametrize("top", [1, 200, 70_000, 2**32])
def test_direct_access(top):
    rng = np.random.default_rng(top)
    lengths = rng.integers(0, 900, 9)
    values = rng.integers(0, top, lengths.sum(), dtype=np.uint64).astype(np.uint32)
    f = dac.TokenFile(dac.pack_tokens(np.arange(9), lengths, values))
    assert (f.all() == values).all() and f.doc_ids.tolist() == list(range(9))
    assert [f.token(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    assert f.document(3).tolist() == values[lengths[:3].sum() : lengths[:4].sum()].tolist()


def test_access_decodes_only_what_is_asked(monkeypatch):
    rng = np.random.default_rng(8)
    lengths = rng.integers(0, 2000, 40)
    values = rng.integers(0, 60_000, lengths.sum()).astype(np.uint32)
    f = dac.TokenFile(dac.pack_tokens(np.arange(40), lengths, values))
    ends = np.cumsum(lengths)
    seen = []
    unpack = np.unpackbits
    monkeypatch.setattr(np, "unpackbits", lambda bits, **kw: seen.append(len(bits)) or unpack(bits, **kw))
    for k in range(40):
        seen.clear()
        assert f.document(k).tolist() == values[ends[k] - lengths[k] : ends[k]].tolist()
        assert sum(seen) <= 2 * (lengths[k] / 8 + 2) * len(f.levels)
    for i, j in rng.integers(0, len(values), (50, 2)):
        i, j = sorted((int(i), int(j)))
        assert f.span(i, j).tolist() == values[i:j].tolist()


def test_merging_side_by_side_is_merging(own):
    codec, rng = own[0], random.Random(12)
    words = ["".join(rng.choice("abeinoqrst") for _ in range(rng.randrange(0, 14))).encode() for _ in range(3000)] + [b"a" * n for n in range(60)] + [b"ab" * n for n in range(40)] + ["ñandú".encode(), b"", b"zzzzz"]
    ids_, counts = codec.merge_many(words)
    ends = np.cumsum(counts)
    for w, n, end in zip(words, counts.tolist(), ends.tolist()):
        assert ids_[end - n : end].tolist() == codec.merge(w)


def test_texts_keep_their_order(own, libraries):
    """Odd texts are cut another way than the others, and come back in their places."""
    texts = ["a b", "x  y", "", "plain text.", " lead", "trail ", "end<|endoftext|>", "Ünïcode, wörds!", "a\nb\n"]
    byte, word = libraries[BYTE], libraries[WORD]
    for e, library in ((own[0], byte), (own[1], byte), (own[2], word)):
        assert list(map(ids, e.encode_batch(texts))) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_token_file():
    f = dac.TokenFile(dac.pack_tokens(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)))
    assert len(f.all()) == 0
    with pytest.raises(ValueError):
        dac.TokenFile(b"something else" * 4)


def test_token_files(spark, messy, nothing, libraries, monkeypatch):
    monkeypatch.setattr(dac, "SLICE", 4)
    folder = shared_path(spark, "tokens")
    listing = dac.write_tokens(messy, folder, WORD, file_tokens=500)
    assert listing.count() > 3
    got = sorted(dac.read_tokens(listing, folder, keep_ids=True).collect(), key=lambda r: r["start"])
    assert len(got) == messy.count()
    at = 0
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    expected = defaultdict(list)
    for r in messy.collect():
        expected[r["doc_id"]].append(libraries[WORD].encode(r["text"] or "", add_special_tokens=False).ids + [1])
    for r in got:
        assert r["ids"] in expected[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        expected[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    assert dac.token_files(nothing, WORD).count() == 0


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, free in enumerate(bins) if free >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_is_best_fit():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([10, 32, 100])
        lengths = [min(capacity, 1 + int(rng.expovariate(1 / rng.choice([2, 10, 40])))) for _ in range(rng.randrange(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = defaultdict(list)
        for length, lo, hi, first, each, at in packing.plan_best_fit(counts, capacity):
            for r in range(lo, hi):
                used[first + (r - lo) // each].append((at + (r - lo) % each * length, length))
        assert sum(map(len, used.values())) == len(lengths)
        for places in used.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end += n
            assert end <= capacity
        assert len(used) == brute_best_fit(lengths, capacity)


def test_packing_rows(spark, messy, nothing, libraries):
    from keystrata.llm.common import written

    pieces = written(packing.pieces_of(messy, BYTE, capacity=64, keep_ids=True), "pieces")
    got = packing.place(pieces, 64, group=5).collect()
    bins, documents = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
        documents[r["doc_id"]].append((r["piece"], r["start"], ids(bytes(r["ids"]))))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 64
    lengths = [r["length"] for r in got]
    assert len(bins) == brute_best_fit(lengths, 64)
    for r in messy.where("doc_id > 100 AND doc_id < 130").collect():
        whole = libraries[BYTE].encode(r["text"], add_special_tokens=False).ids + [2]
        parts = sorted(documents[r["doc_id"]])
        assert [x for _, _, p in parts for x in p] == whole and [s for _, s, _ in parts] == list(np.cumsum([0] + [len(p) for _, _, p in parts])[:-1])
        assert all(len(p) == 64 for _, _, p in parts[1:])
    assert sum(lengths) == sum(len(libraries[BYTE].encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in messy.collect())
    assert packing.pack(nothing, BYTE).count() == 0
