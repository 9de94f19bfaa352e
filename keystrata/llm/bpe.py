"""Byte-level BPE encoding by speculation: propose tokens greedily, test every adjacent pair, merge exactly only where a test fails.

Why testing pairs is enough. Merges run in the order of their ranks, and a merge's rank is above
those of its two sides. So in a word, as long as no merge has crossed the border between two
proposed tokens, each token grows by itself, exactly as it does alone. The first crossing joins a
piece on the right spine of the left token's merge tree to a piece on the left spine of the right
token's, at a moment when both pieces exist. If no such joining exists for any adjacent pair, the
proposal is the encoding.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .stretches import Stretches, byte_stretch

#: The split pattern of this tokenizer family, as the tokenizer's format defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1) << 40
#: Words of more bytes are merged by a heap, one at a time.
LONG = 48


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A vocabulary with what proposing, testing and merging need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = as_bytes(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        sides: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.rule[x, y] = rank, made
            sides.setdefault(made, (x, y, rank))
        self._spines(sides, len(self.bytes_of))
        keys = np.array([x << 20 | y for x, y in self.rule], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.rule.values()], np.int64)[order]
        self.made = np.zeros(len(keys), np.int64)
        self.made[[r for r, _ in self.rule.values()]] = [m for _, m in self.rule.values()]
        self.byte_ids = np.array(self.byte_id, np.int64)
        #: Only tokens that come out of their own bytes may be proposed.
        own = sorted(vocab.values())
        flat, counts = self.merge_many([self.bytes_of[i] for i in own])
        first = flat[np.cumsum(counts) - counts]
        self.sound = {self.bytes_of[i]: i for i, n, x in zip(own, counts.tolist(), first.tolist()) if n == 1 and x == i}
        self._trie(self.sound)
        self.split = regex.compile(SPLIT)
        self.byte_table = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_counts = np.array(list(map(len, self.bytes_of)), np.int64)
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts
        self.stretches = Stretches("byte", list(self.special), self._encode_new)
        self.proposed = self.merged = 0

    def _spines(self, sides: dict, n: int) -> None:
        """For each token and depth: the piece on its left and right spine, and the rank at which that piece is absorbed."""
        piece: list[list[np.ndarray]] = [[], []]
        ends: list[list[np.ndarray]] = [[], []]
        down = [np.full(n, -1, np.int64), np.full(n, -1, np.int64)]
        absorbed = np.full(n, NEVER, np.int64)
        for made, (x, y, rank) in sides.items():
            down[0][made], down[1][made], absorbed[made] = x, y, rank
        for side in (0, 1):
            at, until = np.arange(n), np.full(n, NEVER, np.int64)
            while (at >= 0).any():
                piece[side].append(at)
                ends[side].append(until)
                at, until = np.where(at >= 0, down[side][at], -1), np.where(at >= 0, absorbed[at], NEVER)
        self.left, self.left_end = np.array(piece[0]), np.array(ends[0])
        self.right, self.right_end = np.array(piece[1]), np.array(ends[1])

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of least rank, the leftmost first."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        rule = self.rule
        while len(ids) > 1:
            found = [rule.get(p) for p in zip(ids, ids[1:])]
            best = min((f for f in found if f), default=None)
            if best is None:
                break
            out, i, last = [], 0, len(ids) - 1
            while i <= last:
                if i < last and found[i] == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rule = len(ids), self.rule
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rule.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = rule[x, y][1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := rule.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (r := rule.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (r[0], before[i], ids[before[i]], ids[i]))
        return [x for x, ok in zip(ids, alive) if ok]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words side by side: their ids, one word after another, and how many each has."""
        counts = np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for i in [i for i, w in enumerate(words) if len(w) > LONG]:
            ids = np.array(self.merge(words[i]), np.int64)
            done.append((np.full(len(ids), i), ids))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        x = self.byte_ids[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        owner = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short])
        while len(x):
            rank = self._ranks_of(x[:-1] << 20 | x[1:])
            rank[owner[1:] != owner[:-1]] = NEVER
            rank = np.append(rank, NEVER)
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(start, len(x)))
            least = np.repeat(np.minimum.reduceat(rank, start), size)
            if (still := least == NEVER).any():
                done.append((owner[still], x[still]))
                x, owner, rank, least = x[~still], owner[~still], rank[~still], least[~still]
            at = np.flatnonzero(rank == least)  # of places side by side, as in a run of one symbol, every other one, from the left
            if not len(at):
                break
            run = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            x[at] = self.made[rank[at]]
            keep = np.ones(len(x), bool)
            keep[at + 1] = False
            x, owner = x[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int64), counts
        owner, ids = (np.concatenate(c) for c in zip(*done))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _ranks_of(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def _trie(self, tokens: dict[bytes, int]) -> None:
        """Edges (node, byte) -> node in sorted order, and the token that each node is, or -1."""
        edges, token = {}, [-1]
        for word, i in tokens.items():
            node = 0
            for b in word:
                to = edges.setdefault(node << 8 | b, len(token))
                if to == len(token):
                    token.append(-1)
                node = to
            token[node] = i
        self.edges, self.node_token = np.array(sorted(edges), np.int64), np.array(token, np.int64)
        self.edge_to = np.array([edges[e] for e in self.edges.tolist()], np.int64)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest sound token at each place, for all words side by side: ids, and how many each word has."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        place = ends - np.fromiter(map(len, words), np.int64, len(words))
        owners, tokens = [], []
        live = np.flatnonzero(place < ends)
        while len(live):
            start, end = place[live], ends[live]
            best, size = self.byte_ids[raw[start]], np.ones(len(live), np.int64)
            node, on, depth = np.zeros(len(live), np.int64), np.arange(len(live)), 0
            while len(on):
                key = node << 8 | raw[start[on] + depth]
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                hit = self.edges[at] == key
                on, node = on[hit], self.edge_to[at[hit]]
                depth += 1
                found = self.node_token[node]
                some = found >= 0
                best[on[some]], size[on[some]] = found[some], depth
                more = start[on] + depth < end[on]
                on, node = on[more], node[more]
            owners.append(live)
            tokens.append(best)
            place[live] += size
            live = live[place[live] < ends[live]]
        if not owners:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner = np.concatenate(owners)
        return np.concatenate(tokens)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: does no merge cross their border?"""
        good = np.ones(len(a), bool)
        for p, p_end in zip(self.right, self.right_end):
            x = p[a]
            if not (x >= 0).any():
                break
            for q, q_end in zip(self.left, self.left_end):
                y = q[b]
                live = np.flatnonzero((x >= 0) & (y >= 0) & good)
                if not len(live):
                    if not (y >= 0).any():
                        break
                    continue
                rank = self._ranks_of(x[live] << 20 | y[live])
                # of equal ranks, the left place goes first: a left piece absorbed at that rank is gone, a right one isn't yet
                good[live[(rank < NEVER) & (rank < p_end[a[live]]) & (rank <= q_end[b[live]])]] = False
        return good

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        ids, counts = self.propose(words)
        self.proposed += len(words)
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if not len(inner):
            return ids, counts
        pairs, back = np.unique(ids[inner] << 20 | ids[inner + 1], return_inverse=True)
        bad = ~self.compatible(pairs >> 20, pairs & 0xFFFFF)[back]
        failing = np.unique(owner[inner[bad]])
        if not len(failing):
            return ids, counts
        self.merged += len(failing)
        merged, many = self.merge_many([words[k] for k in failing.tolist()])
        good = np.ones(len(words), bool)
        good[failing] = False
        stay = good[owner]
        owner = np.concatenate([owner[stay], np.repeat(failing, many)])
        return np.concatenate([ids[stay], merged])[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _encode_new(self, keys: list[str]) -> dict[str, bytes]:
        # a blank and letters are one word; the letters of the first blocks are the same in all versions of Unicode
        whole = [k for k in keys if k.isalpha() and (k.isascii() or max(k) < "\u0250")]
        alone = set(whole)
        split = {k: [self.special[k[1:]]] if k[1:] in self.special else self.split.findall(byte_stretch(k)) for k in keys if k not in alone}
        distinct = list(dict.fromkeys([" " + k for k in whole] + [w for ws in split.values() for w in ws if isinstance(w, str)]))
        ids, counts = self.encode_words([w.encode() for w in distinct])
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        coded: dict[str | int, bytes] = {w: raw[a:b] for w, a, b in zip(distinct, [0, *ends], ends)}
        out = {k: coded[" " + k] for k in whole}
        coded |= {i: i.to_bytes(4, "little") for i in self.special.values()}
        return out | {k: b"".join([coded[w] for w in ws]) for k, ws in split.items()}

    def encode_batch(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.stretches.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, gathered from one table."""
        i = np.frombuffer(ids, "<u4")
        n = self.byte_counts[i]
        ends = np.cumsum(n)
        return self.byte_table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.byte_starts[i] - ends + n, n)].tobytes()


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One per worker and vocabulary."""
    return Codec(path)
