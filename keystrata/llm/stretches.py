"""Cut texts where no tokenization of a kind ever joins, so that distinct stretches are encoded once and remembered."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank or line feed that a visible character follows starts a new stretch for byte-level vocabularies.
CUT = re.compile(r"(?=[ \n]\S)")
#: Texts with runs of white space, or with the mark of exact keys, are cut by CUT; all others by a plain split.
ODD = r"[ \n][\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\x00"
EXACT = "\x00"
#: Bytes that a worker uses to remember stretches for good (the first ones that it meets, among which are the frequent ones), and what an entry takes besides its key and ids.
REMEMBERED, ENTRY = 64 << 20, 180
#: Bytes of text that are encoded together.
PORTION = 4 << 20


def byte_stretch(key: str) -> str:
    """Keys: a word after a blank, a line feed with the word after it, or an exact stretch behind EXACT."""
    return key[1:] if key[:1] == EXACT else key if key[:1] == "\n" else " " + key


class Stretches:
    """Encodes texts through the ids of their distinct stretches, those met first being remembered.

    kind: "byte" for byte-level vocabularies; "word" for ones of lower-case words without white space, for which any
    white space is a border, and plain ASCII is lower-cased at once. added: strings with ids of their own.
    encode_new: from a list of new keys to their ids, as little-endian unsigned 32-bit integers.
    """

    def __init__(self, kind: str, added: list[str], encode_new: Callable[[list[str]], dict[str, bytes]]):
        self.kind, self.added, self.encode_new = kind, set(added), encode_new
        either = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        self.added_at = re.compile(f"({either})") if added else None
        self.odd = f"{ODD}|{either}" if added else ODD
        self.known: dict[str, bytes] = {}
        self.room = REMEMBERED

    def _odd_keys(self, text: str) -> list[str]:
        # white space before an added token ends a stretch of its own, so borders hold between added tokens only
        parts = self.added_at.split(text) if self.added_at else [text]
        return [EXACT + s for part in parts if part for s in ([part] if part in self.added else CUT.split(part))]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Keys of all texts, one text after another in another order; how many each has; the texts' numbers in that order."""
        order = np.arange(len(texts))
        if self.kind == "word":
            plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
            lists = pc.split_pattern(pc.replace_substring(pc.if_else(plain, pc.ascii_lower(texts), texts), "\n", " "), " ")
            return lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False), order
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        simple = pc.binary_join_element_wise(EXACT, texts.filter(pa.array(~odd)), "")
        lists = pc.split_pattern(pc.replace_substring(simple, "\n", " \n"), " ")
        keys, many = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        if odd.any():
            more = [self._odd_keys(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            keys = pa.concat_arrays([keys, pa.array([k for ks in more for k in ks], pa.string())])
            many, order = np.concatenate([many, np.array(list(map(len, more)), many.dtype)]), np.concatenate([order[~odd], order[odd]])
        return keys, many, order

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; a null is an empty one."""
        keys, many, order = self._cut(pc.fill_null(texts, "").cast(pa.string()))
        coded = keys.dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        known = self.known
        if new := [k for k in distinct if k not in known]:
            known.update(made := self.encode_new(new))
        raws = [known[k] for k in distinct]
        if new:
            for k, v in made.items():
                size = len(k) + len(v) + ENTRY
                if self.room < size:
                    del known[k]
                else:
                    self.room -= size
        flat = np.frombuffer(b"".join(raws), "<u4")
        size = np.fromiter(map(len, raws), np.int64, len(raws)) >> 2
        first, n = (np.cumsum(size) - size)[at], size[at]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)].tobytes()
        edge = 4 * np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)])]
        out: list[bytes] = [b""] * len(texts)
        for i, a, b in zip(order.tolist(), edge[:-1].tolist(), edge[1:].tolist()):
            out[i] = ids[a:b]
        return out


def portions(batch: pa.RecordBatch, column: int, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PORTION bytes of text in a column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, used = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (used + n > PORTION or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, used = i, 0
        used += n
    if len(sizes) > at:
        yield batch.slice(at)
