"""Encoding with the tokenizers library, a distinct stretch of text at a time."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .stretches import EXACT, Stretches, byte_stretch

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Stretches that go to the library as one text: with an added token between them, and plain ones, which need none.
JOINED, PLAIN = 256, 1024
#: Fixed values of the vocabularies' formats: the stand-in of a blank, and what ends a word.
BLANK, WORD_END = "Ġ", "</w>"
#: Signs that never join the letters before them; a run of them is a word of its own.
SIGNS = ".,;:!?$#*%&"


class StretchEncoder:
    """kind: "byte" for byte-level vocabularies, "word" for ones that drop white space."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = kind
        self.stretch = byte_stretch if kind == "byte" else str
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: The library cuts a text at added tokens before anything else, so one of them separates stretches exactly.
        self.mark = next(iter(added.items()), None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Tokens that begin with a blank, or end a word.
        self.edge = np.zeros(1 + max([0, *vocab.values(), *added.values()]), bool)
        self.edge[[i for t, i in vocab.items() if (t.startswith(BLANK) if kind == "byte" else t.endswith(WORD_END))]] = True
        self.stretches = Stretches(kind, list(added), self.encode_new)
        self.known = self.stretches.known

    def _encode_plain(self, keys: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of plain stretches, side by side in one text and told apart by self.edge; and the keys of texts where that fails.

        Byte level: a blank and a word; that blank is the only one of its stretch, and begins its first token. Words:
        letters; each stretch has one token at least that ends a word, so as many as stretches means one each.
        """
        out, rest = {}, []
        spans = [(i, min(i + PLAIN, len(keys))) for i in range(0, len(keys), PLAIN)]
        first = " " if self.kind == "byte" else ""
        for at in range(0, len(spans), 16):
            batch = spans[at : at + 16]
            for (i, j), e in zip(batch, self.tokenizer.encode_batch_fast([first + " ".join(keys[i:j]) for i, j in batch], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                edge = np.flatnonzero(self.edge[ids])
                if len(edge) != j - i:
                    rest += keys[i:j]
                    continue
                raw = ids.tobytes()
                edge = (4 * edge).tolist() if first else (4 * edge + 4).tolist()
                starts, ends = (edge, [*edge[1:], len(raw)]) if first else ([0, *edge[:-1]], edge)
                out.update(zip(keys[i:j], [raw[a:b] for a, b in zip(starts, ends)]))
        return out, rest

    def encode_new(self, keys: list[str]) -> dict[str, bytes]:
        if self.kind == "byte":
            plain, tails = [k for k in keys if k[:1] not in ("", "\n", EXACT)], {}
        else:
            tails = {k: (k[:n], k[n:]) for k in keys if not k.isalpha() and (n := len(k.rstrip(SIGNS))) < len(k) and k[:n].isalpha()}
            plain = list(dict.fromkeys([k for k in keys if k.isalpha()] + [root for root, _ in tails.values()]))
        out, rest = self._encode_plain(plain)
        done = set(plain)
        out |= self._encode_marked(list(dict.fromkeys(rest + [k for k in keys if k not in done and k not in tails] + [tail for _, tail in tails.values()])))
        return {k: out[tails[k][0]] + out[tails[k][1]] if k in tails else out[k] for k in keys} if tails else out

    def _encode_marked(self, keys: list[str]) -> dict[str, bytes]:
        texts, out = list(map(self.stretch, keys)), {}
        word, mark = self.mark or ("", -1)
        spans = [(i, min(i + JOINED, len(keys))) for i in range(0, len(keys), JOINED)]
        for at in range(0, len(spans), 64):
            batch = spans[at : at + 64]
            for (i, j), e in zip(batch, self.tokenizer.encode_batch_fast([word.join(texts[i:j]) for i, j in batch], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == mark)
                if len(cuts) != j - i - 1 or not word:  # a stretch has the mark itself
                    out.update((keys[k], np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()) for k in range(i, j))
                    continue
                raw = ids.tobytes()
                starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
                out.update(zip(keys[i:j], [raw[a:b] for a, b in zip(starts, ends)]))
        return out

    def encode_batch(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.stretches.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))


@lru_cache(maxsize=1)
def encoder(path: str, kind: str) -> StretchEncoder:
    return StretchEncoder(path, kind)
