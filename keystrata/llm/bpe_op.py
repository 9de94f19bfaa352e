"""BPE encoding and decoding of a text column (see bpe.py for the method)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy, whole_text
from .stretches import portions


def encode_decode(docs: DataFrame, tokenizer: str, keep: bool = True) -> DataFrame:
    """Encode every text and decode its ids again: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids (array<int>) and decoded.

    A null or empty text has no tokens. Rows are independent: repeated rows give repeated results, a
    null doc_id is passed through, other columns are ignored; no rows give no rows. A very long text is encoded whole, by
    itself. An added token's string in a text gets its id, as the tokenizers library does.
    """

    def run(batches):
        from .bpe import codec

        c = codec(tokenizer)
        for batch in batches:
            for part in portions(batch, 1):
                coded = c.encode_batch(part.column(1))
                plain = [c.decode(x).decode("utf-8", "replace") for x in coded]
                cols = [part.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    import numpy as np

                    cols += [pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32())), pa.array(plain, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(run), schema)
