"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is a parameter. A long text is cut at safe boundaries before it
reaches the library's regular expression, so that no call holds more than about
``CHUNK`` characters unless the text has no such boundary: then it is one match
of the pattern, which must be encoded as one piece. A boundary is safe before a
space, tab or line end that follows a non-space character, and between ASCII
letters and digits: no alternative of the split pattern runs across it, and its
only look-ahead sees the characters to its right, which stay the same. The ids
are decoded to raw bytes, which need not be valid UTF-8 piece by piece.

Null text counts as empty (no ids); every text is encoded whole. An id column
with nulls or repeated ids is carried through, row by row; extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released, slices

CHUNK = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_codecs: dict[tuple[str, str], object] = {}


def codec(ranks_path: str, pattern: str):
    """The encoding, built once in each Python process."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codecs[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _codecs[key]


def safe_pieces(text: str, chunk: int = CHUNK):
    """The text in pieces of ``chunk`` characters or somewhat more, cut at safe boundaries only."""
    at = 0
    while len(text) - at > chunk:
        m = _SAFE.search(text, at + chunk)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, ranks_path: str, pattern: str, chunk: int = CHUNK) -> np.ndarray:
    if not text:
        return np.zeros(0, "<u4")
    e = codec(ranks_path, pattern)
    parts = [np.asarray(e.encode_ordinary(x), "<u4") for x in safe_pieces(text, chunk)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, ranks_path: str, pattern: str) -> bytes:
    return codec(ranks_path, pattern).decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, keep_ids: bool = True) -> DataFrame:
    """Per document: id, n_tokens, ids (little-endian unsigned 32-bit, if ``keep_ids``), ids_sha256, decoded_sha256.

    Digests are taken over the ids and over the bytes decoded from them.
    """

    @released
    def run(batches):
        for b in (x for whole in batches for x in slices(whole, text_col)):
            ids, out = b.column(0), {"n": [], "ids": [], "ids_sha": [], "dec_sha": []}
            for text in b.column(1).to_pylist():
                x = encode(text, ranks_path, pattern, chunk)
                raw = x.tobytes()
                out["n"].append(len(x))
                out["ids"].append(raw if keep_ids else None)
                out["ids_sha"].append(hashlib.sha256(raw).hexdigest())
                out["dec_sha"].append(hashlib.sha256(decode(x, ranks_path, pattern)).hexdigest())
            cols = [ids, pa.array(out["n"], pa.int64()), *([pa.array(out["ids"], pa.binary())] if keep_ids else []), pa.array(out["ids_sha"], pa.string()), pa.array(out["dec_sha"], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
    schema = f"`{id_col}` {kind}, n_tokens long, {'ids binary, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
