"""Byte-level BPE by a monoid tree reduction.

A text is halved until leaves are short; leaves are encoded, and neighbours are joined upwards. A join looks
for the nearest place on either side of the seam where white space follows other text: no match of the pattern spans such a place
and no match depends on what lies before it, so tokens outside are final. The window grows until both places are
found, and only the window is encoded again. Decoding concatenates bytes up the same tree.

Defined cases: a null text is empty and has no ids; a null doc_id is passed on; rows may repeat; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

LEAF, WINDOW = 4096, 32
SEAM = re.compile(r"(?<=\S)[ \t\n\r\x0b\x0c]")
_encoders: dict[tuple[str, str], object] = {}


def encoder(ranks_path: str, pattern: str):
    """The encoder of the leaves, made once per worker."""
    if (ranks_path, pattern) not in _encoders:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[ranks_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path, pattern]


def join(enc, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
    """Ids of left + right from the ids of each."""
    if not left or not right:
        return a + b
    width, cut = WINDOW, None
    while cut is None and width < 2 * len(left):
        found = [m.start() for m in SEAM.finditer(left, max(1, len(left) - width))]
        cut, width = (found[-1] if found else None), width * 4
    cut, width, end = cut or 0, WINDOW, None
    while end is None and width < 2 * len(right):
        m = SEAM.search(right, 1, min(len(right), width))
        end, width = (m.start() if m else None), width * 4
    end = len(right) if end is None else end
    before, after = enc.encode_ordinary(left[cut:]), enc.encode_ordinary(right[:end])
    return a[:len(a) - len(before)] + enc.encode_ordinary(left[cut:] + right[:end]) + b[len(after):]


def encode(enc, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of a text, from those of its halves."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    half = len(text) // 2
    return join(enc, text[:half], encode(enc, text[:half], leaf), text[half:], encode(enc, text[half:], leaf))


def decode(enc, ids: list[int], leaf: int = LEAF) -> bytes:
    """Bytes of ids, from those of their halves."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    half = len(ids) // 2
    return decode(enc, ids[:half], leaf) + decode(enc, ids[half:], leaf)


def _run(ranks_path: str, pattern: str, digests: bool):
    def run(batches):
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                ids = [encode(enc, x or "") for x in rows.column(1).to_pylist()]
                if digests:
                    raw = [np.array(x, "<u4").tobytes() for x in ids]
                    out = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([hashlib.sha256(decode(enc, x)).hexdigest() for x in ids], pa.string())]
                    yield pa.RecordBatch.from_arrays([rows.column(0), *out], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(enc, x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])
    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(ranks_path, pattern, False), "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the same ids and bytes, digested where they are made."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(ranks_path, pattern, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of whole documents, as digests."""
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op8_tree_bpe": op8_tree_bpe}
ORACLE: dict[str, str] = {}
