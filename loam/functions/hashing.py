"""Content hashes, SimHash and hashed embeddings."""
from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def token_weight(token: Column) -> Column:
    """60 bits of a token that every engine computes alike: the first 15 digits of its md5."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 15), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


ASCII_TOKEN, LONG_TOKEN, CJK_RUN = re.compile("[a-z0-9]+"), re.compile("[a-z0-9]{2,}"), re.compile("[\u4e00-\u9fff]+")
#: Token occurrences that are worked on at once.
AT_ONCE = 100_000


def plain_tokens(value: str | None) -> list[str]:
    return ASCII_TOKEN.findall((value or "").lower())


def python_hash_tokens(value: str | None) -> list[str]:
    """The tokens of text.hash_tokens, for use inside a task."""
    low = (value or "").lower()
    out = LONG_TOKEN.findall(low)
    for run in () if low.isascii() else CJK_RUN.findall(low):
        out += [run] if len(run) == 1 else [run[i:i + 2] for i in range(len(run) - 1)]
    return out


@functools.lru_cache(1 << 17)
def _blake64(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")


def _hashed(texts: pd.Series, tokens) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of bounded size: first and end row, the hash of each distinct token, and of each occurrence the token's number and its row within the run."""
    lo, held, size = 0, [], 0
    every = texts.tolist()
    for i, value in enumerate(every):
        held.append(tokens(value))
        size += len(held[-1])
        if size >= AT_ONCE or i + 1 == len(every):
            codes, names = pd.factorize(np.array([t for row in held for t in row], object))
            h = np.fromiter(map(_blake64, names), np.uint64, len(names))
            yield lo, i + 1, h, codes, np.repeat(np.arange(len(held)), [len(row) for row in held])
            lo, held, size = i + 1, [], 0


@F.pandas_udf(LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """64-bit SimHash over BLAKE2b of each token occurrence, as a signed integer; 0 without tokens."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi, h, codes, rows in _hashed(texts, plain_tokens):
        if len(codes):
            # a byte a bit, eight of them in a word: words are added for 255 occurrences at most, so no byte overflows
            bits = np.unpackbits(h.astype("<u8")[:, None].view(np.uint8), axis=1, bitorder="little").view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            size = np.diff(np.append(first, len(rows)))
            runs = -(-size // 255)
            of = np.cumsum(runs) - runs
            starts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(of, runs))
            ones = np.add.reduceat(np.add.reduceat(bits[codes], starts).view(np.uint8), of, dtype=np.int64)
            out[lo + rows[first]] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return pd.Series(out.view(np.int64))


def hashed_vectors(texts: pd.Series, dim: int) -> np.ndarray:
    """Signed token counts in dim places, by BLAKE2b, at unit length; zeros without tokens. For use inside a task."""
    out: list[np.ndarray] = [np.zeros((0, dim), np.float32)]
    for lo, hi, h, codes, rows in _hashed(texts, python_hash_tokens):
        n = hi - lo
        sign = np.where(h & np.uint64(1), 1.0, -1.0)
        v = np.bincount(rows * dim + (h % np.uint64(dim)).astype(np.int64)[codes], sign[codes], minlength=n * dim).reshape(n, dim) if len(codes) else np.zeros((n, dim))
        out.append((v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)).astype(np.float32))
    return np.concatenate(out)


def hash_embedding(c: Column, dim: int = 512) -> Column:
    """The vectors of hashed_vectors."""
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_vectors(texts, dim)))
    return embed(c)
