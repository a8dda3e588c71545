"""Vectorised text primitives shared by the training-data operators.

Everything works on whole Arrow batches: a string column becomes one byte (or
code point) buffer with document offsets, and words, n-grams and hashes are
computed with array arithmetic instead of per-document Python loops.  Batches
are cut by bytes, so a worker's memory does not depend on the rows per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single document is one piece.
PIECE_BYTES = 500_000

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)

#: Word bytes: ASCII letters, digits and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _S)
    h = h * _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)]), dtype=np.uint64) for p in (_P, _PINV))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64."""
    size = 1 << 16
    while size < n:
        size <<= 1
    return _powers(size)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose text column holds about ``limit`` bytes each."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans(raw: np.ndarray, off: np.ndarray, keep: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``keep`` bytes that lie within one
    document, and the index of the first run of each document (n_docs + 1)."""
    w = keep[raw]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    inner = off[(off > 0) & (off < len(raw))]
    s[inner] = w[inner]
    e[inner - 1] = w[inner - 1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes (wherever it stands)."""
    p, inv = powers(len(raw))
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=h[1:])
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in text order, and each document's first word (n_docs + 1)."""
    if lower:
        texts = pc.utf8_lower(pc.fill_null(texts, ""))
    raw, off = buffers(texts)
    starts, ends, first = spans(raw, off)
    return hash_spans(raw, starts, ends), first


def hash_text(text: str) -> np.uint64:
    """The hash that ``words`` gives for a single word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]


def ngrams(tokens: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's n-grams and each document's first n-gram.

    A document of 1 to n-1 tokens has one gram, made of all of them; an empty
    one has none.
    """
    size = np.diff(first)
    out = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    gf = np.concatenate([[0], np.cumsum(out)])
    pad = np.concatenate([tokens, np.zeros(n, np.uint64)])
    pos = np.repeat(first[:-1] - gf[:-1], out) + np.arange(gf[-1])
    h = np.zeros(len(pos), np.uint64)
    last = np.repeat(first[1:], out)
    for j in range(n):
        t = pad[pos + j]
        t[pos + j >= last] = 0
        h = mix(h * _P + t + np.uint64(j + 1))
    return h, gf
