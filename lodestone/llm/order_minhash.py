"""Order MinHash fingerprints, sensitive to edit distance.

A document's word k-mers are numbered by occurrence, so that equal k-mers stay
apart.  For each of ``signatures`` hash functions the ``tuple_size`` k-mers of
lowest hash are selected, put back into text order, and hashed as a tuple.
Texts that share content in another order share few tuples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import mix, ngrams, pieces, words

K, TUPLE, SIGNATURES = 3, 3, 24
SCHEMA = "doc_id long, kmers long, fingerprint array<long>"
_SEEDS = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def occurrences(kmers: np.ndarray) -> np.ndarray:
    """For each k-mer, how many equal ones stand before it."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    out = np.empty(len(s), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(head, at, 0))
    return out


def fingerprint(kmers: np.ndarray, tuple_size: int = TUPLE, signatures: int = SIGNATURES) -> np.ndarray:
    """The signature of one text's k-mers, given in text order."""
    numbered = mix(kmers + occurrences(kmers).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(signatures, np.uint64)
    if len(kmers) <= tuple_size:  # every k-mer is selected by every function
        chosen = np.broadcast_to(np.arange(len(kmers)), (signatures, len(kmers)))
    else:
        # the hash's high bits order the k-mers, the position in the low bits names them
        step = max(1, 2_000_000 // len(kmers))
        bits = np.uint64(int(len(kmers)).bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        at = np.arange(len(kmers), dtype=np.uint64)
        parts = []
        for j in range(0, signatures, step):
            h = numbered[None, :] * _SEEDS[j : min(j + step, signatures), None]
            h &= ~low
            h |= at
            h.partition(tuple_size - 1, axis=1)
            parts.append((h[:, :tuple_size] & low).astype(np.int64))
        chosen = np.sort(np.concatenate(parts), axis=1)
    for c in range(chosen.shape[1]):
        out = mix(out * np.uint64(31) + kmers[chosen[:, c]])
    return mix(out + np.arange(signatures, dtype=np.uint64))


def order_minhash(docs: DataFrame, k: int = K, tuple_size: int = TUPLE, signatures: int = SIGNATURES) -> DataFrame:
    """(doc_id, kmers, fingerprint), one row per input row.

    The share of equal positions in two fingerprints estimates their order-
    sensitive similarity.  A text of 1 to k-1 words is a single k-mer; fewer
    k-mers than ``tuple_size`` are all taken; a text without words (null,
    empty, signs only) has 0 k-mers and an empty fingerprint.  Equal texts and
    repeated rows have equal fingerprints.  Ties between hashes go to the
    earlier position.  Very long texts are fingerprinted whole; an empty table
    gives no row; null ids are kept and other columns, whatever their names, ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w, first = words(part["text"])
                g, gf = ngrams(w, first, k)
                prints = [fingerprint(g[a:b], tuple_size, signatures) if b > a else np.zeros(0, np.uint64) for a, b in zip(gf[:-1], gf[1:], strict=True)]
                size = np.diff(gf)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(size > 0, signatures, 0))]).astype(np.int32), np.concatenate(prints).view(np.int64))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(size.astype(np.int64)), lists], ["doc_id", "kmers", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
