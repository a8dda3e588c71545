"""Best-fit packing of documents into bins of fixed size: best-two-fit.

Documents are spread over shards by a hash of their id; each shard is packed on
its own by counts per length, so its work follows the number of bins, and the
shuffle carries (doc_id, tokens) only.  A bin is filled greedily with the
longest piece that still fits.  What is left is its gap: the bin's smallest
piece is then taken out if two unpacked pieces together fill the gap, widened
by that piece, more tightly.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .source_mix import token_count

SCHEMA = "bin_id long, slot int, doc_id long, piece int, piece_start long, n_tokens long"


class Pool:
    """Unpacked pieces by length: the distinct lengths in order, a stack for each."""

    def __init__(self, stacks: dict[int, list]):
        self.stacks = stacks
        self.lengths = sorted(n for n, s in stacks.items() if s)

    def fit(self, room: int) -> int:
        """Longest length of at most ``room``, or 0."""
        i = bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else 0

    def take(self, n: int):
        item = self.stacks[n].pop()
        if not self.stacks[n]:
            del self.lengths[bisect_right(self.lengths, n) - 1]
        return item

    def give(self, n: int, item) -> None:
        stack = self.stacks.setdefault(n, [])
        if not stack:
            self.lengths.insert(bisect_right(self.lengths, n), n)
        stack.append(item)

    def best_two(self, room: int, least: int) -> tuple[int, int] | None:
        """Lengths x <= y of two pieces with the largest sum in (least, room]."""
        lengths, best, pair = self.lengths, least, None
        i, j = 0, bisect_right(lengths, room) - 1
        while i <= j:
            x, y = lengths[i], lengths[j]
            if x + y > room:
                j -= 1
                continue
            if x + y > best and (i < j or len(self.stacks[x]) > 1):
                best, pair = x + y, (x, y)
                if best == room:
                    break
            i += 1
        return pair


def pack(pieces: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Bins of (length, item); pieces of one length are used in the order given."""
    stacks: dict[int, list] = {}
    for n, item in reversed(pieces):
        stacks.setdefault(n, []).append(item)
    pool, bins = Pool(stacks), []
    while pool.lengths:
        room, content = capacity, []
        while n := pool.fit(room):
            content.append((n, pool.take(n)))
            room -= n
        if room and len(content) > 1 and pool.lengths:
            least, item = content[-1]
            if two := pool.best_two(room + least, least):
                content.pop()
                content += [(n, pool.take(n)) for n in reversed(two)]
                pool.give(least, item)
        bins.append(content)
    return bins


def best_two_fit(docs: DataFrame, capacity: int = 2048, shard_docs: int = 50_000) -> DataFrame:
    """One row per packed piece: (bin_id, slot, doc_id, piece, piece_start, n_tokens).

    A document longer than ``capacity`` tokens becomes full pieces, each a bin
    of its own, and a rest that is packed like any document.  Null and empty
    texts have no tokens and are in no bin.  Repeated rows are packed once
    each; rows with a null id are packed too.  Equal lengths are taken by id.
    An empty table gives no bins; other columns are ignored.
    """
    # rows without an id are spread by their text
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    sized = store.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text")).alias("n"), h.alias("h")).where("n > 0"), "pack")
    shards = max(1, -(-sized.count() // shard_docs))

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n"], na_position="first", kind="stable")
        ids, sizes = rows["doc_id"].tolist(), rows["n"].to_numpy()
        ids = [None if pd.isna(x) else int(x) for x in ids]
        full, rest = sizes // capacity, sizes % capacity
        bins: list[list[tuple[int, tuple]]] = [[(capacity, (i, k))] for i in np.flatnonzero(full) for k in range(full[i])]
        bins += pack([(int(rest[i]), (i, int(full[i]))) for i in np.flatnonzero(rest)], capacity)
        base = int(key[0]) << 40
        flat = [(base + b, s, ids[i], k, k * capacity, n) for b, content in enumerate(bins) for s, (n, (i, k)) in enumerate(content)]
        out = pd.DataFrame(flat, columns=["bin_id", "slot", "doc_id", "piece", "piece_start", "n_tokens"])
        return out.astype({"doc_id": "Int64"})

    return sized.withColumn("shard", F.pmod("h", F.lit(shards))).select("shard", "doc_id", "n").groupBy("shard").applyInPandas(run, SCHEMA)


def gaps(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Bins, tokens and unused tokens, for judging a packing."""
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"))
    return bins.agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"), F.sum(capacity - F.col("n")).alias("unused"))


