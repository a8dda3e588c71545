"""Exact top-k search with BM25 by block-at-a-time pruning.

Documents are indexed for the words that any query holds: ranges of documents
form blocks, and each block keeps a forward index (per document its words and
their counts).  A query orders a shard's blocks by the sum of its words' block
maxima, scores blocks through their forward index in that order, and stops when
the next bound is below its k-th score.  A share of the blocks is searched first:
the k-th score there bounds every query's k-th score from below, so shards give
little more than the documents that can still be among the k best.  Impacts are
whole numbers (2^-16), so sums, bounds and ties are exact and do not depend on
any order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .charlm import HashArray
from .textkit import pieces, words

K, K1, B, BLOCK, SCALE = 10, 0.9, 0.4, 32, 65536
#: Queries handled by one pass over the index; more queries take more passes.
QUERY_CHUNK = 20_000
#: Postings of one shard, the blocks that a worker holds at once; one in so many
#: blocks is searched first.
SHARD_POSTINGS, SAMPLE = 4_000_000, 16

_INDEX = "ids array<long>, lengths array<int>, first array<int>, terms array<int>, counts array<int>"


class Queries:
    """A chunk of queries as sorted vocabulary and term lists."""

    def __init__(self, rows: list):
        texts = pa.array([r["text"] for r in rows], pa.string())
        w, first = words(texts)
        by: dict[int, list[np.ndarray]] = {}
        for r, a, b in zip(rows, first[:-1], first[1:], strict=True):
            by.setdefault(r["item_id"], []).append(w[a:b])
        self.ids = sorted(by)
        self.vocabulary = HashArray(np.unique(w))
        self.terms = [np.sort(self.vocabulary.find(np.unique(np.concatenate(by[i])))) for i in self.ids]


def _index(docs: DataFrame, shared, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        V = max(1, len(vocabulary.keys))
        for batch in batches:
            for part in pieces(batch, "text"):
                w, first = words(part["text"])
                n, length = part.num_rows, np.diff(first)
                term = vocabulary.find(w)
                hit = term >= 0
                key, count = np.unique(np.repeat(np.arange(n), length)[hit] * V + term[hit], return_counts=True)
                doc, term = key // V, (key % V).astype(np.int32)
                start = np.searchsorted(doc, np.arange(n + 1))
                ids, rows = part["doc_id"].to_numpy(), []
                for a in range(0, n, block):
                    b = min(n, a + block)
                    s, e = start[a], start[b]
                    rows.append((ids[a:b], length[a:b], start[a : b + 1] - s, term[s:e], count[s:e]))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.list_(t)) for c, t in enumerate(kinds)], ["ids", "lengths", "first", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, _INDEX)


def _flat(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _statistics(index: DataFrame) -> tuple[dict[int, int], int, int]:
    """Documents per term, documents, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, df = np.unique(_flat(batch["terms"]), return_counts=True)
            lengths = _flat(batch["lengths"])
            yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *term], pa.int64()), pa.array([len(lengths), lengths.sum(), *df], pa.int64())], ["term", "n"])

    # one row per word of the queries, so the driver holds what it already held
    df = {r[0]: r[1] for r in index.select("terms", "lengths").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    return df, df.pop(-2, 0), df.pop(-1, 0)


def impacts(tf: np.ndarray, length: np.ndarray, df: np.ndarray, n: int, average: float) -> np.ndarray:
    """Whole-numbered BM25 parts."""
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    return np.floor(idf * (tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / average))) * SCALE).astype(np.int64)


class Maxima:
    """A shard's block maxima, by term: which blocks hold it, with what highest impact."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]], terms: int):
        """``blocks``: for each block its terms and their highest impacts."""
        term = np.concatenate([t for t, _ in blocks])
        order = np.argsort(term, kind="stable")
        self.block = np.repeat(np.arange(len(blocks)), [len(t) for t, _ in blocks])[order]
        self.highest = np.concatenate([m for _, m in blocks])[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))
        self.blocks = len(blocks)

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each block the sum of the terms' maxima."""
        at = np.concatenate([np.arange(self.start[t], self.start[t + 1]) for t in terms] or [np.zeros(0, np.int64)])
        return np.bincount(self.block[at], self.highest[at], self.blocks).astype(np.int64)


def top(terms: np.ndarray, maxima: Maxima, forward: list[tuple[np.ndarray, ...]], wanted: np.ndarray, k: int, least: int = 1) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of one shard for one query; blocks that were scored.

    ``forward``: per block the ids, and the document, term and impact of each
    posting; ``wanted``: a flag for each term, all off, lent for the call;
    ``least``: lower scores are not among the k best of all shards.
    """
    bound = maxima.bounds(terms)
    order = np.argsort(-bound, kind="stable")
    wanted[terms] = True
    score, ids, kth, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), max(1, least), 0
    for b in order:
        if bound[b] < kth:
            break
        seen += 1
        own, doc, term, impact = forward[b]
        hit = wanted[term]
        total = np.bincount(doc[hit], impact[hit], len(own)).astype(np.int64)
        good = total >= kth
        if good.any():
            score, ids = np.concatenate([score, total[good]]), np.concatenate([ids, own[good]])
            if len(ids) >= k:
                best = np.lexsort((ids, -score))[:k]
                score, ids = score[best], ids[best]
                kth = max(kth, int(score[-1]))
    wanted[terms] = False
    best = np.lexsort((ids, -score))[:k]
    return list(zip(score[best].tolist(), ids[best].tolist(), strict=True)), seen


def search(docs: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_chunk: int = QUERY_CHUNK, shard_postings: int = SHARD_POSTINGS, sample: int = SAMPLE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score for every query.

    Every row of ``queries`` (item_id, text) with an id is a query; rows that
    repeat an id are one query of all their words, each word counted once.  A
    null or empty query, or one without a word in any document, has no result;
    documents that hold none of a query's words are no result.  Documents
    without id or text are not searched; empty ones count in the average
    length.  Equal scores are ranked by id; a repeated row takes a rank each
    time.  Very long texts are searched whole; without documents or queries (an
    empty table) there is no result; other columns are ignored.  What leaves the
    shards is about k * ``sample`` rows for each query, however many shards there are.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    chunks = max(1, -(-asked.count() // query_chunk))
    parts = [_search_chunk(spark, docs, Queries(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).collect()), k, block, shard_postings, sample) for c in range(chunks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("points"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", (F.col("points") / F.lit(float(SCALE))).alias("score"))


def _search_chunk(spark, docs: DataFrame, queries: Queries, k: int, block: int, shard_postings: int, sample: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(queries)
    index = store.write(_index(docs, shared, block), "search-index")
    counts, n, total = _statistics(index)
    df = np.zeros(max(1, len(queries.vocabulary.keys)), np.int64)
    for t, c in counts.items():
        df[t] = c
    average = total / n if n and total else 1.0
    df_shared = spark.sparkContext.broadcast(df)
    # part of the blocks first, by the ids in them
    some = index.where(F.pmod(F.xxhash64("ids"), F.lit(sample)) == 0)
    best = F.slice(F.sort_array(F.collect_list("points"), asc=False), 1, k)
    found = _shards(some, shared, df_shared, n, average, k, shard_postings, None).groupBy("item_id").agg(best.alias("best"))
    least = {r[0]: r[1] for r in found.where(F.size("best") == k).select("item_id", F.element_at("best", k)).collect()}
    least_shared = spark.sparkContext.broadcast(np.array([least.get(i, 1) for i in queries.ids], np.int64))
    return _shards(index, shared, df_shared, n, average, k, shard_postings, least_shared)


def _shards(index: DataFrame, shared, df_shared, n: int, average: float, k: int, shard_postings: int, least_shared) -> DataFrame:
    """(item_id, doc_id, points): the k best of each task, no points below the least ones."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        """Blocks and their maxima, about ``shard_postings`` postings at once."""
        df = df_shared.value
        forward, maxima, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids, length, first, term, tf = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in range(5))
                doc = np.repeat(np.arange(len(ids)), np.diff(first))
                impact = impacts(tf.astype(np.int64), length.astype(np.int64)[doc], df[term], n, average)
                by = np.argsort(term, kind="stable")
                own, head = np.unique(term[by], return_index=True)
                maxima.append((own, np.maximum.reduceat(impact[by], head) if len(own) else impact))
                forward.append((ids, doc.astype(np.int32), term, impact))
                held += len(term)
                if held >= shard_postings:
                    yield forward, maxima
                    forward, maxima, held = [], [], 0
        if forward:
            yield forward, maxima

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, terms_ = shared.value, len(df_shared.value)
        least = least_shared.value.tolist() if least_shared else [1] * len(q.ids)
        best: list[list[tuple[int, int]]] = [[] for _ in q.ids]
        wanted = np.zeros(terms_, bool)
        for forward, maxima in shard(batches):
            highest = Maxima(maxima, terms_)
            for i, terms in enumerate(q.terms):
                got = top(terms, highest, forward, wanted, k, least[i])[0]
                if got:
                    best[i] = sorted([*best[i], *got], key=lambda r: (-r[0], r[1]))[:k]
                    if len(best[i]) == k:
                        least[i] = max(least[i], best[i][-1][0])
        rows = [(item, doc, points) for item, found in zip(q.ids, best, strict=True) for points, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "points"])

    return index.mapInArrow(run, "item_id long, doc_id long, points long")
