"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id, which fixes the order in which its
source gives documents away.  Tokens are summed by source and by the leading
bits of the hash; a running sum over that small histogram shows in which bucket
each budget ends.  Only that bucket is split by the next bits, until all 60 are
used, so the threshold is exact and no document is ever sorted.  A smaller
budget ends at a smaller hash: the selections of several budgets are nested.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

HASH_BITS = 60
END = 1 << HASH_BITS


def token_count(text: Column) -> Column:
    """Runs of characters other than space, tab, CR and LF; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, salt: str = "mix") -> Column:
    """60 bits of md5(salt:doc_id); a null id hashes like an empty one."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def thresholds(docs: DataFrame, weights: Mapping[str | None, int] | None = None, default_weight: int = 1, percents: tuple[int, ...] = (25, 50, 100), bits: tuple[int, ...] = (15, 15, 15, 15), salt: str = "mix") -> DataFrame:
    """(source, percent, budget, threshold) for every source and budget.

    ``weights`` are whole numbers, ``default_weight`` holds for sources not
    listed.  The unit is the largest T such that every source of weight w > 0
    with any token has at least T * w tokens; the budget of a source is
    T * w * percent / 100, rounded down.  Documents with a hash below the
    threshold fit the budget; documents of one hash (repeated rows) go together.
    ``bits``: the widths of the histograms, 60 together; a histogram has at most
    2^width rows for a source and budget, however many documents there are.
    A table without rows, or without a source that has tokens and a positive
    weight, gives no rows; a very long text is one document of many tokens.
    """
    if sum(bits) != HASH_BITS:
        raise ValueError("bits must sum to 60")
    compact = store.write(docs.select(F.col("source").cast("string").alias("s"), doc_hash(F.col("doc_id"), salt).alias("h"), token_count(F.col("text")).alias("n")), "mix")
    weight = F.lit(default_weight)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("s").eqNullSafe(F.lit(name)), F.lit(int(w))).otherwise(weight)
    shift = HASH_BITS - bits[0]
    top = store.write(compact.groupBy("s", F.shiftright("h", shift).alias("b")).agg(F.sum("n").alias("n")), "mix-histogram")
    totals = top.groupBy("s").agg(F.sum("n").alias("have")).withColumn("w", weight.cast("long")).where("w > 0 and have > 0")
    unit = totals.agg(F.min(F.expr("have div w")).alias("unit"))
    tiers = docs.sparkSession.createDataFrame([(p,) for p in sorted(set(percents))], "percent int")
    budgets = totals.crossJoin(F.broadcast(unit)).crossJoin(F.broadcast(tiers)).select("s", "percent", F.expr("unit * w * percent div 100").alias("budget"))
    state = store.write(budgets.withColumns({"used": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long"), "open": F.lit(True)}), "mix-state")
    level = top
    order = Window.partitionBy("s", "percent").orderBy("b")
    for width, following in zip(bits, (*bits[1:], 0), strict=True):
        open_ = store.broadcast_if_small(state.where("open").select(F.col("s").alias("s_"), "percent", "budget", "used", "prefix"), 64)
        here = F.shiftright("b", width) == F.col("prefix")
        cum = level.join(open_, F.col("s").eqNullSafe(F.col("s_")) & here).withColumn("cum", F.col("used") + F.sum("n").over(order))
        over = cum.where("cum > budget").groupBy("s", "percent").agg(F.min_by(F.struct("b", (F.col("cum") - F.col("n")).alias("used")), "b").alias("at"))
        over = over.select(F.col("s").alias("s_"), F.col("percent").alias("percent_"), "at")
        joined = state.join(over, F.col("s").eqNullSafe(F.col("s_")) & (F.col("percent") == F.col("percent_")), "left")
        state = store.write(
            joined.select("s", "percent", "budget", F.coalesce("at.used", "used").alias("used"), F.coalesce("at.b", "prefix").alias("prefix"), (F.col("open") & F.col("at").isNotNull()).alias("open")), "mix-state"
        )
        if following:  # the boundary buckets alone are split by the next bits
            wanted = store.broadcast_if_small(state.where("open").select(F.col("s").alias("s_"), F.col("prefix").alias("p_")).distinct(), 32)
            inside = compact.join(wanted, F.col("s").eqNullSafe(F.col("s_")) & (F.shiftright("h", shift) == F.col("p_")), "left_semi")
            shift -= following
            level = inside.groupBy("s", F.shiftright("h", shift).alias("b")).agg(F.sum("n").alias("n"))
    return state.select(F.col("s").alias("source"), "percent", "budget", F.when(F.col("open"), F.col("prefix")).otherwise(F.lit(END)).alias("threshold"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, source, percent) of the documents in the mixture; ``percent`` is
    the smallest budget that holds the document.

    A null source is a source of its own; null and empty texts have no tokens
    and follow their hash; a source without tokens or with weight 0 gives
    nothing; an empty table gives an empty result; repeated rows share a hash and
    go together; a document longer than its source's budget is left out, with all
    that follow it; other columns are ignored.
    """
    cut = _named(thresholds(docs, **parameters))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), doc_hash(F.col("doc_id"), parameters.get("salt", "mix")).alias("h"))
    fit = rows.join(cut, F.col("source").eqNullSafe(F.col("s_")))
    return fit.select("doc_id", "source", F.expr("get(filter(cuts, c -> h < c.threshold), 0).percent").alias("percent")).where("percent is not null")


def select(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that the largest budget holds, columns unchanged.

    Null sources, null and empty texts, sources without tokens, repeated rows and
    empty tables are as in ``mix``; columns of any other name are kept as they are.
    """
    cut = _named(thresholds(docs, **parameters)).select("s_", F.expr("cuts[size(cuts) - 1].threshold").alias("t_"))
    on = F.col("d.source").cast("string").eqNullSafe(F.col("c.s_")) & (doc_hash(F.col("d.doc_id"), parameters.get("salt", "mix")) < F.col("c.t_"))
    return docs.alias("d").join(cut.alias("c"), on, "left_semi")


def _named(cut: DataFrame) -> DataFrame:
    per_source = cut.groupBy(F.col("source").alias("s_")).agg(F.sort_array(F.collect_list(F.struct("percent", "threshold"))).alias("cuts"))
    return store.broadcast_if_small(store.write(per_source, "mix-cuts"), 128)
