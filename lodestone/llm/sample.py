"""Bounded samples of labelled rows, for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def per_label(rows: DataFrame, label: str, key: str, limit: int, distinct: bool = False) -> list:
    """At most ``limit`` rows of each label, the lowest by a hash of ``key``.

    Labels are counted first; the hash bound follows from the counts, so only
    about ``limit`` rows per label leave the executors, whatever the table's
    size.  ``distinct`` takes equal rows once, after the hash has thinned them;
    where repeats leave a label short, its bound is raised until it has
    ``limit`` rows or all.  Rows with a null label are not labelled.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    h = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(_RANGE))
    want = limit + 4 * limit**0.5
    share = {k: min(1.0, want / n) for k, n in counts.items()}
    found: dict = {}
    while share:
        bound = F.lit(0)
        for value, x in share.items():
            bound = F.when(F.col(label) == F.lit(value), F.lit(int(x * _RANGE))).otherwise(bound)
        chosen = rows.withColumn("__h", h).where(F.col("__h") < bound)
        found |= {k: [] for k in share}
        for r in (chosen.distinct() if distinct else chosen).collect():
            found[r[label]].append(r)
        short = {k: x for k, x in share.items() if distinct and x < 1 and len(found[k]) < limit}
        # by what the last share gave, 16-fold at most while that is too little to tell
        share = {k: min(1.0, x * min(16.0, 1.2 * want / max(len(found[k]), 1))) for k, x in short.items()}
    out: list = []
    taken: dict = {}
    for r in sorted((r for drawn in found.values() for r in drawn), key=lambda r: (r["__h"], str(r[key]))):
        taken[r[label]] = taken.get(r[label], 0) + 1
        if taken[r[label]] <= limit:
            out.append(r)
    return out
