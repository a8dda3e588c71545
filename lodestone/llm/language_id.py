"""Language identification by interpolated Kneser-Ney character models.

One model per language, all in shared sorted hash arrays (``charlm``).  A text
gets the language of lowest length-normalised cross-entropy.  It is rejected
when that cross-entropy is above what held-out texts of the language reach,
with a wider margin for short texts, whose mean is noisy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sample
from .charlm import CharModels, normalise
from .textkit import pieces

ORDER = 4
SCHEMA = "doc_id long, language string, cross_entropy double, accepted boolean"


@dataclass
class LanguageModel:
    models: CharModels
    limit: np.ndarray  # cross-entropy above which a long text is rejected, by language
    spread: np.ndarray  # added for a text of n characters: spread / sqrt(n)

    def identify(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class index (-1: no letter), cross-entropy in nats a character, accepted."""
        clean = [normalise(t) for t in texts]
        total, n = self.models.score(clean)
        entropy = -total / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1)
        value = entropy[np.arange(len(clean)), best]
        letters = np.fromiter((any(map(str.isalpha, t)) for t in clean), bool, len(clean))
        accepted = letters & (value <= self.limit[best] + self.spread[best] / np.sqrt(np.maximum(n, 1)))
        return np.where(letters, best, -1), np.where(n > 0, value, np.nan), accepted


def fit(docs: DataFrame, per_language: int = 300, held_out: float = 0.3, order: int = ORDER, quantile: float = 0.98, margin: float = 0.75) -> LanguageModel | None:
    """Trains on at most ``per_language`` labelled documents of each ``lang``.

    A share ``held_out`` of them calibrates the rejection.  The other languages'
    held-out texts stand for unknown ones: a language's limit lies halfway from
    its own mean to what 95 % of those exceed under its model (with a single
    language ``margin`` of the mean above it), or where all but 1 - ``quantile``
    of its own texts stay under, if that is higher; a text of n characters may
    exceed it by four standard errors.  So a text that holds a foreign passage
    stays, and one that is mostly foreign goes; from 20 held-out texts on, one with
    a wrong label sets no limit.
    None when no row has both a language and a text.
    """
    rows = sample.per_label(docs.select("doc_id", "lang", "text").where("length(trim(text)) > 0"), "lang", "doc_id", per_language)
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(normalise(r["text"]))
    by = {k: [t for t in v if t] for k, v in sorted(by.items())}
    by = {k: v for k, v in by.items() if v}
    if not by:
        return None
    cut = {k: max(1, round(len(v) * (1 - held_out))) for k, v in by.items()}
    models = CharModels.train({k: v[: cut[k]] for k, v in by.items()}, order)
    limit, spread = [], []
    held = {k: models.score(v[cut[k] :] or v) for k, v in by.items()}
    for i, k in enumerate(by):
        total, n = held[k]
        mean, long = -total[:, i].sum() / n.sum(), -total[:, i] / n
        b = 4 * max(0.5, float(np.sqrt(np.average((long - mean) ** 2 * n))))
        over = np.sort(long - mean - b / np.sqrt(n))
        excess = over[-1 - max(int((1 - quantile) * len(over)), int(len(over) >= 20))]
        others = [-t[:, i] / m for o, (t, m) in held.items() if o != k]
        far = np.quantile(np.concatenate(others), 0.05) if others else mean * (1 + 2 * margin)
        limit.append(mean + max(0.5 * (far - mean), excess, 0.0))
        spread.append(b)
    return LanguageModel(models, np.array(limit), np.array(spread))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, language, cross_entropy, accepted), one row per input row.

    A text without letters (null, empty, digits and signs only) has language
    null and is rejected, its cross-entropy null if nothing is left of it after
    trimming; ties go to the language first in order; without a model (nothing
    labelled) every row is rejected.  Repeated rows and null ids are kept, equal
    texts get equal results; very long texts are scored whole, part by part; an
    empty table gives no row; other columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                n = part.num_rows
                if m is None:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array([False] * n)], _NAMES)
                    continue
                best, value, ok = m.identify(part["text"].to_pylist())
                names = np.array([*m.models.classes, None], object)[best]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(names, pa.string()), pa.array(value, mask=np.isnan(value)), pa.array(ok)], _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


_NAMES = ["doc_id", "language", "cross_entropy", "accepted"]


def keep_identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``docs`` whose text is accepted, columns unchanged.

    What ``identify`` rejects goes: null and empty texts, those without letters,
    and everything without a model.  Rows that repeat stay or go together; null
    ids, other columns and their names do not matter; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(m.identify(part["text"].to_pylist())[2])) if m else part.slice(0, 0)

    return docs.mapInArrow(run, docs.schema)
