"""URL filter: ratio of two variable-order Markov models over characters.

One model is trained on accepted URLs and one on rejected ones (Witten-Bell
smoothing; contexts seen fewer than ``min_context`` times are dropped, so the
order varies with the evidence).  A URL's score is the difference of the two
log-likelihoods divided by its length; the threshold is calibrated on held-out
labelled URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sample
from .charlm import CharModels

ORDER = 6
SCHEMA = "page_id long, url string, score double"

#: Words that a host is made of which label its URLs as rejected.
REJECTED_WORDS = ("casino", "pills", "adult", "bets", "spam", "track")
#: Shares of signs and of capitals in a page's text from which on it is junk.
SIGNS, CAPITALS = 0.03, 0.3


def weak_label(url: Column, words: tuple[str, ...] = REJECTED_WORDS) -> Column:
    """'rejected' where one of the host's words (runs of letters between dots,
    hyphens and digits) is listed, else 'accepted'; null for null."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    listed = rf"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)"
    return F.when(url.isNull(), F.lit(None)).when(host.rlike(listed), "rejected").otherwise("accepted")


def junk(html: Column) -> Column:
    """Whether a page's text is mostly noise: many signs, or written in capitals."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-zA-Z#0-9]{1,8};", " ")
    size = F.greatest(F.length(text), F.lit(1))
    return F.coalesce((F.regexp_count(text, F.lit(r"[#$%&*!+<=>|~^]")) / size > SIGNS) | (F.regexp_count(text, F.lit(r"\p{Lu}")) / size > CAPITALS), F.lit(False))


def page_label(pages: DataFrame, words: tuple[str, ...] = REJECTED_WORDS) -> DataFrame:
    """(url, label): rejected by the host's words or by the page's own text."""
    return pages.select("url", F.when(F.col("url").isNotNull() & junk(F.col("html").cast("string")), "rejected").otherwise(weak_label(F.col("url").cast("string"), words)).alias("label"))


def normalise(url: str | None) -> str:
    """Lower case without scheme; digits as 0."""
    u = (url or "").strip().lower().translate(_DIGITS)
    return u.partition("://")[2] or u


_DIGITS = str.maketrans("123456789", "000000000")


@dataclass
class UrlModel:
    models: CharModels  # classes: accepted, rejected
    threshold: float

    def score(self, urls: list[str | None]) -> np.ndarray:
        """Nats a character in favour of 'accepted'; nan for null and empty."""
        total, n = self.models.score([normalise(u) for u in urls])
        return np.where(n > 0, (total[:, 0] - total[:, 1]) / np.maximum(n, 1), np.nan)


def fit(labelled: DataFrame, per_label: int = 4000, held_out: float = 0.3, order: int = ORDER, min_context: int = 2, keep_share: float = 0.999) -> UrlModel | None:
    """Trains on at most ``per_label`` rows of (url, label) for each label.

    The threshold is the score with the fewest held-out errors (rejected URLs at
    or above it, accepted ones below it), among those that keep at least
    ``keep_share`` of the accepted; of equals the one in the middle.  None
    unless both labels occur.
    """
    # equal URLs fall on one side of the split: the sample is taken by the URL itself
    rows = sample.per_label(labelled.select("url", "label").where("length(trim(url)) > 0"), "label", "url", per_label, distinct=True)
    by = {k: [r["url"] for r in rows if r["label"] == k] for k in ("accepted", "rejected")}
    if not all(by.values()):
        return None
    cut = {k: max(1, round(len(v) * (1 - held_out))) for k, v in by.items()}
    models = CharModels.train({k: [normalise(u) for u in v[: cut[k]]] for k, v in by.items()}, order, "wb", min_context)
    m = UrlModel(models, 0.0)
    good, bad = (m.score(by[k][cut[k] :] or by[k]) for k in by)
    top = np.sort(good)[int((1 - keep_share) * len(good))]
    tries = np.unique(np.concatenate([good, bad, [top]]))
    tries = np.concatenate([(tries[1:] + tries[:-1]) / 2, [top]])
    tries = tries[tries <= top]
    errors = np.searchsorted(np.sort(good), tries) + len(bad) - np.searchsorted(np.sort(bad), tries)
    ties = np.sort(tries[errors == errors.min()])
    m.threshold = float(ties[len(ties) // 2])
    return m


def filter_urls(pages: DataFrame, model: UrlModel | None) -> DataFrame:
    """(page_id, url, score) of the pages whose URL the models accept.

    A null or empty URL is dropped; without a model (one label missing) every
    other URL stays with score null.  Repeated rows and null ids stay as they
    are, equal URLs get equal scores, a score at the threshold is accepted; a
    very long URL is scored whole, part by part; an empty table gives no row;
    other columns, whatever their names, are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            urls = batch["url"].to_pylist()
            if m is None:
                score, keep = np.full(len(urls), np.nan), np.array([bool((u or "").strip()) for u in urls], bool)
            else:
                score = m.score(urls)
                keep = score >= m.threshold
            out = pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(score, mask=np.isnan(score))], ["page_id", "url", "score"])
            yield out.filter(pa.array(keep))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, SCHEMA)
