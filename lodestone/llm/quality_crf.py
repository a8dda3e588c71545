"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Its features are binary: bins of simple
shape measures of the line itself and of the line before and after it.
Documents are labelled, lines are not: a bad document's lines count as bad
unless a model of single lines finds them good, and documents spliced from good
and bad ones teach the chain where labels change.  Forward-backward marginals,
weighted by line length, give the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sample, store
from .textkit import buffers, hash_spans, pieces, spans

SCHEMA = "doc_id long, quality double, lines long, good_lines long, accepted boolean"

_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False
_TOKEN = np.ones(256, bool)
_TOKEN[[9, 10, 13, 32]] = False
_UPPER, _LOWER, _DIGIT, _SIGN, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SIGN[[*b"#$%&*+<=>@[\\]^_`{|}~!"]] = True
_STOP[[*b".!?:;\"')"]] = True

#: Upper edges of the bins of each measure; a measure with e edges has e + 1 bins.
EDGES: dict[str, tuple[float, ...]] = {
    "length": (15, 40, 120, 400),
    "upper": (0.02, 0.08, 0.2, 0.5),
    "digits": (0.01, 0.05, 0.2),
    "signs": (0.005, 0.02, 0.06, 0.12),
    "word_length": (3.0, 4.5, 6.0, 8.0, 12.0),
    "repeats": (0.05, 0.2, 0.5),
    "new_words": (0.2, 0.5, 0.8),
    "stop": (0.5,),
    "seen": (0.5,),
}
_SIZES = [len(e) + 1 for e in EDGES.values()]
_BASE = np.concatenate([[0], np.cumsum(_SIZES)])[:-1]
WIDTH = int(sum(_SIZES))
#: Own bins, bins of the line before and after, no line before or after, bias.
FEATURES = 3 * WIDTH + 3


@dataclass
class Lines:
    first: np.ndarray  # first line of each document (n_docs + 1)
    length: np.ndarray  # bytes of each line
    active: np.ndarray  # lines x columns: indices of the binary features that are on


def lines_of(texts: pa.Array) -> Lines:
    """Lines (runs of bytes other than LF that hold a token) and their features."""
    raw, off = buffers(texts)
    starts, ends, _ = spans(raw, off, _NEWLINE)
    w0, w1, _ = spans(raw, off, _TOKEN)
    line = np.searchsorted(starts, w0, "right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(np.int64)
    full = np.flatnonzero(words > 0)  # blank lines are no lines
    renumber = np.cumsum(words > 0) - 1
    line, starts, ends, words = renumber[line], starts[full], ends[full], words[full]
    first = np.searchsorted(starts, off)
    n = len(starts)
    if not n:
        return Lines(first, np.zeros(0, np.int64), np.zeros((0, 3 * len(EDGES) + 1), np.int64))
    length = ends - starts

    def share(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag[raw], dtype=np.int32)])
        return (c[ends] - c[starts]) / length

    h = hash_spans(raw, w0, w1)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (line[1:] == line[:-1])])
    repeats = np.bincount(line[again], minlength=n) / np.maximum(words - 1, 1)
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=n) / words
    last = np.bincount(line, w1 - w0, n) / words
    whole, doc = hash_spans(raw, starts, ends), np.searchsorted(off, starts, "right")
    by = np.lexsort((np.arange(n), whole, doc))
    seen = np.zeros(n, bool)
    seen[by[1:]] = (whole[by][1:] == whole[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    tail = w1[np.cumsum(words) - 1] - 1
    measures = [length, share(_UPPER), share(_DIGIT), share(_SIGN), last, repeats, np.where(words >= 8, distinct, 1.0), _STOP[raw[tail]], seen]
    own = np.stack([np.searchsorted(e, np.asarray(m, float), "right") + b for m, e, b in zip(measures, EDGES.values(), _BASE, strict=True)], 1)
    head = np.zeros(n, bool)
    head[first[:-1][first[:-1] < first[1:]]] = True
    foot = np.zeros(n, bool)
    foot[first[1:][first[:-1] < first[1:]] - 1] = True
    before = np.where(head[:, None], 3 * WIDTH, np.roll(own, 1, 0) + WIDTH)
    after = np.where(foot[:, None], 3 * WIDTH + 1, np.roll(own, -1, 0) + 2 * WIDTH)
    return Lines(first, length, np.concatenate([own, before, after, np.full((n, 1), 3 * WIDTH + 2)], 1))


def chain(scores: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once.

    scores: lines x 2 (bad, good); move: 2 x 2.  Returns the marginals of the
    labels, the summed marginals of neighbouring label pairs, and the
    log-partition of each document.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], first[:-1][order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), "left")  # documents with more than t lines
    n = len(scores)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(steps):
        at = start[: live[t]] + t
        forward[at] = scores[at] if t == 0 else scores[at] + np.logaddexp(forward[at - 1][:, :1] + move[0], forward[at - 1][:, 1:] + move[1])
    for t in range(steps - 2, -1, -1):
        at = start[: live[t + 1]] + t
        v = backward[at + 1] + scores[at + 1]
        backward[at] = np.logaddexp(move[:, 0] + v[:, :1], move[:, 1] + v[:, 1:])
    z = np.zeros(len(first) - 1)
    some = np.diff(first) > 0
    ends = first[1:][some] - 1
    z[some] = np.logaddexp(forward[ends, 0], forward[ends, 1])
    per_line = np.repeat(z, np.diff(first))
    marginal = np.exp(forward + backward - per_line[:, None])
    inner = np.ones(n, bool)
    inner[first[:-1][some]] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + move[None] + (scores[at] + backward[at])[:, None, :] - per_line[at][:, None, None]
    return marginal, np.exp(pair).sum(0), z


@dataclass
class QualityModel:
    weights: np.ndarray  # FEATURES x 2
    move: np.ndarray  # 2 x 2
    threshold: float

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quality (nan without lines), number of lines, number more likely good."""
        x = lines_of(texts)
        good = chain(self.weights[x.active].sum(1), x.first, self.move)[0][:, 1] if len(x.length) else np.zeros(0)

        def per_doc(v: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(v)])
            return c[x.first[1:]] - c[x.first[:-1]]

        size = per_doc(x.length)
        return np.where(size > 0, per_doc(x.length * good) / np.maximum(size, 1), np.nan), np.diff(x.first), per_doc(good > 0.5)


def train(texts: list[str], labels: list, steps: int = 150, l2: float = 1e-3, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam on the whole (bounded) sample.

    ``labels``: for each text one label, or one for each of its lines.
    ``alone``: every line is a chain of its own, without its neighbours' features.
    """
    x = lines_of(pa.array(texts, pa.string()))
    y = np.concatenate([np.broadcast_to(np.asarray(v, np.int64), n) for v, n in zip(labels, np.diff(x.first), strict=True)])
    if alone:
        x = Lines(np.arange(len(y) + 1), x.length, x.active[:, [*range(len(EDGES)), -1]])
    n = len(y)
    truth = np.zeros((n, 2))
    truth[np.arange(n), y] = 1
    inner = np.ones(n, bool)
    inner[x.first[:-1][x.first[:-1] < n]] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    w, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(move)]
    v = [np.zeros_like(w), np.zeros_like(move)]
    for t in range(1, steps + 1):
        marginal, pair, _ = chain(w[x.active].sum(1), x.first, move)
        diff, gw = truth - marginal, np.zeros_like(w)
        for k in range(2):
            gw[:, k] = np.bincount(x.active.ravel(), np.repeat(diff[:, k], x.active.shape[1]), FEATURES)
        grads = [gw / n - l2 * w, (pairs - pair) / n - l2 * move]
        for i, (p, g) in enumerate(zip((w, move), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return w, move


def line_texts(text: str) -> list[str]:
    """The lines that ``lines_of`` numbers."""
    return [x for x in text.split("\n") if x.strip("\t\r ")]


def line_labels(bad: list[str], good: list[str], sure: float = 0.8) -> list[np.ndarray]:
    """For each bad document which of its lines are good: those of which a model
    of single lines, fitted on the documents' labels, is sure.  At least one line
    of a bad document, the least good one, is bad."""
    w, _ = train(bad + good, [0] * len(bad) + [1] * len(good), alone=True)
    x = lines_of(pa.array(bad, pa.string()))
    own = w[x.active[:, [*range(len(EDGES)), -1]]].sum(1)
    p = 1 / (1 + np.exp(own[:, 0] - own[:, 1]))
    out = []
    for a, b in zip(x.first[:-1], x.first[1:], strict=True):
        y = (p[a:b] >= sure).astype(np.int64)
        if b > a:
            y[int(p[a:b].argmin())] = 0
        out.append(y)
    return out


def splice(bad: list[str], marks: list[np.ndarray], good: list[str], seed: int = 1) -> tuple[list[str], list[np.ndarray]]:
    """Documents made of a run of lines of a good one and of a bad one, and their
    lines' labels: each good document once, bad ones in turn, in either order or
    one within the other."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for k, g in enumerate(good if bad else ()):
        inner, y = line_texts(bad[k % len(bad)]), marks[k % len(bad)]
        outer = line_texts(g)
        if not inner or not outer:
            continue
        a = int(rng.integers(0, len(inner)))
        b = int(rng.integers(a + 1, len(inner) + 1))
        at = int(rng.integers(0, len(outer) + 1))
        texts.append("\n".join([*outer[:at], *inner[a:b], *outer[at:]]))
        labels.append(np.concatenate([np.ones(at, np.int64), y[a:b], np.ones(len(outer) - at, np.int64)]))
    return texts, labels


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 400, held_out: float = 0.3, keep_share: float = 0.99) -> QualityModel | None:
    """Trains on at most ``per_label`` labelled documents of each quality.

    The threshold is calibrated on the held-out share: the quality with the
    fewest errors among those that keep at least ``keep_share`` of the good
    documents.  In the range of equals it lies a quarter up, since dropping a
    good document is the worse error.  From 20 held-out good documents on, one with
    a wrong label sets no threshold.  None unless both labels occur.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # the sample is drawn from the narrow labels of documents with a text; only its texts are fetched
    there = docs.where("length(trim(text)) > 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    marks = store.write(marks.withColumn("doc_id", F.col("doc_id").cast("long")).join(there, "doc_id", "left_semi"), "quality-labels")
    chosen = sample.per_label(marks, "quality", "doc_id", per_label)
    if len({r["quality"] for r in chosen}) < 2:
        return None
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"], i) for i, r in enumerate(chosen)], "doc_id long, quality int, rank int")
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").where("length(trim(text)) > 0").dropDuplicates(["doc_id"]).collect()
    rows = sorted(got, key=lambda r: r["rank"])
    by = {k: [r["text"] for r in rows if r["quality"] == k] for k in (0, 1)}
    if not all(by.values()):
        return None
    cut = {k: max(1, round(len(t) * (1 - held_out))) for k, t in by.items()}
    bad, good = by[0][: cut[0]], by[1][: cut[1]]
    of_bad = line_labels(bad, good)
    mixed, of_mixed = splice(bad, of_bad, good)
    w, move = train(bad + good + mixed, [*of_bad, *[1] * len(good), *of_mixed])
    model = QualityModel(w, move, 0.0)
    bad, good = (q[~np.isnan(q)] for q in (model.score(pa.array(by[k][cut[k] :] or by[k], pa.string()))[0] for k in (0, 1)))
    top = np.sort(good)[max(int((1 - keep_share) * len(good)), int(len(good) >= 20))]
    tries = np.unique(np.concatenate([[0.02], bad, good]))
    tries = np.concatenate([(tries[1:] + tries[:-1]) / 2, [top]])
    tries = tries[tries <= top]
    errors = np.searchsorted(np.sort(good), tries) + len(bad) - np.searchsorted(np.sort(bad), tries)
    ties = tries[errors == errors.min()]
    model.threshold = float(ties.min() + 0.25 * (ties.max() - ties.min()))
    return model


_NAMES = ["doc_id", "quality", "lines", "good_lines", "accepted"]


def classify(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, quality, lines, good_lines, accepted), one row per input row.

    A text without a token (null, empty, white space) has quality null and is
    rejected; without a model (a label is missing) quality is null and every
    other document is accepted.  Repeated rows get equal results; a quality at
    the threshold is accepted, a line as likely good as bad is not good; very
    long texts are labelled whole; an empty table gives no row; null ids and
    other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                q, lines, good, ok = judge(m, part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(q, mask=np.isnan(q)), pa.array(lines.astype(np.int64)), pa.array(good.astype(np.int64)), pa.array(ok)], _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def judge(model: QualityModel | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quality, lines, good lines and the decision for each text."""
    if model is None:
        lines = np.diff(lines_of(texts).first)
        return np.full(len(texts), np.nan), lines, np.zeros(len(texts), np.int64), lines > 0
    q, lines, good = model.score(texts)
    return q, lines, good, np.nan_to_num(q, nan=-1.0) >= model.threshold


def keep_good(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, columns unchanged.

    Null and empty texts go; rows that repeat stay or go together; null ids and
    other columns, whatever their names, do not matter; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(judge(m, part["text"])[3]))

    return docs.mapInArrow(run, docs.schema)
