"""Character n-gram models of several classes in shared sorted hash arrays.

For every order the n-grams seen in any class stand once, as a sorted array of
64-bit hashes, beside one row of log-probabilities per class; contexts stand the
same way beside their back-off weights.  Scoring a batch is array lookups: the
longest known n-gram that ends at each character gives all classes at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textkit import mix

PAD = " "
#: Characters that are scored at once.
LONG = 500_000
_B = np.uint64(0x9E3779B97F4A7C15)


class HashArray:
    """A sorted array of 64-bit keys with an index of leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - self.bits)
        heads = (keys >> self.shift).astype(np.int64)
        self.start = np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.padded = np.concatenate([keys, keys[-1:] if len(keys) else np.zeros(1, np.uint64)])

    def find(self, query: np.ndarray) -> np.ndarray:
        """Positions of the queries in ``keys``, -1 where absent."""
        at = self.start[(query >> self.shift).astype(np.int64)]
        if not len(self.keys):
            return np.full(len(query), -1, np.int32)
        got = self.padded[at]
        todo = np.flatnonzero(got < query)
        while len(todo):
            at[todo] += 1
            ended = at[todo] >= len(self.keys)
            todo = todo[~ended & (self.padded[np.minimum(at[todo], len(self.keys))] < query[todo])]
        at[self.padded[np.minimum(at, len(self.keys))] != query] = -1
        at[at >= len(self.keys)] = -1
        return at


def codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after order-1 pads; starts and ends of the texts."""
    pad = PAD * max(1, order - 1)
    cp = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(size + len(pad))
    return cp, ends - size, ends


def normalise(text: str | None) -> str:
    """Lower case, white space as single blanks, digits as 0."""
    return " ".join((text or "").lower().translate(_DIGITS).split())


_DIGITS = str.maketrans("123456789", "000000000")


def rolling(cp: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0..order the hash of the n characters that end at each position."""
    out, power, c = [np.zeros(len(cp), np.uint64)], np.uint64(1), cp.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(cp), np.uint64)
    for n in range(1, order + 1):
        h = h.copy()
        h[n - 1 :] += c[: len(c) - n + 1] * power
        out.append(h)
        with np.errstate(over="ignore"):
            power = power * _B
    return [mix(x + np.uint64(n)) for n, x in enumerate(out)]


@dataclass
class Level:
    grams: HashArray
    logp: np.ndarray  # grams x classes
    contexts: HashArray
    gamma: np.ndarray  # contexts x classes, log back-off weight


class CharModels:
    """Interpolated models of one order for several classes.

    ``smoothing`` is "kn" (Kneser-Ney: continuation counts below the highest
    order, one discount per order) or "wb" (Witten-Bell).  Contexts seen fewer
    than ``min_context`` times in a class are not kept, so the order varies:
    the prediction comes from the longest context that is kept.
    """

    def __init__(self, order: int, classes: list[str], levels: list[Level], floor: np.ndarray):
        self.order, self.classes, self.levels, self.floor = order, classes, levels, floor

    @classmethod
    def train(cls, texts: dict[str, list[str]], order: int, smoothing: str = "kn", min_context: int = 1) -> CharModels:
        classes, L = list(texts), len(texts)
        seen, alphabet = [], set()
        for name in classes:  # of each class and order the n-grams, their contexts, suffixes and counts
            cp, starts, ends = codes(texts[name], order)
            alphabet |= set(np.unique(cp).tolist())
            inside = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)] or [np.zeros(0, np.int64)])
            h, own = rolling(cp, order), []
            for n in range(1, order + 1):
                gram, first, c = np.unique(h[n][inside], return_index=True, return_counts=True)
                where = inside[first]
                own.append((gram, h[n - 1][where - 1] if n > 1 else h[0][where], h[n - 1][where], c))
            seen.append(own)
        uniform = -np.log(len(alphabet) + 1)
        floor, levels = np.full(L, uniform), []
        for n in range(1, order + 1):
            keys = np.unique(np.concatenate([own[n - 1][0] for own in seen]))
            grams = HashArray(keys)
            context = np.zeros(len(keys), np.uint64)
            suffix = np.zeros(len(keys), np.uint64)
            count = np.zeros((len(keys), L))
            for k, own in enumerate(seen):
                gram, before, after, c = own[n - 1]
                at = grams.find(gram)
                context[at], suffix[at] = before, after
                if smoothing == "kn" and n < order and len(gram):
                    c = np.bincount(grams.find(own[n][2]), minlength=len(keys))[at]
                count[at, k] = c
            ctx, inverse = np.unique(context, return_inverse=True)
            total = np.stack([np.bincount(inverse, count[:, k], len(ctx)) for k in range(L)], 1)
            kinds = np.stack([np.bincount(inverse, count[:, k] > 0, len(ctx)) for k in range(L)], 1)
            if n > 1:
                total[total < min_context] = 0
            known = total > 0
            if smoothing == "kn":
                n1, n2 = (count == 1).sum(0), (count == 2).sum(0)
                discount = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.95)
                gamma = np.where(known, discount * kinds / np.maximum(total, 1), 1.0)
                top = np.maximum(count - discount, 0) / np.maximum(total[inverse], 1)
            else:
                gamma = np.where(known, kinds / np.maximum(total + kinds, 1), 1.0)
                top = count / np.maximum((total + kinds)[inverse], 1)
            lower = np.exp(levels[-1].logp[levels[-1].grams.find(suffix)]) if n > 1 else np.exp(floor)[None, :]
            p = np.where(known[inverse], top, 0) + gamma[inverse] * lower
            if n > 1:  # an n-gram whose context no class keeps is not kept either
                keep = known[inverse].any(1)
                grams, p = HashArray(keys[keep]), p[keep]
                ctx, gamma = ctx[known.any(1)], gamma[known.any(1)]
                if not keep.any():
                    return cls(n - 1, classes, levels, floor)
            levels.append(Level(grams, np.log(p).astype(np.float32), HashArray(ctx), np.log(gamma).astype(np.float32)))
        return cls(order, classes, levels, floor)

    def positions(self, cp: np.ndarray) -> np.ndarray:
        """Log-probability of every character under each class (positions x classes)."""
        h = rolling(cp, self.order)
        out = np.zeros((len(cp), len(self.classes)), np.float32)
        todo = np.arange(len(cp))
        for n in range(self.order, 0, -1):
            level = self.levels[n - 1]
            key = h[n] if len(todo) == len(cp) else h[n][todo]
            at = level.grams.find(key)
            hit = at >= 0
            if hit.all():
                out[todo] += level.logp[at]
                return out
            out[todo[hit]] += level.logp[at[hit]]
            todo = todo[~hit]
            before = h[n - 1][np.maximum(todo - 1, 0)] if n > 1 else h[0][todo]
            ctx = level.contexts.find(before)
            known = ctx >= 0
            out[todo[known]] += level.gamma[ctx[known]]
        out[todo] += self.floor.astype(np.float32)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probability of each text under each class, and its characters.

        A text longer than ``LONG`` is scored in parts that each see the
        characters before them; log-probabilities add up, so memory is bounded.
        """
        total, size = np.zeros((len(texts), len(self.classes))), np.fromiter((len(t) for t in texts), np.int64, len(texts))
        short = np.flatnonzero(size <= LONG)
        if len(short):
            cp, starts, ends = codes([texts[i] for i in short], self.order)
            sums = np.zeros((len(cp) + 1, len(self.classes)))
            np.cumsum(self.positions(cp), axis=0, dtype=np.float64, out=sums[1:])
            total[short] = sums[ends] - sums[starts]
        before = self.order - 1
        for i in np.flatnonzero(size > LONG):
            text = PAD * before + texts[i]
            for at in range(before, len(text), LONG):
                cp = np.frombuffer(text[at - before : at + LONG].encode("utf-32-le", "surrogatepass"), np.uint32)
                total[i] += self.positions(cp)[before:].sum(0, dtype=np.float64)
        return total, size
