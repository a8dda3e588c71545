"""HTML extraction with wrappers inferred per host as union-free expressions.

A page is a stream of tags and texts.  Tandem repeats are folded into repeated
groups, so that pages of one layout with more or fewer items look alike.  Per
host the distinct folded streams are aligned one after another, the commonest
first: texts that differ become slots, parts that some page lacks become
optional, and what then repeats is folded again.  A text that only one page
has is a slot too.  The wrapper is a sequence of
tags, template texts, slots, optional parts and repeated groups, without any
alternatives.  Pages are then read through their host's wrapper: template texts
and slots outside the container that holds most of the host's text are dropped.
"""

from __future__ import annotations

import json
import re
from hashlib import blake2b
from collections.abc import Iterator
from html import unescape
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

SCHEMA = "page_id long, host string, fields int, text string"
_STREAMS = "host string, stream string, pages long, texts array<string>, sizes array<long>, seen array<long>"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S | re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Distinct tokens that a process numbers before it starts anew; a page that alone
#: has more is not folded.  (There are 1,048,576 characters to number them with.)
SYMBOLS = 400_000
#: Cells of an alignment whose steps are kept at once, and bytes of the bit rows of
#: a longest common subsequence; neither changes what is found.
CELLS, BIT_BYTES = 4_000_000, 32 << 20
#: Distinct streams of one part of a host, and parts that are merged at once.
PART_STREAMS, MERGED = 64, 16
#: Repeats are folded, the shortest first, so that inner repeats do not keep
#: outer ones apart.  Patterns find copies of up to 64 tokens, ``long_periods`` longer ones.
_TANDEMS = [re.compile(rf"(.{{{n}}})\1+", re.S) for n in range(1, 65)]
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
_TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "li", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "figure", "figcaption"}
_OUTSIDE = {"head", "title", "nav", "footer", "aside", "form", "button", "select", "menu", "iframe"}
TEXT = "#"
SEVERAL = -1


def host(url: Column) -> Column:
    """Lower-case host of a URL; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def tokens(html: str) -> tuple[list[str], list[str]]:
    """Tags ("name" or "name.class", "/name") and "#" for each text; and the texts.

    Comments, declarations and the contents of script, style, noscript and
    template are left out; blank text is none.
    """
    out: list[str] = []
    texts: list[str] = []
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text = " ".join(html[at : m.start()].split())
            if text:
                out.append(TEXT)
                texts.append(text)
        at = m.end()
        name = m[3]
        if name:
            name = name.lower()
            if m[2]:
                out.append("/" + name)
            else:
                c = _CLASS.search(m[4]) if m[4] else None
                out.append(f"{name}.{' '.join((c[1] or c[2] or c[3] or '').split())}" if c else name)
    text = " ".join(html[at:].split())
    if text:
        out.append(TEXT)
        texts.append(text)
    # neighbouring texts (parted by a comment only) are one
    if any(a == b == TEXT for a, b in zip(out, out[1:], strict=False)):
        merged: list[str] = []
        joined: list[str] = []
        rest = iter(texts)
        for t in out:
            if t == TEXT:
                if merged and merged[-1] == TEXT:
                    joined[-1] += " " + next(rest)
                    continue
                joined.append(next(rest))
            merged.append(t)
        return merged, joined
    return out, texts


def long_periods(s: str, least: int = 65) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Every length from ``least`` on of which the string has tandem repeats, the
    shortest first, and where these begin and end (leftmost, without overlap)."""
    if len(s) < 2 * least:
        return
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    for n in range(least, len(codes) // 2 + 1):
        same = codes[n:] == codes[:-n]
        if np.count_nonzero(same) < n:
            continue
        # runs of equal characters n apart: a run of n is a second copy
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        kept: list[tuple[int, int]] = []
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            x = max(x, kept[-1][1]) if kept else x
            if y - x >= n:
                kept.append((x, x + (y - x) // n * n + n))
        if kept:
            yield n, kept


class Alphabet:
    """One character for each token and each repeated group (a process's own numbering)."""

    def __init__(self):
        self.of: dict[object, str] = {}
        self.back: dict[str, object] = {}

    def char(self, key: object) -> str:
        if key not in self.of:
            c = chr(0x10000 + len(self.of))
            self.of[key], self.back[c] = c, key
        return self.of[key]

    def fold(self, s: str) -> str:
        """Tandem repeats as single characters, until none is left."""
        while True:
            n = 0
            while n < min(64, len(s) // 2):
                t = _TANDEMS[n].sub(lambda m: m[1] if len(m[1]) == 1 and isinstance(self.back[m[1]], tuple) else self.char((m[1],)), s)
                s, n = (s, n + 1) if t == s else (self.absorb(t), 0)
            found = next(long_periods(s), None)
            if not found:
                return s
            n, spans = found
            for x, y in reversed(spans):
                s = s[:x] + self.char((s[x : x + n],)) + s[y:]
            s = self.absorb(s)

    def copy(self, c: str) -> str:
        """Expression of a character: a group also stands for one copy of its body."""
        key = self.back[c]
        return f"(?:{c}|{self.copies(key[0])})" if isinstance(key, tuple) else c

    def copies(self, body: str) -> str:
        return "".join(map(self.copy, body))

    def absorb(self, s: str) -> str:
        """Single copies of a group's body beside the group become part of it,
        also those whose inner groups have one copy only."""
        for c in dict.fromkeys(s):
            if isinstance(self.back[c], tuple):
                one = f"(?:{self.copies(self.back[c][0])})"
                s = re.sub(f"{one}*{c}(?:{c}|{one})*", c, s)
        return s

    def nodes(self, s: str) -> list:
        """The folded string as nested lists: tokens, and lists for repeated groups."""
        return [self.nodes(k[0]) if isinstance(k := self.back[c], tuple) else k for c in s]


def leaves(nodes: list, stream: list[str]) -> list[int] | None:
    """For each text of the stream, the number of its text node in the folded
    tree; None if the tree does not describe the stream."""
    out: list[int] = []

    def count(ns: list) -> int:
        return sum(count(n) if isinstance(n, list) else n == TEXT for n in ns)

    def match(ns: list, at: int, base: int, found: list[int]) -> int:
        for n in ns:
            if isinstance(n, list):
                at = match(n, at, base, found)
                while at >= 0:
                    more: list[int] = []
                    following = match(n, at, base, more)
                    if following < 0:
                        break
                    at = following
                    found += more
                if at < 0:
                    return -1
                base += count(n)
            elif at < len(stream) and stream[at] == n:
                if n == TEXT:
                    found.append(base)
                    base += 1
                at += 1
            else:
                return -1
        return at

    return out if match(nodes, 0, 0, out) == len(stream) else None


def page_number(stream: str, texts: list[str]) -> int:
    """A positive number that pages of equal content share."""
    return int.from_bytes(blake2b("\0".join([stream, *texts]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 | 1


def both_seen(a: int, b: int) -> int:
    """``seen`` of two texts that are equal; 0: not known."""
    return a if a == b or not b else b if not a else SEVERAL


class Node:
    """One element of a wrapper: a tag, a text (template or slot) or a repeated group."""

    __slots__ = ("body", "key", "optional", "seen", "size", "tag", "text")

    def __init__(self, tag: str | None = None, body: list | None = None, text: str | None = None, size: int = 0, optional: bool = False, seen: int = 0):
        self.tag, self.body, self.text, self.size, self.optional = tag, body, text, size, optional
        self.seen = seen  # of a text: the only page that has it, or SEVERAL
        self.key = tag if body is None else "(" + " ".join(n.key for n in body) + ")"

    def weight(self) -> int:
        return 2 + sum(n.weight() for n in self.body) if self.body is not None else 1 if self.tag == TEXT else 2


def build(nodes: list, texts: list, sizes: list, seen: list | None = None) -> list[Node]:
    """A folded stream as wrapper nodes; ``texts``: per text node its template or
    None; ``seen``: the only page that has it, or SEVERAL."""
    it = iter(zip(texts, sizes, seen or [0] * len(texts), strict=True))

    def make(ns: list) -> list[Node]:
        out = []
        for n in ns:
            if isinstance(n, list):
                out.append(Node(body=make(n)))
            elif n == TEXT:
                text, size, page = next(it)
                out.append(Node(TEXT, text=text, size=size, seen=page))
            else:
                out.append(Node(n))
        return out

    return make(nodes)


def _similar(a: Node, b: Node) -> bool:
    if a.key == b.key:
        return True
    return a.body is not None and b.body is not None and a.body[0].key == b.body[0].key and a.body[0].tag != TEXT


def _rows(x: list, y: list) -> Iterator[int]:
    """For each head of y a row of bits, 0 where an element of x makes the longest
    common subsequence of x's head and y's longer."""
    where: dict[object, int] = {}
    for i, e in enumerate(x):
        where[e] = where.get(e, 0) | 1 << i
    mask = (1 << len(x)) - 1
    v = mask
    for e in y:
        u = v & where.get(e, 0)
        v = ((v + u) | (v - u)) & mask
        yield v


def common(x: list, y: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of positions, 64 cells at a time; in
    halves where its bit rows would take more than ``BIT_BYTES``."""
    if not x or not y:
        return []
    if len(x) * len(y) // 8 > BIT_BYTES and len(y) > 1:
        half = len(y) // 2

        def lengths(a: list, b: list) -> np.ndarray:
            """Of each head of a with all of b."""
            for row in _rows(a, b):
                pass
            bits = np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8)
            return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(a)].astype(np.int64))])

        at = int((lengths(x, y[:half]) + lengths(x[::-1], y[half:][::-1])[::-1]).argmax())
        return common(x[:at], y[:half]) + [(i + at, j + half) for i, j in common(x[at:], y[half:])]
    rows = list(_rows(x, y))
    out = []
    i, j = len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:  # x[i] brings nothing
            i -= 1
        elif j and not rows[j - 1] >> i & 1:  # it did so before y[j]
            j -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def pairs(a: list[Node], b: list[Node]) -> list[tuple[int, int, int, int]]:
    """The heaviest alignment: (i, i2, j, j2) says that a[i:i2] and b[j:j2] match.

    A repeated group also matches a single copy of its body.  Lists of any
    lengths are aligned in the same way: time follows the lengths' product, a
    row of numbers at a time, and ``_heaviest`` bounds memory.
    """
    out: list[tuple[int, int, int, int]] = []
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo].key == b[lo].key:
        out.append((lo, lo + 1, lo, lo + 1))
        lo += 1
    p, q = len(a), len(b)
    tail = []
    while p > lo and q > lo and a[p - 1].key == b[q - 1].key:
        tail.append((p - 1, p, q - 1, q))
        p, q = p - 1, q - 1
    return out + [(i + lo, i2 + lo, j + lo, j2 + lo) for i, i2, j, j2 in _heaviest(a[lo:p], b[lo:q])] + tail[::-1]


def _places(body: list[int], codes: np.ndarray) -> np.ndarray:
    """Where the body begins in the list."""
    n = len(body)
    if n > len(codes):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(codes[: len(codes) - n + 1] == body[0])
    for k in range(1, n):
        at = at[codes[at + k] == body[k]]
    return at


def _heaviest(a: list[Node], b: list[Node], cells: int = CELLS) -> list[tuple[int, int, int, int]]:
    """``pairs`` of all nodes.  Rows of the best weights are made from the last one
    up; the steps are kept for blocks of about ``cells`` cells, and every block is
    made again, from the rows below it, when the way leads through it."""
    p, q = len(a), len(b)
    if not p or not q:
        return []
    number: dict[str, int] = {}
    ka, kb = (np.array([number.setdefault(n.key, len(number)) for n in x]) for x in (a, b))
    bodies = [{i: [number.get(n.key, -1) for n in x[i].body] for i in range(len(x)) if x[i].body is not None} for x in (a, b)]
    weights = [n.weight() for n in a]
    # by a's node: where b has equal ones, like groups, or single copies of its body
    same = {k: np.flatnonzero(kb == k) for k in set(ka.tolist())}
    by_first: dict[str, list[int]] = {}
    for j in bodies[1]:
        by_first.setdefault(b[j].body[0].key, []).append(j)
    first = {k: np.array([j for j in js if b[j].body[0].tag != TEXT], np.int64) for k, js in by_first.items()}
    alike = {i: x[kb[x] != ka[i]] for i in bodies[0] for x in [first.get(a[i].body[0].key, np.zeros(0, np.int64))]}
    copies = {i: np.setdiff1d(_places(body, kb), np.union1d(alike[i], same[int(ka[i])])) for i, body in bodies[0].items()}
    # b's groups by their key, and by a's node those of whose body a single copy begins there
    alikes = {int(k): (np.flatnonzero(kb == k), bodies[1][j]) for k, j in {int(kb[j]): j for j in bodies[1]}.items()}
    groups: dict[int, list[int]] = {}
    asked: dict[int, list[tuple[int, int]]] = {}
    for k, (_, body) in alikes.items():
        for i in _places(body, ka).tolist():
            if ka[i] != k:
                groups.setdefault(i, []).append(k)
                asked.setdefault(i + len(body), []).append((i, k))
    later: dict[tuple[int, int], np.ndarray] = {}  # best weights that rows further up ask for

    def ask(i: int, row: np.ndarray) -> None:
        for x, k in asked.get(i, ()):
            later[x, k] = row[alikes[k][0] + 1]

    def up(i: int, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of i from that of i + 1; and its steps: 0 past a's node, 1 past
        b's, 2 a match, 3 a group and a copy, 4 a copy and a group."""
        kind, value = np.zeros(q, np.int8), nxt[:q].copy()
        at = np.concatenate([same[int(ka[i])], alike[i]]) if i in alike else same[int(ka[i])]
        v = nxt[at + 1] + weights[i]
        at, v = at[v >= value[at]], v[v >= value[at]]
        value[at], kind[at] = v, 2
        if i in copies and len(at := copies[i]):
            v = nxt[at + len(bodies[0][i])] + weights[i] - 1
            at, v = at[v > value[at]], v[v > value[at]]
            value[at], kind[at] = v, 3
        for k in groups.get(i, ()):
            at, v = alikes[k][0], later[i, k] + weights[i]
            better = v > value[at]
            if i in alike:
                better &= ~np.isin(at, np.concatenate([alike[i], copies[i]]))
            value[at[better]], kind[at[better]] = v[better], 4
        row = np.zeros(q + 1, np.int64)
        row[:q] = np.maximum.accumulate(value[::-1])[::-1]
        # past b's node where that is better; a match is as good, a copy is not
        right = row[1:]
        kind[(right > value) | (right == value) & (kind > 2)] = 1
        ask(i, row)
        return row, kind

    height = max(1, cells // q, int(p**0.5))
    row = np.zeros(q + 1, np.int64)
    ask(p, row)
    below = {}
    for i in range(p - 1, -1, -1):
        if (p - 1 - i) % height == 0:
            below[i] = row
        row, _ = up(i, row)
        for k in groups.get(i, ()):  # what the block's own rows give again is not kept
            if i + len(alikes[k][1]) <= p - 1 - (p - 1 - i) // height * height:
                del later[i, k]
    out = []
    i, j, steps = 0, 0, {}
    while i < p and j < q:
        if i not in steps:
            low = p - 1 - (p - 1 - i) // height * height
            row, steps = below[low], {}
            for k in range(low, i - 1, -1):
                row, steps[k] = up(k, row)
        kind = steps[i][j]
        x, y = ((1, 0), (0, 1), (1, 1), (1, len(bodies[0].get(i, ()))), (len(bodies[1].get(j, ())), 1))[kind]
        if x and y:
            out.append((i, i + x, j, j + y))
        i, j = i + x, j + y
    return out


def _unify(a: list[Node], b: list[Node]) -> list[Node]:
    """One node list for two that match one to one, or group against body."""
    if len(a) == len(b) == 1 and a[0].body is None and b[0].body is None:
        x, y = a[0], b[0]
        n = Node(x.tag, text=x.text if x.text == y.text else None, size=x.size + y.size, optional=x.optional or y.optional, seen=both_seen(x.seen, y.seen))
        return [n]
    if len(a) == len(b) == 1 and a[0].body is not None and b[0].body is not None:
        return [_group(merge(a[0].body, b[0].body), a[0].optional or b[0].optional)]
    group, single = (a[0], b) if len(a) == 1 and a[0].body is not None else (b[0], a)
    return [_group(merge(group.body, single), group.optional or any(n.optional for n in single))]


def _group(body: list[Node], optional: bool) -> Node:
    return Node(body=body, optional=optional)


def _optional(nodes: list[Node]) -> list[Node]:
    for n in nodes:
        n.optional = True
    return nodes


def merge(a: list[Node], b: list[Node]) -> list[Node]:
    """The wrapper of both: what only one has becomes optional."""
    out: list[Node] = []
    i = j = 0
    for i1, i2, j1, j2 in pairs(a, b):
        out += _optional(a[i:i1]) + _optional(b[j:j1])
        out += _unify(a[i1:i2], b[j1:j2])
        i, j = i2, j2
    out += _optional(a[i:]) + _optional(b[j:])
    return refold(out)


def refold(nodes: list[Node]) -> list[Node]:
    """Folds repeats that alignment has brought together, optional parts included."""
    while True:
        if len(nodes) > SYMBOLS and len({n.key for n in nodes}) > SYMBOLS:
            return nodes
        keys: dict[str, str] = {}
        s = "".join(keys.setdefault(n.key, chr(0x10000 + len(keys))) for n in nodes)
        tries = ((m.start(), m.end(), len(m[1])) for t in _TANDEMS[: len(s) // 2] for m in t.finditer(s))
        longer = ((x, y, n) for n, spans in long_periods(s) for x, y in spans)
        found = next((m for m in chain(tries, longer) if not (m[2] == 1 and nodes[m[0]].tag == TEXT)), None)
        if not found:
            return nodes
        start, end, n = found
        copies = [nodes[i : i + n] for i in range(start, end, n)]
        body = copies[0]
        for c in copies[1:]:
            body = [u for x, y in zip(body, c, strict=True) for u in _unify([x], [y])]
        if n == 1 and body[0].body is not None:
            group = body[0]  # a group of a group is that group
        else:
            group = _group(body, all(x.optional for x in copies[0]))
        nodes = [*nodes[:start], group, *nodes[end:]]


def infer(streams: list[list[Node]]) -> list[Node]:
    """The wrapper of several folded streams."""
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = merge(wrapper, s)
    return wrapper


def expression(nodes: list[Node]) -> str:
    """The wrapper as text: tags, slots as {}, (...)+ for groups, ? for optional."""
    out = []
    for n in nodes:
        x = f"({expression(n.body)})+" if n.body is not None else ("{}" if n.text is None else n.text) if n.tag == TEXT else f"<{n.tag}>"
        out.append(x + ("?" if n.optional else ""))
    return "".join(out)


def dump(nodes: list[Node]) -> list:
    return [[n.tag, dump(n.body) if n.body is not None else None, n.text, n.size, int(n.optional), n.seen] for n in nodes]


def load(data: list) -> list[Node]:
    return [Node(tag, load(body) if body is not None else None, text, size, bool(optional), seen) for tag, body, text, size, optional, seen in data]


def content_slots(wrapper: list[Node]) -> set[int]:
    """Ids of the text nodes that are content: slots below the container that
    holds most slot text, outside navigation and the like."""
    place: dict[int, tuple[str, ...]] = {}
    total: dict[tuple[str, ...], int] = {}
    slots: list[Node] = []
    stack: list[str] = []

    def walk(nodes: list[Node]) -> None:
        for n in nodes:
            if n.body is not None:
                walk(n.body)
            elif n.tag == TEXT:
                names = {t.split(".")[0] for t in stack}
                if n.text is None and not names & _OUTSIDE:
                    path = tuple(t for t in stack if t.split(".")[0] not in _INLINE | _TEXT_BLOCKS)
                    place[id(n)] = path
                    slots.append(n)
                    total[path] = total.get(path, 0) + n.size
            elif n.tag.startswith("/"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].split(".")[0] == n.tag[1:]:
                        del stack[k:]
                        break
            elif n.tag.split(".")[0] not in _VOID:
                stack.append(n.tag)

    walk(wrapper)
    if not total:
        return set()
    main = max(total, key=lambda p: (total[p], p))
    return {id(n) for n in slots if place[id(n)][: len(main)] == main}


def _wanted(wrapper: list[Node], content: set[int], page: list[Node]) -> list[bool]:
    """For each text node of a page, whether it is content.  A text that no
    wrapper node matches goes with the text before it."""
    flags: dict[int, bool] = {}

    def mark(ws: list[Node], ps: list[Node]) -> None:
        for i, i2, j, j2 in pairs(ws, ps):
            w, p = ws[i:i2], ps[j:j2]
            if len(w) == 1 and w[0].body is not None:
                mark(w[0].body, p[0].body if len(p) == 1 and p[0].body is not None else p)
            elif len(p) == 1 and p[0].body is not None:
                mark(w, p[0].body)
            elif p[0].tag == TEXT:
                flags[id(p[0])] = id(w[0]) in content

    mark(wrapper, page)
    out: list[bool] = []

    def walk(ps: list[Node]) -> None:
        for p in ps:
            if p.body is not None:
                walk(p.body)
            elif p.tag == TEXT:
                out.append(flags.get(id(p), out[-1] if out else False))

    walk(page)
    return out


class Reader:
    """Tokenises and folds pages; equal streams are folded once."""

    def __init__(self, keep: int = 20_000):
        self.alphabet, self.cache, self.keep = Alphabet(), {}, keep

    def read(self, html: str | None) -> tuple[str, list, list[int], list[str]]:
        """Name of the folded stream, its nested lists, the node of each text, the texts."""
        stream, texts = tokens(html or "")
        if len(self.alphabet.of) > SYMBOLS:  # also frees what the cache has named by it
            self.alphabet, self.cache = Alphabet(), {}
        if len(stream) > SYMBOLS and len(set(stream)) > SYMBOLS:
            return json.dumps(stream), stream, list(range(len(texts))), texts
        s = "".join(map(self.alphabet.char, stream))
        got = self.cache.get(s)
        if got is None:
            if len(self.cache) >= self.keep:
                self.cache.clear()
            nodes = self.alphabet.nodes(self.alphabet.fold(s))
            where = leaves(nodes, stream)
            if where is None:  # a stream that no folding describes stays as it is
                nodes, where = stream, list(range(len(texts)))
            got = self.cache[s] = (json.dumps(nodes), nodes, where)
        return *got, texts


def streams(pages: DataFrame) -> DataFrame:
    """Distinct folded streams of each host: pages, per text node its only text
    (null if there are several), its summed length and the only page that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = Reader(), {}
        for batch in batches:
            for name, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                key, _, where, texts = reader.read(html)
                entry = found.get((name, key))
                if entry is None:
                    entry = found[name, key] = [0, {}, {}, {}]
                entry[0] += 1
                _, known, sizes, seen = entry
                page = page_number(key, texts)
                for k, t in zip(where, texts, strict=True):
                    if known.setdefault(k, t) != t:
                        known[k] = None
                    sizes[k] = sizes.get(k, 0) + len(t)
                    seen[k] = both_seen(seen.get(k, 0), page)
            if len(found) > 5_000:
                yield _stream_rows(found)
                found = {}
        yield _stream_rows(found)

    return pages.mapInArrow(run, _STREAMS)


def _stream_rows(found: dict) -> pa.RecordBatch:
    rows = [(h, key, n, [known[k] for k in sorted(known)], [sizes[k] for k in sorted(sizes)], [seen[k] for k in sorted(seen)]) for (h, key), (n, known, sizes, seen) in found.items()]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["host", "stream", "pages", "texts", "sizes", "seen"])


def wrappers(found: DataFrame, part_streams: int = PART_STREAMS, merged: int = MERGED) -> DataFrame:
    """(host, pages, wrapper): wrappers of parts of about ``part_streams`` streams
    of a host, then of ``merged`` such wrappers, and so on up to one, so that no
    task has more than that to align, however large the host."""
    found = store.write(found, "wrapper-streams")
    counts = store.write(found.groupBy("host").agg(F.ceil(F.approx_count_distinct("stream") / F.lit(part_streams)).cast("long").alias("parts")), "wrapper-parts")

    def same(frame: pd.DataFrame) -> pd.DataFrame:
        """Rows of one stream as one."""
        out = []
        for key, rows in frame.groupby("stream", sort=True):
            texts, sizes, seen = (list(rows[c].iloc[0]) for c in ("texts", "sizes", "seen"))
            for t, z, p in zip(*(rows[c].iloc[1:] for c in ("texts", "sizes", "seen")), strict=True):
                texts = [x if x == y else None for x, y in zip(texts, t, strict=True)]
                sizes = [x + y for x, y in zip(sizes, z, strict=True)]
                seen = list(map(both_seen, seen, p))
            out.append((int(rows["pages"].sum()), key, texts, [int(x) for x in sizes], [int(x) for x in seen]))
        return sorted(out, key=lambda r: (-r[0], r[1]))

    def part(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        rows = same(frame)
        wrapper = infer([build(json.loads(s), t, z, p) for _, s, t, z, p in rows])
        return pd.DataFrame({"host": [key[0]], "part": [int(key[1])], "pages": [sum(r[0] for r in rows)], "wrapper": [json.dumps(dump(wrapper))]})

    def whole(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame["pages"], frame["wrapper"], strict=True), key=lambda r: (-r[0], r[1]))
        wrapper = infer([load(json.loads(w)) for _, w in rows])
        return pd.DataFrame({"host": [key[0]], "part": [int(key[1])], "pages": [sum(int(r[0]) for r in rows)], "wrapper": [json.dumps(dump(wrapper))]})

    schema = "host string, part long, pages long, wrapper string"
    placed = found.join(store.broadcast_if_small(counts, 24), "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.col("parts")))
    made = placed.groupBy("host", "part").applyInPandas(part, schema)
    most = counts.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        made = made.groupBy("host", F.expr(f"part div {merged}").alias("part")).applyInPandas(whole, schema)
        most = -(-most // merged)
    return made.select("host", "pages", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, fields, text): every page's content through its host's wrapper.

    ``text`` joins the content slots by line feeds with entities resolved;
    ``fields`` counts all slots that the page fills.  Pages without a host form
    a host of their own (''); a text is template only where two pages of unlike
    content have it, so on a host of one page every text is a slot; null
    or empty HTML has 0 fields and text ''.  Of containers with equally much text
    the last by name is the content.  Repeated rows give repeated results; null
    ids are kept; an empty table gives no row; other columns, whatever their
    names, are ignored.  A very long page is read whole: ``pairs`` says how it is
    aligned, and one of more than 400,000 distinct tags is not folded.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    made = store.write(wrappers(streams(rows)), "wrappers")
    size = int(made.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0])
    side = F.broadcast(made) if size <= store.BROADCAST_BYTES else made
    joined = rows.join(side, "host").select("page_id", "host", "html", "pages", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known, plans = Reader(), {}, {}
        for batch in batches:
            fields, out = [], []
            for name, html, n, wrapper in zip(*(batch[c].to_pylist() for c in ("host", "html", "pages", "wrapper")), strict=True):
                key, nodes, where, texts = reader.read(html)
                plan = plans.get((name, key))
                if plan is None:
                    if name not in known:
                        if len(known) > 2_000:
                            known.clear()
                        known[name] = _prepare(wrapper, n)
                    if len(plans) > 50_000:
                        plans.clear()
                    empty = [None] * (max(where, default=-1) + 1)
                    plan = plans[name, key] = _plan(*known[name], build(nodes, empty, [0] * len(empty)))
                wanted, slot = plan
                fields.append(sum(slot[k] for k in where))
                out.append(unescape("\n".join(t for k, t in zip(where, texts, strict=True) if wanted[k])))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], pa.array(fields, pa.int32()), pa.array(out, pa.string())], ["page_id", "host", "fields", "text"])

    return joined.mapInArrow(run, SCHEMA)


def _prepare(wrapper: str, pages: int) -> tuple[list[Node], set[int], set[int]]:
    """The wrapper, its content slots and all its slots."""
    nodes = load(json.loads(wrapper))
    slots: set[int] = set()

    def walk(ns: list[Node]) -> None:
        for n in ns:
            if n.body is not None:
                walk(n.body)
            elif n.tag == TEXT:
                if pages == 1 or n.seen != SEVERAL:
                    n.text = None
                if n.text is None:
                    slots.add(id(n))

    walk(nodes)
    return nodes, content_slots(nodes), slots


def _plan(wrapper: list[Node], content: set[int], slots: set[int], page: list[Node]) -> tuple[list[bool], list[bool]]:
    return _wanted(wrapper, content, page), _wanted(wrapper, slots, page)
