import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jaccard_join, order_minhash, textkit

from .conftest import SCHEMA, sentence

_texts = st.lists(st.one_of(st.none(), st.text(alphabet="abC1 .é文\n", max_size=12)), max_size=8)


def split(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())


@settings(max_examples=200, deadline=None)
@given(_texts)
def test_words_equal_split(texts):
    h, first = textkit.words(pa.array(texts, pa.string()))
    want = [[int(textkit.hash_text(w.decode())) for w in split(t)] for t in texts]
    assert [h[a:b].tolist() for a, b in itertools.pairwise(first)] == want


@settings(max_examples=100, deadline=None)
@given(_texts, st.integers(1, 4))
def test_ngrams_tell_words_apart(texts, n):
    h, first = textkit.words(pa.array(texts, pa.string()))
    g, gf = textkit.ngrams(h, first, n)
    grams = [tuple(w[i : i + n]) for w in map(split, texts) for i in range(max(1, len(w) - n + 1)) if w]
    assert len(grams) == len(g) and len(set(grams)) == len(set(g.tolist()))
    assert [b - a for a, b in itertools.pairwise(gf)] == [max(len(w) - n + 1, int(bool(w))) for w in map(split, texts)]


def test_pieces_cover_a_batch_and_slices_work():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([None if i % 7 == 0 else "x" * i for i in range(100)])], ["doc_id", "text"])
    parts = list(textkit.pieces(batch, "text", 500))
    assert len(parts) > 5 and [i for p in parts for i in p["doc_id"].to_pylist()] == list(range(100))
    h = np.concatenate([textkit.words(p["text"])[0] for p in parts])
    assert (h == textkit.words(batch["text"])[0]).all()


def sets_of(docs):
    return {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, w in ((i, split(t)) for i, t in docs) if i is not None and w}


def brute(docs, threshold):
    sets = sets_of(docs)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.fixture(scope="module")
def copies(rng, english):
    """Groups of exact and near copies, a passage that many share, plain texts."""
    docs, passage = [], sentence(rng, 30, english)
    for g in range(12):
        base = sentence(rng, rng.randrange(30, 200), english + [f"w{k}" for k in range(300)]).split()
        for c in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(0 if c % 3 == 0 else rng.randrange(1, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
            docs.append(" ".join(words) + (" " + passage if g % 4 == 0 else ""))
    docs += [sentence(rng, 60, [f"u{k}" for k in range(900)]) + " " + passage for _ in range(40)] + ["one", "one", "two words", None, "", "..."]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_join_equals_brute_force(spark, copies):
    want = brute(copies, 0.6)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.jaccard_join(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert all(np.isclose(want[p], j) for p, j in got.items())  # nothing false, values exact
    sets = sets_of(copies)
    lowest = {}
    for i in sorted(sets):
        lowest.setdefault(frozenset(sets[i]), i)
    expected = {p for p in want if sets[p[0]] == sets[p[1]] and p[0] == lowest[frozenset(sets[p[0]])] or sets[p[0]] != sets[p[1]] and all(lowest[frozenset(sets[x])] == x for x in p)}
    assert set(got) <= expected and len(got) >= 0.95 * len(expected)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=25), min_size=1, max_size=40), st.sampled_from([0.3, 0.6, 0.9]))
def test_tree_never_loses_a_pair(sets, threshold):
    flags = np.zeros((len(sets), 64), bool)  # few bits, so that many grams share one
    for i, s in enumerate(sets):
        flags[i, [x % 64 for x in s]] = True
    maps = np.packbits(flags, axis=1).view(np.uint64)
    a, b = jaccard_join.SignatureTree(np.array([len(s) for s in sets]), maps).self_join(threshold)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(got) == len(a)
    for i, j in itertools.combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            assert (i, j) in got


def test_tree_prunes_unlike_sets():
    rng = np.random.default_rng(2)
    flags = np.zeros((600, 2048), bool)
    for i in range(600):
        flags[i, rng.choice(2048, 60, replace=False)] = True
    a, _ = jaccard_join.SignatureTree(flags.sum(1), np.packbits(flags, axis=1).view(np.uint64)).self_join(0.6)
    assert len(a) == 0


def test_large_groups_are_tiled(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    sets = jaccard_join.describe(docs)
    pairs = jaccard_join.candidates(sets)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(jaccard_join.candidates(sets, block_sets=3)) == key(pairs)
    assert key(jaccard_join.verify(docs, sets, pairs, tile_pairs=1)) == key(jaccard_join.verify(docs, sets, pairs))


def test_deduplicate(spark, copies):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in copies], SCHEMA)
    kept = {r.doc_id for r in jaccard_join.deduplicate(docs).collect()}
    parent = {i: i for i, _ in copies}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(copies, 0.6):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {root(i) for i, _ in copies}
    assert want <= kept and len(kept - want) <= 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 200)]
    got = {r.u: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100, 102: 100}
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_all_pairs_have_every_copy(spark):
    base = " ".join(f"b{k}" for k in range(60))
    near = base + " end"
    docs = [(1, base), (2, base), (3, base), (7, near), (8, near), (9, "other words here")]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.all_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs, 0.6)
    assert len(want) == 10 and set(got) == set(want) and all(np.isclose(want[p], j) for p, j in got.items())


def test_all_pairs_equal_brute_force(spark, copies, awkward, empty):
    want = brute(copies, 0.6)
    rows = jaccard_join.all_pairs(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    got = {(r.doc_a, r.doc_b): r.jaccard for r in rows}
    assert len(got) == len(rows) and set(got) <= set(want) and len(got) >= 0.95 * len(want) and all(np.isclose(want[p], j) for p, j in got.items())
    assert {p for p, j in want.items() if j == 1} <= set(got)
    assert [tuple(r) for r in jaccard_join.all_pairs(awkward).collect()] == [(5, 6, 1.0)] and jaccard_join.all_pairs(empty).count() == 0


def test_exact_join_equals_brute_force(spark, copies):
    want = brute(copies, 0.6)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    rows = jaccard_join.all_pairs(docs, exact=True).collect()
    got = {(r.doc_a, r.doc_b): r.jaccard for r in rows}
    assert len(got) == len(rows) and set(got) == set(want) and all(np.isclose(want[p], j) for p, j in got.items())
    # also with a threshold that many bands would miss
    low = brute(copies, 0.35)
    assert {(r.doc_a, r.doc_b) for r in jaccard_join.all_pairs(docs, threshold=0.35, exact=True).collect()} == set(low)


def test_groups_of_many_bytes_are_tiled(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    sets = jaccard_join.describe(docs)
    pairs = jaccard_join.candidates(sets)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(jaccard_join.verify(docs, sets, pairs, tile_bytes=5_000)) == key(jaccard_join.verify(docs, sets, pairs))


def test_deduplicate_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, 1), (2, "a b c d e", 6, 2), (3, "other", 7, 3), (3, "another", 8, 4)], "doc_id long, text string, id_ int, ID__ int")
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d e", 5, 1), (3, "another", 8, 4)]


def test_join_on_awkward_tables(awkward, empty):
    got = {(r.doc_a, r.doc_b, r.jaccard) for r in jaccard_join.jaccard_join(awkward).collect()}
    assert got == {(5, 6, 1.0)}
    kept = jaccard_join.deduplicate(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(map(str, [None, None, 1, 2, 3, 4, 5, 7, 8]))  # one of 4's two rows, 5 for 6
    assert jaccard_join.jaccard_join(empty).count() == 0 and jaccard_join.deduplicate(empty).count() == 0


def brute_print(words, k, size, signatures):
    if not words:
        return []
    n = max(1, len(words) - k + 1)
    h, first = np.array([textkit.hash_text(w) for w in words]), np.array([0, len(words)])
    grams = textkit.ngrams(h, first, k)[0]
    assert len(grams) == n
    seen, keys = {}, []
    for g in grams.tolist():
        seen[g] = seen.get(g, -1) + 1
        keys.append(int(textkit.mix(np.array([(g + seen[g] * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]))
    low, out = (1 << n.bit_length()) - 1, []
    for j in range(signatures):
        seed = int(order_minhash._SEEDS[j])
        at = sorted(range(n), key=lambda i: ((keys[i] * seed % 2**64) & ~low, i))[:size]
        v = np.zeros(1, np.uint64)
        for i in sorted(at):
            v = textkit.mix(v * np.uint64(31) + grams[i])
        out.append(int(textkit.mix(v + np.uint64(j)).view(np.int64)[0]))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=30))
def test_fingerprint_equals_brute_force(words):
    h, first = textkit.words(pa.array([" ".join(words)]))
    g, _ = textkit.ngrams(h, first, 2)
    got = order_minhash.fingerprint(g, 3, 8).view(np.int64).tolist() if len(g) else []
    assert got == brute_print(words, 2, 3, 8)


def test_fingerprints_see_order(spark, english, rng):
    words = sentence(rng, 300, [f"w{i}" for i in range(200)]).split()
    edited = list(words)
    edited[150] = "other"
    moved = words[150:] + words[:150]
    blocks = [words[i : i + 10] for i in range(0, 300, 10)]
    rng.shuffle(blocks)
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(moved)), (4, " ".join(sum(blocks, []))), (5, " ".join(words))]
    got = {r.doc_id: r.fingerprint for r in order_minhash.order_minhash(spark.createDataFrame(rows, "doc_id long, text string"), signatures=200).collect()}
    like = {i: np.mean(np.array(got[1]) == np.array(got[i])) for i in got}
    assert like[5] == 1 and like[2] > 0.9 > 0.6 > like[3] > like[4]


def test_fingerprints_on_awkward_tables(awkward, empty):
    rows = order_minhash.order_minhash(awkward).collect()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert len(rows) == awkward.count() and all(by[i].kmers == 0 and by[i].fingerprint == [] for i in (1, 2, 3, 7))
    assert by[5].fingerprint == by[6].fingerprint and len(by[5].fingerprint) == order_minhash.SIGNATURES and by[4].kmers == 59_998
    assert order_minhash.order_minhash(empty).count() == 0


def classes_by_brute_force(docs):
    """(class, links) of each id."""
    pairs = {p for p in brute([(i, t) for i, t in docs if i is not None and t], 0.6)}
    out = {i: [i, len({y for p in pairs for x, y in (p, p[::-1]) if x == i})] for i, _ in docs if i is not None}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(out[a][0], out[b][0])
            changed |= out[a][0] != low or out[b][0] != low
            out[a][0] = out[b][0] = low
    return {i: tuple(x) for i, x in out.items()}


def test_classes_have_a_row_for_each_document(spark, copies, awkward, empty):
    base = " ".join(f"b{k}" for k in range(60))
    near, far = base + " end", " ".join(f"c{k}" for k in range(60))
    docs = [(7, near), (8, near), (3, base), (2, base), (5, base), (9, "other words here"), (10, ""), (11, None), (None, base)]
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes_by_brute_force(docs) and got[7] == (2, 4)
    # an id of two texts links both groups, and counts once
    both = [*docs, (20, far), (21, far), (22, base), (22, far), (22, near)]
    rows = jaccard_join.classes(spark.createDataFrame(both, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.class_id, r.links) for r in rows}
    assert len(rows) == len(got) and got[22] == (2, 7) and got[20] == (2, 2) and got[7] == (2, 5) and got[9] == (9, 0)
    rows = jaccard_join.classes(spark.createDataFrame(copies, "doc_id long, text string"), exact=True).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in rows} == classes_by_brute_force(copies)
    assert jaccard_join.classes(empty).count() == 0
    assert {r.doc_id: (r.class_id, r.links) for r in jaccard_join.classes(awkward).collect()}[6] == (5, 1)
