import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import queries, suffix_lm, topk_search

from .conftest import sentence


def split(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())


def brute_search(docs, asked, k):
    live = [(i, split(t)) for i, t in docs if i is not None and t is not None]
    n, average = len(live), sum(len(w) for _, w in live) / max(1, len(live))
    df = Counter(w for _, ws in live for w in set(ws))
    merged = {}
    for i, t in asked:
        if i is not None and t is not None:
            merged.setdefault(i, set()).update(split(t))
    out = []
    for q, terms in merged.items():
        found = []
        for i, ws in live:
            c = Counter(ws)
            score = sum(int(topk_search.impacts(np.array([c[t]]), np.array([len(ws)]), np.array([df[t]]), n, average)[0]) for t in terms if c[t])
            if score > 0:
                found.append((-score, i))
        out += [(q, r, i, -s / 65536) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark, rng, english):
    docs = [(i, sentence(rng, rng.randrange(1, 40), english + [f"r{k}" for k in range(80)])) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)]  # ties
    asked = [(q, sentence(rng, 6, english + [f"r{k}" for k in range(90)])) for q in range(25)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string")
    want = brute_search(docs, asked, 5)
    for chunk in (20_000, 7):
        assert sorted(map(tuple, topk_search.search(*frames, k=5, block=8, query_chunk=chunk).collect())) == want


def test_shards_are_bounded_and_give_few_rows(spark, rng, english, monkeypatch):
    docs = [(i, sentence(rng, rng.randrange(1, 40), english + [f"r{k}" for k in range(80)])) for i in range(1200)]
    asked = [(q, sentence(rng, 6, english + [f"r{k}" for k in range(90)])) for q in range(15)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(24), spark.createDataFrame(asked, "item_id long, text string")
    given, plain = [], topk_search._search_chunk
    monkeypatch.setattr(topk_search, "_search_chunk", lambda *a: given.append(plain(*a)) or given[-1])
    want = brute_search(docs, asked, 5)
    for postings in (4_000_000, 50):
        assert sorted(map(tuple, topk_search.search(*frames, k=5, block=8, shard_postings=postings, sample=4).collect())) == want
    # not k for every one of 24 partitions
    assert all(rows.count() <= 2 * 4 * 5 * len(asked) for rows in given)


def test_blocks_are_pruned():
    # one block holds the rare term: the others' bounds fall below the k-th score
    maxima = topk_search.Maxima([(np.array([0, 1]), np.array(m)) for m in ([90, 1], [2, 1], [1, 1])], 2)
    forward = [(np.array([b * 2, b * 2 + 1]), np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([90, 1, 80]) if b == 0 else np.array([1, 1, 1])) for b in range(3)]
    best, seen = topk_search.top(np.array([0, 1]), maxima, forward, np.zeros(2, bool), 2)
    assert best == [(91, 0), (80, 1)] and seen == 1


def test_search_on_awkward_tables(spark, awkward, empty):
    asked = spark.createDataFrame([(1, "one", 0), (1, "three", 1), (2, None, 0), (3, "", 0), (None, "one", 0), (4, "absent", 0), (5, "TEXT ünïcödé word0 word0", 0), (5, "TEXT ünïcödé word0 word0", 0)], "item_id long, text string, score int")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    want = brute_search(docs, [(r.item_id, r.text) for r in asked.collect()], 10)
    assert sorted(map(tuple, topk_search.search(awkward, asked).collect())) == want
    assert [r[2] for r in want if r[0] == 5] in ([8, 4, 4], [4, 4, 8])
    assert topk_search.search(empty.selectExpr("*"), asked).count() == 0 and topk_search.search(awkward, asked.limit(0)).count() == 0


def test_search_sql_agrees(spark, tmp_path, rng, english):
    spark.createDataFrame([(i, sentence(rng, 20, english)) for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, sentence(rng, 4, english)) for i in range(9)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, queries.op9_block_topk(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.OP9_SQL})").fetchall())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=6))
def test_suffix_array_equals_sort(docs):
    tokens, ends = [], []
    for d in docs:
        tokens += [*d, 9]
        ends.append(len(tokens) - 1)
    _, word, order = suffix_lm.suffix_array(np.array(tokens, np.uint64), np.array(ends))
    assert order.tolist() == sorted(range(len(tokens)), key=lambda i: word[i:].tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 4), min_size=1, max_size=10))
def test_counts_equal_brute_force(docs, text):
    tokens, ends = [], []
    for d in docs:
        tokens += [*d, 9]
        ends.append(len(tokens) - 1)
    s, length, n = suffix_lm.count_ngrams(np.array(tokens, np.uint64), np.array(ends), np.array(text, np.uint64), np.full(len(text), len(text)))
    got = {(a, b): c for a, b, c in zip(s.tolist(), length.tolist(), n.tolist(), strict=True)}
    want = {}
    for i in range(len(text)):
        for k in range(1, len(text) - i + 1):
            if c := sum(d[j : j + k] == text[i : i + k] for d in docs for j in range(len(d) - k + 1)):
                want[i, k] = c
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=5), st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_runs_are_the_steps_of_counts(docs, text):
    tokens, ends = [], []
    for d in docs:
        tokens += [*d, 9]
        ends.append(len(tokens) - 1)
    s, length, n = suffix_lm.count_runs(np.array(tokens, np.uint64), np.array(ends), np.array(text, np.uint64), np.full(len(text), len(text)))
    for i in range(len(text)):
        have = {k: sum(d[j : j + k] == text[i : i + k] for d in docs for j in range(len(d) - k + 1)) for k in range(1, len(text) - i + 2)}
        have[len(text) - i + 1] = 0
        want = [(k, c) for k, c in have.items() if k <= len(text) - i and c != have[k + 1]]
        got = list(zip(length[s == i].tolist(), n[s == i].tolist(), strict=True))
        assert dict(got).items() >= dict(want).items() and all(have[k] == c for k, c in got)


def test_long_contained_texts(spark, rng, english):
    """What a text of 20,000 words asks of a corpus that holds it grows with its words."""
    long = sentence(rng, 20_000, [f"{w}{k}" for w in english for k in range(40)])
    corpus = [long, sentence(rng, 50, english), " ".join(long.split()[100:300]), long]
    steps = suffix_lm.ngram_steps(spark.createDataFrame([(t,) for t in corpus], "text string").repartition(2), [(0, long)])
    assert steps.count() < 6 * 20_000
    texts = spark.createDataFrame([(1, long), (2, " ".join(long.split()[150:170]))], "item_id long, text string")
    got = {r.item_id: r for r in suffix_lm.score(spark.createDataFrame([(t,) for t in corpus], "text string"), texts).collect()}
    assert got[1].words == 20_000 and got[1].longest_context == 19_999 and got[1].perplexity < 1.01
    log, longest = brute_lm([split(t) for t in corpus], split(" ".join(long.split()[150:170])), sub=True)
    assert math.isclose(got[2].log_prob, log, rel_tol=1e-9) and got[2].longest_context == longest == 19


def brute_lm(corpus, text, a=1.0, sub=False):
    joined = [b" " + b" ".join(d) + b" " for d in corpus]

    def count(g):
        if sub:
            return sum(len(re.findall(b"(?= " + b" ".join(g) + b" )", d)) for d in joined)
        return sum(d[j : j + len(g)] == g for d in corpus for j in range(len(d) - len(g) + 1))

    total, out = sum(map(len, corpus)), []
    for i in range(len(text)):
        p, k = (count(text[i : i + 1]) + 1) / (2 * total), 1
        while k <= i and count(text[i - k : i]):
            h = text[i - k : i]
            p, k = (count([*h, text[i]]) + a * p) / (count(h) + a), k + 1
        out.append((p, k - 1))
    return sum(math.log(p) for p, _ in out), max(k for _, k in out)


@pytest.mark.parametrize("shard", [1_000_000, 50])
def test_scores_equal_brute_force(spark, rng, english, shard):
    corpus = [sentence(rng, rng.randrange(1, 30), english) for _ in range(60)]
    texts = [(i, sentence(rng, rng.randrange(1, 12), [*english, "unseen"])) for i in range(15)] + [(99, max(corpus, key=len))]
    got = {r.item_id: r for r in suffix_lm.score(spark.createDataFrame([(t,) for t in corpus], "text string").repartition(3), spark.createDataFrame(texts, "item_id long, text string"), shard_words=shard, text_words=10).collect()}
    split_ = [split(t) for t in corpus]
    for i, t in texts:
        log, longest = brute_lm(split_, split(t))
        assert math.isclose(got[i].log_prob, log, rel_tol=1e-9) and got[i].longest_context == longest and got[i].words == len(split(t))
    assert got[99].perplexity < 3


def test_scores_on_awkward_tables(spark, awkward, empty):
    texts = spark.createDataFrame([(1, "one two", 1), (1, "one two", 1), (1, "other", 2), (2, None, 3), (3, "", 4), (None, "one", 5), (4, "?!", 6)], "item_id long, text string, n int")
    rows = sorted(map(tuple, suffix_lm.score(awkward, texts).collect()), key=str)
    assert len(rows) == 5 and sum(r[0] == 1 for r in rows) == 2 and [r for r in rows if r[0] == 4] == [(4, 0, 0.0, None, None, None)]
    assert all(r.log_prob is None for r in suffix_lm.score(empty, texts).where("words > 0").collect())
    assert suffix_lm.score(awkward, texts.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "bucket"), [(250_000, 2_000_000), (40, 30)])
def test_documents_are_scored_under_all_others(spark, rng, english, chunk, bucket):
    docs = [sentence(rng, rng.randrange(1, 60), english[:9]) for _ in range(30)]
    long = sentence(rng, 90, english)
    docs += [long, long, "new " + long, " ".join(long.split()[5:70]) + " unseen words", "the " * 12, "the " * 40, "", None, "one"]
    rows = list(enumerate(docs))
    table = spark.createDataFrame([*rows, (None, "the of the of")], "item_id long, text string").repartition(3)
    got = {r.item_id: r for r in suffix_lm.score_documents(table, chunk_words=chunk, bucket_words=bucket).collect()}
    assert len(got) == len(docs) + 1
    corpus = [split(t or "") for t in [*docs, "the of the of"]]
    for i, t in [(k, t or "") for k, t in rows] + [(None, "the of the of")]:
        k = len(docs) if i is None else i
        log, longest = brute_lm(corpus[:k] + corpus[k + 1 :], split(t)) if t else (0.0, None)
        assert math.isclose(got[i].log_prob, log, rel_tol=1e-9) and got[i].longest_context == longest and got[i].words == len(split(t))


@pytest.mark.parametrize(("chunk", "bucket", "reach", "heavy"), [(250_000, 2_000_000, 12, 1_000_000), (60, 20, 5, 1_000_000), (60, 50, 4, 6), (200, 2_000, 8, 0)])
def test_shared_histories_are_compared(spark, rng, english, chunk, bucket, reach, heavy):
    """Near copies, repeated lines and rows that repeat a text, over several levels of runs and by counts."""
    base = sentence(rng, 60, english).split()
    docs = [" ".join(w if rng.random() < 0.97 else rng.choice(english) for w in base[rng.randrange(20) :]) for _ in range(5)]
    docs += [docs[0], docs[0], " ".join(base[30:50] * 2), "a b c d e " * 6, "a b c d e f " * 5 + "a b c d", "a b c d e " * 5, sentence(rng, 25, english[:3]), sentence(rng, 25, english[:3])]
    table = spark.createDataFrame(list(enumerate(docs)), "item_id long, text string").repartition(3)
    got = {r.item_id: r for r in suffix_lm.score_documents(table, chunk_words=chunk, bucket_words=bucket, reach=reach, heavy=heavy).collect()}
    corpus = [split(t) for t in docs]
    for k, words in enumerate(corpus):
        log, longest = brute_lm(corpus[:k] + corpus[k + 1 :], words)
        assert math.isclose(got[k].log_prob, log, rel_tol=1e-9) and got[k].longest_context == longest, k


def test_copied_passages_take_few_rounds(spark, rng, english, monkeypatch):
    """Counts of a copied passage fall in many steps, which are found by comparing its places a few times."""
    written = []
    parts = suffix_lm.store.write_parts
    monkeypatch.setattr(suffix_lm.store, "write_parts", lambda df, name, *a: written.append(name) or parts(df, name, *a))
    base = sentence(rng, 300, english).split()
    docs = [" ".join([*base[9 * k :], f"end{k}"]) for k in range(30)]
    got = suffix_lm.score_documents(spark.createDataFrame(list(enumerate(docs)), "item_id long, text string")).collect()
    assert max(r.longest_context for r in got) == 291 and len(written) <= 6


def test_copies_alone_are_settled_at_once(spark, rng, english, monkeypatch):
    """Where only a text's own rows have a history, its length takes no further round."""
    written = []
    parts = suffix_lm.store.write_parts
    monkeypatch.setattr(suffix_lm.store, "write_parts", lambda df, name, *a: written.append(name) or parts(df, name, *a))
    long = sentence(rng, 300, [f"{w}{k}" for w in english for k in range(9)])
    docs = [long, long, " ".join([*long.split()[40:48], "other", *long.split()[90:99]]), sentence(rng, 20, english)]
    got = {r.item_id: r for r in suffix_lm.score_documents(spark.createDataFrame(list(enumerate(docs)), "item_id long, text string")).collect()}
    assert written == ["lm-parts", "lm-runs"]
    corpus = [split(t) for t in docs]
    for k, words in enumerate(corpus):
        log, longest = brute_lm(corpus[:k] + corpus[k + 1 :], words)
        assert math.isclose(got[k].log_prob, log, rel_tol=1e-9) and got[k].longest_context == longest
    assert got[0].longest_context == 299


@pytest.mark.parametrize(("far", "depths"), [(16, 128), (0, 0)])
def test_sorted_histories_and_bounds(rng, monkeypatch, far, depths):
    monkeypatch.setattr(suffix_lm, "FAR", far)
    monkeypatch.setattr(suffix_lm, "DEPTHS", depths)
    for _ in range(60):
        text = [rng.randrange(1, 4) for _ in range(rng.randrange(8, 60))]
        text += text[: rng.randrange(len(text))]
        at = np.arange(3, len(text))
        there = np.minimum(at + 1, rng.choice([5, 12, 100]))
        codes = np.array(text, np.int32)
        group = suffix_lm.mix((codes[at] * 16 + codes[at - 1] * 4 + codes[at - 2]).astype(np.uint64))
        order, common = suffix_lm.sort_histories(codes, at, there, group, 3)
        for k, (i, j) in enumerate(zip(order[:-1].tolist(), order[1:].tolist(), strict=True), 1):
            least = min(there[i], there[j])
            same = next((n for n in range(least) if text[at[i] - n] != text[at[j] - n]), least)
            assert common[k] == same if same >= 3 else common[k] <= 3
        common[0] = common[-1] = -1
        lo, hi = suffix_lm._bounds(common, 3)
        for k in np.flatnonzero(common > 3).tolist():
            smaller = np.flatnonzero(common < common[k])
            assert lo[k] == smaller[smaller < k].max() and hi[k] == smaller[smaller > k].min()


def test_packed_arrays_come_back():
    cells = [(np.arange(300, dtype="u8") << np.uint64(40), "u8"), (np.zeros(0), "f8"), (np.arange(7) - 3, "i4"), (np.linspace(0, 1, 5), "f8")]
    for (x, kind), y in zip(cells, suffix_lm.unpack(suffix_lm.pack(*cells), *(k for _, k in cells)), strict=True):
        assert y.dtype == kind and (x == y).all()
    assert len(suffix_lm.unpack(suffix_lm.pack((np.zeros(0), "f8")), "f8")[0]) == 0


def test_query_scores_documents(spark):
    from lodestone.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.op7_suffix_lm(spark, folder)
    assert got.where("scored = 'documents'").count() == queries.table(spark, folder, "documents").count()


def test_documents_alone_have_no_scores(spark, awkward, empty):
    assert suffix_lm.score_documents(empty.withColumnRenamed("doc_id", "item_id")).count() == 0
    alone = suffix_lm.score_documents(spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")).collect()
    assert sorted(map(tuple, alone)) == [(1, 2, None, None, None, None), (2, 0, 0.0, None, None, None)]
    assert suffix_lm.score_documents(awkward.withColumnRenamed("doc_id", "item_id")).count() == awkward.count()


def test_repeated_texts_are_looked_up_once(spark, monkeypatch):
    written = {}
    write = suffix_lm.store.write

    def keep(df, name):
        out = write(df, name)
        if name == "lm-chunks":
            written["words"] = sum(len(suffix_lm.Chunk.load(r.body).codes) for r in out.collect())
        return out

    monkeypatch.setattr(suffix_lm.store, "write", keep)
    texts = ["a b c d e f"] * 6 + ["b c d e f g", "", None]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[0])]
    got = suffix_lm.score_documents(spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert written["words"] == 12 and len(got) == len(rows) and sum(r.item_id == 3 for r in got) == 2
    corpus = [split(t or "") for _, t in rows]
    want, longest = brute_lm(corpus[1:], split(texts[0]))
    same = [r for r in got if r.words == 6 and r.item_id != 6]
    assert len(same) == 8 and all(math.isclose(r.log_prob, want, rel_tol=1e-9) and r.longest_context == longest for r in same)
