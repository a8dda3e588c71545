import os

import pytest

import __spark_entry__ as E
import corpus_pipeline
from lodestone.llm import store

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "near duplicates", "mixing sources", "best-fit packing"]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_stages(spark, monkeypatch):
    given = []

    def watched(stage):
        def run(session, docs, folder):
            given.append(docs)
            return stage(session, docs, folder)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(f)) for n, f in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, DATA).collect()
    first, given[:] = list(given), []
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, packed))  # again, the same
    given[:] = first
    assert all(d.columns == given[0].columns for d in given)
    kept = [{r.doc_id for r in d.select("doc_id").collect()} for d in given]
    assert len(kept[0]) == given[0].count() and all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and len(kept[4]) < len(kept[3]) < len(kept[2]) < len(kept[1])
    # every labelled document that is bad goes and every good one stays
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert not [i for i in kept[2] if labels.get(i) == 0] and not [i for i, q in labels.items() if q == 1 and i in kept[1] - kept[2]]
    assert {r.doc_id for r in packed} == {r.doc_id for r in given[4].where("length(trim(text)) > 0").collect()}


def test_shared_folder_is_read_from_the_session(spark, tmp_path):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: f"file://{tmp_path}/shared/" if key == "spark.checkpoint.dir" else default)

    assert store.shared_folder(Session) == f"file://{tmp_path}/shared"
    before = len(store._written)
    store.write(spark.range(3), "x")
    path = store._written[before].removeprefix("file://")
    assert path.startswith(store.shared_folder(spark).removeprefix("file://") + "/lodestone/x-") and os.path.exists(path)
    store.clear(spark)
    assert not os.path.exists(path) and not store._written


LABELS = "doc_id long, quality long, toxic long"


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    labels = [(4, 1, 0), (5, 1, 0), (7, 0, 1), (None, 0, 0), (99, 1, 0)]
    at = folder(spark, tmp_path / "awkward", awkward, labels)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = store.write(out, "test")
    assert docs.count() <= awkward.count() and corpus_pipeline.run(spark, at).where("n_tokens <= 0").count() == 0
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "empty", empty, [])).count() == 0


def test_pipeline_equals_brute_force(spark, rng, english, german, tmp_path):
    """Stage by stage, one document at a time, over a table with planted cases."""
    import numpy as np
    import pyarrow as pa

    from lodestone.llm import language_id, quality_crf

    from .conftest import SCHEMA, sentence
    from .test_mix_and_pack import brute_mix, naive_pack
    from .test_text_and_join import brute

    def text(words):
        return "\n".join(sentence(rng, rng.randrange(8, 25), words).capitalize() + "." for _ in range(rng.randrange(2, 6)))

    rows = [(i, text(english if i % 2 else german), "en" if i % 2 else "de", "ab"[i % 2], 0) for i in range(120)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in text(english).split()), "en", "a", 0) for i in range(40)]
    rows += [(300 + i, rows[i][1], rows[i][2], "a", 0) for i in range(10)]  # exact copies
    rows += [(400 + i, rows[20 + i][1] + " Garden.", rows[20 + i][2], "b", 0) for i in range(10)]  # near ones
    rows += [(500 + i, sentence(rng, 40, ["ποταμός", "πέτρα", "σπίτι", "χειμώνας", "κήπος"]), None, "a", 0) for i in range(8)]
    at = folder(spark, tmp_path, spark.createDataFrame(rows, SCHEMA), [(r[0], int(not 200 <= r[0] < 300), 0) for r in rows if r[0] % 2 or r[0] < 300])
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    by = {r[0]: r for r in rows}
    speaks = language_id.fit(docs)
    known = []
    for i, r in by.items():  # the lowest cross-entropy within its language's limit
        clean = language_id.normalise(r[1])
        total, n = speaks.models.score([clean])
        k = int((-total[0] / n[0]).argmin())
        if -total[0, k] / n[0] <= speaks.limit[k] + speaks.spread[k] / n[0] ** 0.5:
            known.append(i)
    assert not [i for i in known if i >= 500] and len(known) == len(rows) - 8
    judge = quality_crf.fit(docs.where(docs.doc_id.isin(known)), labels)
    good = []
    for i in known:  # marginals of all labellings of a chain, weighted by length
        x = quality_crf.lines_of(pa.array([by[i][1]]))
        s, n = judge.weights[x.active].sum(1), len(x.length)
        paths = np.array(list(np.ndindex(*[2] * n)))
        w = np.exp([s[np.arange(n), p].sum() + judge.move[p[:-1], p[1:]].sum() for p in paths])
        marginal = (paths * w[:, None]).sum(0) / w.sum()
        if (marginal * x.length).sum() / x.length.sum() >= judge.threshold:
            good.append(i)
    assert not [i for i in good if 200 <= i < 300] and len(good) == len(known) - 40
    root = {i: i for i in good}
    pairs = brute([(i, by[i][1]) for i in good], 0.6)
    for _ in good:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    single = [i for i in good if root[i] == i]
    assert len(single) == 120
    mixed = [i for i, _, _ in brute_mix([(i, by[i][1], by[i][3]) for i in single], {}, (100,))]
    sizes = {i: len(by[i][1].split()) for i in sorted(mixed)}
    bins = naive_pack([(n, i) for i, n in sizes.items()], 2048)
    want = sorted((b, s, i, 0, 0, n) for b, content in enumerate(bins) for s, (n, i) in enumerate(content))
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == want
