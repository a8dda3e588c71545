"""One query per operator, over the whole table that it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_two_fit, jaccard_join, language_id, order_minhash, quality_crf, source_mix, store, suffix_lm, topk_search, url_filter, wrapper_induction


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labelled = store.write(url_filter.page_label(pages), "url-labels")
    return url_filter.filter_urls(pages, url_filter.fit(labelled))


def op2_ngram_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over distinct sets: copies form pairs with their lowest id."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


OP2_GROUPS_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '([0-9a-z]|[^\x00-\x7F])+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS s FROM g GROUP BY doc_id),
r AS (SELECT s, min(doc_id) AS id, min(n) AS n FROM n GROUP BY s),
h AS (SELECT id, n, gram FROM r JOIN g ON g.doc_id = r.id),
o AS (
  SELECT x.id AS a, y.id AS b, count(*) AS o, min(x.n) AS na, min(y.n) AS nb
  FROM h x JOIN h y ON x.gram = y.gram AND x.id < y.id GROUP BY x.id, y.id)
SELECT a AS doc_a, b AS doc_b, o / (na + nb - o) AS jaccard FROM o WHERE o >= 0.6 * (na + nb - o) - 1e-9
UNION ALL
SELECT r.id, n.doc_id, 1.0 FROM n JOIN r USING (s) WHERE n.doc_id <> r.id
"""


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class by the threshold's similarity, and its number of links, copies included."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '([0-9a-z]|[^\x00-\x7F])+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
p AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE o >= 0.6 * (na.n + nb.n - o) - 1e-9),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT doc_id AS u, doc_id AS v FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.u, e.b FROM r JOIN e ON e.a = r.v),
l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT u AS doc_id, min(v) AS class_id, coalesce(any_value(links), 0) AS links FROM r LEFT JOIN l ON l.a = u GROUP BY u
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.classify(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.extract(table(spark, sf_dir, "pages"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h,
         len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n
  FROM documents),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS have FROM d GROUP BY source HAVING sum(n) > 0),
u AS (SELECT min(have) AS unit FROM s),
c AS (SELECT doc_id, source, CAST(sum(n) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM d)
SELECT doc_id, source,
       CAST(CASE WHEN cum <= unit * 25 // 100 THEN 25 WHEN cum <= unit * 50 // 100 THEN 50 ELSE 100 END AS INTEGER) AS percent
FROM c, u WHERE cum <= unit
"""


def op7_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the model of all other documents, and the
    benchmark's texts under the model of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = suffix_lm.score_documents(docs.withColumnRenamed("doc_id", "item_id"))
    asked = suffix_lm.score(docs, table(spark, sf_dir, "benchmark"))
    return scored.withColumn("scored", F.lit("documents")).unionByName(asked.withColumn("scored", F.lit("benchmark")))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.order_minhash(table(spark, sf_dir, "documents"))


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark text."""
    return topk_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '([0-9a-z]|[^\x00-\x7F])+')) AS t FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '([0-9a-z]|[^\x00-\x7F])+') AS w FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(w)) AS DOUBLE) / count(*) AS average FROM d),
p AS (
  SELECT doc_id, t, dl, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT doc_id, CAST(len(w) AS DOUBLE) AS dl, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t, dl),
f AS (SELECT t, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY t),
i AS (
  SELECT doc_id, t, CAST(floor(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 1.9::DOUBLE / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * dl / average))) * 65536.0::DOUBLE) AS BIGINT) AS impact
  FROM p JOIN f USING (t), s),
r AS (
  SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS points
  FROM q JOIN i USING (t) GROUP BY item_id, doc_id HAVING sum(impact) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY points DESC, doc_id) AS rank FROM r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, points / 65536.0::DOUBLE AS score FROM k WHERE rank <= 10
"""


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit.best_two_fit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op2_ngram_jaccard_groups": OP2_GROUPS_SQL, "op6_source_mix": OP6_SQL, "op9_block_topk": OP9_SQL}
