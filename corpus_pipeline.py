"""From raw documents to packed bins, in stages.

Every stage takes what its predecessor kept; a stage's result is written as
Parquet and read again as the next one's documents.  All stages but the last
return the columns that they are given, whatever other columns these are; an
empty table stays empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import best_two_fit, jaccard_join, language_id, quality_crf, source_mix, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents in none of the known languages go.

    So do null and empty texts and those without letters; without any labelled
    text all go.  Rows that repeat, and those without an id, are judged by their text.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents of low quality go.

    So do null and empty texts; without labels of both kinds every other document
    stays.  Rows that repeat, and those without an id, are judged by their text.
    """
    return quality_crf.keep_good(docs, quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near duplicates the lowest id stays.

    Rows without an id and texts without words are in no group and stay; of rows
    that repeat an id one stays.
    """
    return jaccard_join.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every source gives the same number of tokens.

    A null source is one of its own; sources without tokens give nothing; rows
    that repeat an id go together.
    """
    return source_mix.select(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: what is left is packed into bins of 2,048 tokens.

    Null and empty texts are in no bin; rows that repeat, and those without an
    id, are packed once each.
    """
    return best_two_fit.best_two_fit(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_bins),
]

#: The models cannot be expressed in SQL; the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store.write(docs, "stage-" + name.replace(" ", "-"))
    return docs
