"""The corpus pipeline: each stage works on all that the one before it kept.

Stages take and return the columns of documents, but for the last, which returns the mix: a row a
document with its size in words, its source's size and target, and the words taken. A null text
passes all stages as an empty one; documents without words are kept by every stage but the
classifier, which judges them like any other. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from simloom.llm.common import bounded, materialise, table, tidied

#: The classifier is learnt, which SQL cannot express; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
#: A column that documents do not have.
KEY = "__pipeline_key"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    keep = tuple(c for c in docs.columns if c != "doc_id")
    return quality.score(docs, model, keep=keep).filter("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines and repeated passages; n_chars follows a changed text."""
    out = line_dedup.drop_boilerplate(docs, F.col("source"), long_permille=line_dedup.LONG_PERMILLE)
    changed = F.col(line_dedup.N_LINES) != F.col(line_dedup.N_KEPT)
    n_chars = F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. All rows without an id stay.

    Where ids repeat, a document is an id and a text: rows equal in both are one document, rows that
    share an id and are not alike stay, and of equal ids the one with the least text hash is the least.
    """
    named = docs.filter("doc_id is not null")
    unique = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    key = F.col("doc_id") if unique else F.struct("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"))
    keyed = docs.withColumns({KEY: F.when(F.col("doc_id").isNotNull(), key)})
    groups = materialise(ngram_join.jaccard_components(keyed.select(KEY, "text"), KEY), "groups")
    kept = groups.filter(f"{KEY} = component_id").select(KEY)
    out = keyed.join(bounded(kept.distinct()), KEY, "left_semi")
    out = (out if unique else out.dropDuplicates([KEY])).select(*docs.columns)
    return out.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark passages."""
    keep = tuple(c for c in docs.columns if c != "doc_id")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=keep)
    return found.filter(~decontaminate.contaminated()).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_alike),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again for the next, what else was stored goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with tidied(spark, *(n for n, _ in STAGES)):
            docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
