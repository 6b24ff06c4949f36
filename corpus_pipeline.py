"""From raw documents to packed sequences: five stages of the training-data operators.

Each stage takes all rows that its predecessor kept, is written as Parquet to the shared
folder and read back as the input of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstream.llm import decontaminate, language, line_dedup, near_pages, packing, set_join
from fieldstream.llm.common import documents, keep, maybe_broadcast, third
from fieldstream.llm.queries import vocabulary

#: SQL has no word for the learned language, the fingerprints and the packing.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; ``und`` and the least sure ones go."""
    model = language.train(docs.where(third("doc_id") != 1))
    return language.recognised(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that much of their source repeats.

    Near copies count once, so that the next stage finds them whole and keeps one.
    """
    out = line_dedup.drop_boilerplate(docs, dropped_col="__lines_dropped", near=near_pages.link)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__lines_dropped") > 0, F.length("text"))
                             .otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the one with the least id.

    Texts without words and rows without an id stay. Rows that share an id are one document:
    it goes when one of its texts is in a group with a lesser id, else one row of it stays.
    """
    groups = keep(set_join.link(docs).where(F.col("doc_id").isNotNull())
                  .groupBy(F.col("doc_id").alias("__id"))
                  .agg(F.min("component_id").alias("least"), F.count("*").alias("rows")),
                  "groups")
    gone = groups.where(F.col("least") < F.col("__id")).select("__id")
    kept = docs.join(maybe_broadcast(gone, gone.count()), F.col("doc_id") == F.col("__id"),
                     "left_anti")
    again = groups.where((F.col("rows") > 1) & (F.col("least") == F.col("__id"))).select("__id")
    if again.limit(1).count():
        repeated = F.col("doc_id") == F.col("__id")
        kept = kept.join(again, repeated, "left_anti").unionByName(
            kept.join(again, repeated, "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece of a document."""
    return packing.pack_documents(docs, vocabulary(), added_tokens=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
