"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstream.llm import (
    decontaminate,
    hard_negatives,
    host_rules,
    language,
    line_dedup,
    neighbours,
    packing,
    page_text,
    passages,
    set_join,
    token_file,
    toxicity,
    whitening,
)
from fieldstream.llm.common import documents, third

Query = Callable[[SparkSession, str], DataFrame]


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(documents(spark, sf_dir)).drop("version", "removed")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(third("doc_id") != 1))
    return language.identify(docs, model).select(
        "doc_id", (third("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs.where(third("doc_id") != 1),
                           labels.where(third("doc_id") != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (third("doc_id") == 1).alias("held_out"), "score", "predicted")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_bad", "kept")


OP5_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT r, doc_id, source, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), wins AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM parts WHERE len(w) >= 5
), grams AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g FROM wins
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), cover AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY r
), m AS (
  SELECT p.r, doc_id, source, len(w) AS n_words,
         length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM parts p LEFT JOIN cover USING (r)
), f AS (
  SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2,
         100 * n_symbols > 10 * word_chars AS f3, 100 * n_dup_lines > 30 * n_lines AS f4,
         word_chars < 2 * n_words OR word_chars > 15 * n_words AS f5 FROM m
), h AS (
  SELECT source, count(*) AS n, unnest([
           {'rule': 1, 'k': sum(f1::INT)}, {'rule': 2, 'k': sum(f2::INT)},
           {'rule': 3, 'k': sum(f3::INT)}, {'rule': 4, 'k': sum(f4::INT)},
           {'rule': 5, 'k': sum(f5::INT)}], recursive := true) FROM f GROUP BY source
), prior AS (
  SELECT rule, avg(k / n) AS mean, var_pop(k / n) AS v FROM h GROUP BY rule
), strength AS (
  SELECT rule, mean, CASE WHEN v > 0
         THEN greatest(0.0, least(1000.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS s
  FROM prior
), bad AS (
  SELECT source, max((k + s * mean) / (n + s)) > 0.6 AS host_bad
  FROM h JOIN strength USING (rule) GROUP BY source
)
SELECT f.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, f1 OR f2 AS base_failed, host_bad,
       NOT (f1 OR f2) AND NOT host_bad AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""


def vocabulary() -> str:
    """The vocabulary file of the public byte-level BPE that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary(), added_tokens=True)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir),
                              spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.link(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_dedup.drop_boilerplate(docs).select(
        "doc_id", F.col("lines_dropped").cast("long").alias("lines_dropped"), "text")


OP9_SQL = r"""
WITH lines AS (
  SELECT source, text, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), seen AS (
  SELECT source, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
         count(DISTINCT text) AS pages FROM lines GROUP BY ALL
), host AS (
  SELECT source, count(DISTINCT text) AS host_pages FROM documents GROUP BY source
), bad AS (
  SELECT s.source, list(line) AS bad FROM seen s JOIN host h
    ON s.source IS NOT DISTINCT FROM h.source
  WHERE line <> '' AND pages >= 5 AND pages > 0.08 * host_pages GROUP BY s.source
), split AS (
  SELECT doc_id, text, coalesce(bad, []) AS bad, string_split(text, chr(10)) AS l
  FROM documents d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source
), cut AS (
  SELECT doc_id, text, l, list_filter(l, lambda x: NOT list_contains(
           bad, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS k FROM split
)
SELECT doc_id, coalesce(len(l) - len(k), 0)::BIGINT AS lines_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(k, chr(10)) END AS text
FROM cut
"""

def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.store_and_read(documents(spark, sf_dir), vocabulary(), added_tokens=True)



def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir).withColumn("label", label),
                               F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir)).withColumn(
        "deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Query] = {
    "op1_page_text": op1_page_text,
    "op2_passages": op2_passages,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_host_rules": op5_host_rules,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_set_join": op8_set_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_file": op10_token_file,
    "op11_neighbours": op11_neighbours,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op5_host_rules": OP5_SQL,
    "op9_line_dedup": OP9_SQL,
}
