"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm.abuse import abuse_rates, score_documents
from presswerk.llm.batch_dedup import accept_in_turn
from presswerk.llm.boilerplate import boilerplate_lines, main_bodies
from presswerk.llm.byte_bpe import encode_documents
from presswerk.llm.leakage import leaked_documents, without_leaks
from presswerk.llm.near_duplicates import all_pairs, near_duplicate_groups, near_duplicates
from presswerk.llm.repeated_lines import line_templates, repeated_lines, without_repeated_lines
from presswerk.llm.residue import residue_rows
from presswerk.llm.truncation import judge_values, source_limits, truncation_rates
from presswerk.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return judge_values(table(spark, d, "articles")).where("cut").select("row_id", "field").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(judge_values(table(spark, d, "articles")))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    return source_limits(table(spark, d, "articles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates(table(spark, d, "articles"))
    return all_pairs(members, links)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(table(spark, d, "articles"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return boilerplate_lines(articles).join(residue_rows(articles), "row_id", "left_anti")


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    return main_bodies(table(spark, d, "articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return accept_in_turn(table(spark, d, "articles")).where("kept_row_id < row_id").select("kept_row_id", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "articles"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return without_repeated_lines(table(spark, d, "articles"))


def p6_templates(spark: SparkSession, d: str) -> DataFrame:
    return line_templates(table(spark, d, "articles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_rows(table(spark, d, "articles"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("words").alias("longest"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return without_leaks(documents, table(spark, d, "eval_items")).groupBy("source").agg(F.count("*").alias("n_documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), table(spark, d, "abuse_examples")).where("flagged").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(score_documents(table(spark, d, "documents"), table(spark, d, "abuse_examples")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p2_limits": p2_limits,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_texts": p4_texts,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_texts": p6_texts,
    "p6_templates": p6_templates,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

SQL: dict[str, str] = {
    # inline tags, white space and case fold as in the operator; twelve-word windows meet by equality
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z]+>', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p6_found": r"""
WITH l AS (
  SELECT row_id, coalesce(source, '') AS source, i AS line_no,
         lower(regexp_replace(regexp_replace(trim(regexp_replace(x[i], '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')), '\d+', '0', 'g'), '^ | $', '', 'g')) AS k
  FROM (SELECT row_id, source, x, unnest(range(1, len(x) + 1)) AS i
        FROM (SELECT row_id, source, string_split(extracted_text, chr(10)) AS x FROM articles WHERE extracted_text IS NOT NULL))),
t AS (SELECT coalesce(source, '') AS source, count(*) AS total FROM articles WHERE extracted_text IS NOT NULL GROUP BY 1),
o AS (SELECT l.source, k FROM l JOIN t USING (source) WHERE k <> '' GROUP BY l.source, k, total
      HAVING count(DISTINCT row_id) >= 5 AND count(DISTINCT row_id) >= 0.02 * total)
SELECT row_id, CAST(line_no AS BIGINT) AS line_no FROM l JOIN o USING (source, k)""",
}
SQL["p9_clean"] = f"SELECT source, count(*) AS n_documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({SQL['p9_found']})) GROUP BY 1"
