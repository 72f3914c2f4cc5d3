"""Queries of the corpus problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.frequency import marked_terms
from quillspark.llm.lookalike import consistent_text, look_alike_classes, look_alike_pairs
from quillspark.llm.packing import pack_texts
from quillspark.llm.residue import message_templates, residue_ids
from quillspark.llm.sentences import split_sentences
from quillspark.llm.tokens import decode_column, encode_column
from quillspark.session import table


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(table(spark, d, "slots"), "doc_id", "slot", ["lemma", "plain"], "loaded_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where(F.col("verdict").isNotNull()).select("field_name", "term", "verdict")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents"), "doc_id", "text", lang_col="lang").select("doc_id", "start_at", "end_at")


def _looked_at(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    forms = table(spark, d, "wordforms")
    return [("text", table(spark, d, "documents"), "doc_id", "text"), ("orig", forms, "form_id", "orig"), ("plain", forms, "form_id", "plain")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(_looked_at(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_classes(_looked_at(spark, d))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return consistent_text(table(spark, d, "documents"), "doc_id", "text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = decode_column(p6_ids(spark, d), "doc_id", "ids")
    return back.select("doc_id", F.md5("text").alias("text"), F.length("text").alias("n"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    return message_templates(table(spark, d, "documents"), "doc_id", "text")


_TERMS = """
WITH once AS (SELECT doc_id, slot, arg_max(lemma, loaded_at) AS lemma, arg_max(plain, loaded_at) AS plain FROM slots WHERE doc_id IS NOT NULL GROUP BY doc_id, slot),
terms AS (SELECT 'lemma' AS field_name, lemma AS term, doc_id FROM once UNION ALL SELECT 'plain', plain, doc_id FROM once),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM terms WHERE term <> '' GROUP BY 1, 2),
told AS (SELECT *, CASE WHEN occurrences < 5 OR records < 3 THEN 'rare' WHEN records * 10 > (SELECT count(DISTINCT doc_id) FROM slots) THEN 'common' END AS verdict FROM counted)
"""

QUERIES = {"p2_terms": p2_terms, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_containers": p7_containers, "p8_found": p8_found, "p8_templates": p8_templates}

ORACLES = {
    "p2_terms": _TERMS + "SELECT field_name, term, occurrences, records, verdict FROM told",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text, length(coalesce(text, '')) AS n FROM documents",
    "p2_found": _TERMS + "SELECT field_name, term, verdict FROM told WHERE verdict IS NOT NULL",
}
