"""p1, p4, p7, p8 and p9 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.code_provenance import code_provenance
from codeweft.llm.doc_pairs import doc_pairs
from codeweft.llm.leakage import leak_pairs, leaks, remove_leaks
from codeweft.llm.mixing import mix, shares
from codeweft.llm.text_quality import prose_verdicts, text_quality
from codeweft.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs(table(spark, d, "source_files")).select("file_id", "line_no", "func_name").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs(table(spark, d, "source_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return code_provenance(table(spark, d, "source_files"), table(spark, d, "nodes")).where("kind <> 'hand'").select("file_id")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return code_provenance(table(spark, d, "source_files"), table(spark, d, "nodes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Per item and suite: affected documents and the longest run of words found."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.item_id", "i.longest")
    items = table(spark, d, "eval_items").select("item_id", "suite").distinct()
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("longest").alias("longest_run")).join(items, "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return prose_verdicts(table(spark, d, "documents")).where("not is_prose").select("doc_id").distinct()


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p4_found, p4_files, p7_found, p7_leaks, p7_clean, p8_mix, p8_shares, p9_found, p9_stats)}

_P7 = """
WITH iw AS (
  SELECT item_id, suite, string_split(lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')), ' ') AS w FROM eval_items
), dw AS (
  SELECT doc_id, string_split(lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')), ' ') AS w FROM documents WHERE text IS NOT NULL
), ig AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)
), dg AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)
)"""

SQL = {"p7_found": _P7 + " SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"}
