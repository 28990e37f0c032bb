"""Choosing among spans: overlap, containment, greedy selection, merging, shape.

Defined cases: null spans are none; touching spans don't overlap; equal spans are one after pruning; ties of rank, score and length go to the earlier
start; documents without spans give none; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import find_spans, greedy_select, merge_ranges
from spanloom.operators.recognizers import rule_spans, sql_spans
from spanloom.sources.tables import table

NUMBER = "[0-9]+"
CHAIN = r"[0-9][0-9. -]*[0-9]"


def numeric_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families of spans that overlap: runs of digits, and runs of digits with separators."""
    docs = table(spark, sf_dir, "documents")
    one = docs.select("doc_id", F.inline(find_spans(F.col("text"), NUMBER))).withColumn("family", F.lit("number"))
    two = docs.select("doc_id", F.inline(find_spans(F.col("text"), CHAIN))).withColumn("family", F.lit("chain"))
    return one.unionByName(two).select("doc_id", "family", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("value"))


NUMERIC_SQL = f"SELECT doc_id, 'number' AS family, start_cp, end_cp, value FROM {sql_spans(NUMBER)} UNION ALL SELECT doc_id, 'chain', start_cp, end_cp, value FROM {sql_spans(CHAIN)}"


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spans of the two families that overlap: an equi join on the document, then the range test."""
    s = numeric_spans(spark, sf_dir)
    a, b = s.where("family = 'number'").alias("a"), s.where("family = 'chain'").alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.start_cp") < F.col("b.end_cp")) & (F.col("b.start_cp") < F.col("a.end_cp"))
    return a.join(b, on).select("a.doc_id", F.col("a.start_cp").alias("number_start"), F.col("b.start_cp").alias("chain_start"), F.col("b.end_cp").alias("chain_end"))


OVERLAP_SQL = f"WITH s AS ({NUMERIC_SQL}) SELECT a.doc_id, a.start_cp AS number_start, b.start_cp AS chain_start, b.end_cp AS chain_end FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.family = 'number' AND b.family = 'chain' AND a.start_cp < b.end_cp AND b.start_cp < a.end_cp"


def containment_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that no longer span of the document holds: the furthest end before them tells (no self-join)."""
    s = numeric_spans(spark, sf_dir).select("doc_id", "start_cp", "end_cp", "value").distinct()
    w = Window.partitionBy("doc_id").orderBy("start_cp", F.desc("end_cp")).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("reach", F.max("end_cp").over(w)).where("reach IS NULL OR end_cp > reach").drop("reach")


CONTAINMENT_SQL = f"""
WITH s AS (SELECT DISTINCT doc_id, start_cp, end_cp, value FROM ({NUMERIC_SQL}))
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.start_cp <= s.start_cp AND o.end_cp >= s.end_cp AND (o.start_cp, o.end_cp) <> (s.start_cp, s.end_cp))
"""


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, the union of the spans as maximal ranges."""
    per_doc = numeric_spans(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_cp").alias("start"), F.col("end_cp").alias("end"))).alias("r"))
    return per_doc.select("doc_id", F.inline(merge_ranges(F.col("r")))).select("doc_id", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"))


MERGED_SQL = f"""
WITH s AS (SELECT *, max(end_cp) OVER (PARTITION BY doc_id ORDER BY start_cp, end_cp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT doc_id, start_cp, end_cp FROM ({NUMERIC_SQL}))),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_cp > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_cp, end_cp ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT doc_id, min(start_cp) AS start_cp, max(end_cp) AS end_cp FROM i GROUP BY doc_id, island
"""


def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule detections and weaker model-like proposals (chains of digits): those that stand, per document."""
    docs = table(spark, sf_dir, "documents")
    model = F.transform(
        find_spans(F.col("text"), CHAIN),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit("IDENTITY").alias("category"), F.when(s["end"] - s["start"] > 12, 0.7).otherwise(0.6).alias("score"), F.lit("model").alias("recognizer"), F.lit(False).alias("is_rule")),
    )
    chosen = docs.select("doc_id", F.inline(greedy_select(F.concat(rule_spans(F.col("text")), model))))
    return chosen.select("doc_id", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("value"), "category", "is_rule", "score")


def shape_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of digits by shape: how many digits they hold, and whether they stand as identifiers, cards or addresses."""
    s = numeric_spans(spark, sf_dir).where("family = 'chain'")
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    shape = F.when(F.col("value").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "dotted").when(digits >= 16, "card").when(digits >= 9, "identifier").otherwise("short")
    return s.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.sum(digits).alias("digits"))


SHAPE_SQL = f"""
WITH s AS (SELECT value, length(regexp_replace(value, '[^0-9]', '', 'g')) AS d FROM ({NUMERIC_SQL}) WHERE family = 'chain')
SELECT CASE WHEN regexp_matches(value, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN 'dotted' WHEN d >= 16 THEN 'card' WHEN d >= 9 THEN 'identifier' ELSE 'short' END AS shape, count(*) AS n, sum(d)::BIGINT AS digits FROM s GROUP BY 1
"""

QUERIES = [
    ("overlap_join", overlap_join, OVERLAP_SQL), ("containment_prune", containment_prune, CONTAINMENT_SQL), ("merged_ranges", merged_ranges, MERGED_SQL), ("greedy_selection", greedy_selection, None), ("shape_filters", shape_filters, SHAPE_SQL),
]
