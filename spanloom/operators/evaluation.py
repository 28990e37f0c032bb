"""Scoring proposals against annotated texts.

Defined cases: repeated spans count once; null ids meet nothing; a gold span that several proposals overlap is one boundary error; with nothing to
divide by a share is null; texts without marks have no gold; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import find_spans, replace_spans
from spanloom.operators.recognizers import EMAIL, EMAIL_SQL_PATTERN, IP, sql_spans
from spanloom.sources.tables import table

OPEN, CLOSE = "⟦", "⟧"
GOLD = f"{OPEN}[A-Z]+\\|[^{CLOSE}]*{CLOSE}"


def annotate(text: Column, spans: Column) -> Column:
    """text with each sorted, disjoint span (start, end, text, category) written as ⟦CATEGORY|text⟧."""
    return replace_spans(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(OPEN), s["category"], F.lit("|"), s["text"], F.lit(CLOSE)).alias("alias"))))


def strip_gold(text: Column) -> Column:
    """(text, spans) of an annotated text: marks removed, spans moved to where their text then stands."""
    marks = find_spans(text, GOLD)
    category = lambda m: F.regexp_extract(m["text"], f"^{OPEN}([A-Z]+)\\|", 1)
    value = lambda m: F.regexp_extract(m["text"], f"\\|([^{CLOSE}]*){CLOSE}$", 1)
    kind = "array<struct<start:int,end:int,text:string,category:string>>"

    def step(s: Column, m: Column) -> Column:
        at = (m["start"] - s["gone"]).cast("int")
        one = F.struct(at.alias("start"), (at + F.length(value(m))).cast("int").alias("end"), value(m).alias("text"), category(m).alias("category"))
        return F.struct((s["gone"] + F.length(m["text"]) - F.length(value(m))).cast("int").alias("gone"), F.concat(s["out"], F.array(one)).alias("out"))

    spans = F.aggregate(marks, F.struct(F.lit(0).alias("gone"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])
    plain = F.regexp_replace(text, f"{OPEN}[A-Z]+\\|([^{CLOSE}]*){CLOSE}", "$1")
    return F.struct(plain.alias("text"), spans.alias("spans"))


def _categorised(spans: Column, category: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(category).alias("category")))


def gold_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses annotated, then stripped again: the text and the spans come back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _categorised(find_spans(F.col("text"), EMAIL), "EMAIL").alias("spans"))
    marked = docs.withColumn("marked", annotate(F.col("text"), F.col("spans")))
    back = marked.withColumn("back", strip_gold(F.col("marked")))
    return back.select("doc_id", F.length("marked").alias("n_marked"), F.size("back.spans").alias("n_spans"), (F.col("back.text") == F.col("text")).alias("same_text"), (F.col("back.spans") == F.col("spans")).alias("same_spans"))


GOLD_SQL = f"SELECT doc_id, (length(text) + 8 * coalesce(n, 0))::INTEGER AS n_marked, coalesce(n, 0)::INTEGER AS n_spans, true AS same_text, true AS same_spans FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM {sql_spans(EMAIL_SQL_PATTERN)} GROUP BY 1) USING (doc_id)"


def compare(gold: DataFrame, proposed: DataFrame) -> DataFrame:
    """hit, boundary, miss or false hit for every span of both (doc_id, start_cp, end_cp, category, value).

    Exact range and category is a hit (a full outer join). Of the rest a gold span is a boundary error if a proposal
    overlaps it, else a miss; a proposal that overlaps no gold span is a false hit.
    """
    keys = ["doc_id", "start_cp", "end_cp", "category"]
    g, p = gold.select(*keys, "value").distinct(), proposed.select(*keys, "value").distinct()
    hits = g.join(p.select(keys), keys, "left_semi").select(*keys, "value", F.lit("hit").alias("result"))
    g, p = g.join(hits.select(keys), keys, "left_anti"), p.join(hits.select(keys), keys, "left_anti")
    x, y = g.alias("x"), p.alias("y")
    meets = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.start_cp") < F.col("y.end_cp")) & (F.col("y.start_cp") < F.col("x.end_cp"))
    named = lambda df, side, result: df.select(*[F.col(f"{side}.{k}") for k in [*keys, "value"]], F.lit(result).alias("result"))
    return hits.unionByName(named(x.join(y, meets, "left_semi"), "x", "boundary")).unionByName(named(x.join(y, meets, "left_anti"), "x", "miss")).unionByName(named(y.join(x, meets, "left_anti"), "y", "false"))


def _spans(docs: DataFrame, pattern: str, category: str) -> DataFrame:
    return docs.select("doc_id", F.inline(find_spans(F.col("text"), pattern))).select("doc_id", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("value"), F.lit(category).alias("category"))


LOOSE_EMAIL, LOOSE_IP = r"[A-Za-z0-9.]+@[A-Za-z0-9]+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gold = _spans(docs, EMAIL, "EMAIL").unionByName(_spans(docs, IP, "X-IP"))
    return compare(gold, _spans(docs, LOOSE_EMAIL, "EMAIL").unionByName(_spans(docs, LOOSE_IP, "X-IP")))


def span_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("doc_id", "start_cp", "end_cp", "category", "value", "result")


_GOLD = f"(SELECT doc_id, start_cp, end_cp, value, 'EMAIL' AS category FROM {sql_spans(EMAIL_SQL_PATTERN)} UNION ALL SELECT doc_id, start_cp, end_cp, value, 'X-IP' FROM {sql_spans('[0-9.]*[0-9]')} WHERE regexp_matches(value, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$'))"
_PROPOSED = f"(SELECT doc_id, start_cp, end_cp, value, 'EMAIL' AS category FROM {sql_spans(LOOSE_EMAIL)} UNION ALL SELECT doc_id, start_cp, end_cp, value, 'X-IP' FROM {sql_spans(LOOSE_IP)})"
COMPARISON_SQL = f"""
WITH g AS (SELECT DISTINCT * FROM {_GOLD}), p AS (SELECT DISTINCT * FROM {_PROPOSED}), h AS (SELECT * FROM g INTERSECT SELECT * FROM p),
gr AS (SELECT * FROM g EXCEPT SELECT * FROM h), pr AS (SELECT * FROM p EXCEPT SELECT * FROM h)
SELECT doc_id, start_cp, end_cp, category, value, 'hit' AS result FROM h
UNION ALL SELECT doc_id, start_cp, end_cp, category, value, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.doc_id = gr.doc_id AND pr.start_cp < gr.end_cp AND gr.start_cp < pr.end_cp) THEN 'boundary' ELSE 'miss' END FROM gr
UNION ALL SELECT doc_id, start_cp, end_cp, category, value, 'false' FROM pr WHERE NOT EXISTS (SELECT 1 FROM gr WHERE pr.doc_id = gr.doc_id AND pr.start_cp < gr.end_cp AND gr.start_cp < pr.end_cp)
"""


def scoreboard(compared: DataFrame, docs: DataFrame) -> DataFrame:
    """Per language, category and source, with totals: distinct wordings per document found, missed and falsely proposed; recall
    and precision in whole hundredths (null where there is nothing to divide by)."""
    rows = compared.select("doc_id", "category", "value", "result").distinct().join(docs.select("doc_id", "lang", "source"), "doc_id")
    gold, proposed, right = F.col("result") != "false", F.col("result").isin("hit", "false"), F.col("result") == "hit"
    sets = rows.groupingSets([["lang", "category", "source"], ["lang"], []], "lang", "category", "source")
    counted = sets.agg(F.count_if(gold).alias("n_gold"), F.count_if(right).alias("n_found"), F.count_if(proposed).alias("n_proposed"), F.grouping_id().cast("int").alias("level"))
    share = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN CAST({a} * 100 DIV {b} AS BIGINT) END")
    return counted.withColumn("recall", share("n_found", "n_gold")).withColumn("precision", share("n_found", "n_proposed"))


def detection_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard(_compared(spark, sf_dir), table(spark, sf_dir, "documents"))


SCOREBOARD_SQL = f"""
WITH r AS (SELECT DISTINCT doc_id, category, value, result, lang, source FROM ({COMPARISON_SQL}) JOIN documents USING (doc_id)),
s AS (SELECT lang, category, source, count(*) FILTER (WHERE result <> 'false') AS n_gold, count(*) FILTER (WHERE result = 'hit') AS n_found, count(*) FILTER (WHERE result IN ('hit', 'false')) AS n_proposed, GROUPING(lang, category, source)::INTEGER AS level
  FROM r GROUP BY GROUPING SETS ((lang, category, source), (lang), ()))
SELECT *, CASE WHEN n_gold > 0 THEN n_found * 100 // n_gold END AS recall, CASE WHEN n_proposed > 0 THEN n_found * 100 // n_proposed END AS precision FROM s
"""


def label_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents per language and source with totals (grouping sets)."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("quality").alias("n_good"), F.sum("toxic").alias("n_toxic"))


LABEL_SCOREBOARD_SQL = "SELECT lang, source, count(*) AS n, sum(quality)::BIGINT AS n_good, sum(toxic)::BIGINT AS n_toxic FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, source), (lang), ())"


def verdict_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded flaws against new ones as multisets: lines gone and lines new, with how often (each kind's false hits, one run
    with every source, one without src0)."""
    found = _compared(spark, sf_dir).where("result <> 'hit'").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    line = F.concat_ws(" ", "result", "category")
    recorded, now = found.where("source <> 'src1'").select(line.alias("line")), found.where("source <> 'src0'").select(line.alias("line"))
    diff = lambda a, b, name: a.exceptAll(b).groupBy("line").agg(F.count("*").alias("n")).withColumn("change", F.lit(name))
    return diff(recorded, now, "gone").unionByName(diff(now, recorded, "new"))


VERDICT_SQL = f"""
WITH f AS (SELECT result || ' ' || category AS line, source FROM ({COMPARISON_SQL}) JOIN documents USING (doc_id) WHERE result <> 'hit'),
a AS (SELECT line FROM f WHERE source <> 'src1'), b AS (SELECT line FROM f WHERE source <> 'src0')
SELECT line, count(*) AS n, 'gone' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1 UNION ALL SELECT line, count(*), 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY 1
"""


def stale_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model entities against recomputed ones: rows that miss on one side or whose score moved by over 0.05.

    Snapshots go through JSON and back, as they are stored.
    """
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 100 / F.lit(100.0)).alias("score"))
    stored = v.where("vec_id % 7 <> 0").select(F.to_json(F.struct("vec_id", "label", "score")).alias("j")).select(F.from_json("j", "vec_id bigint, label int, score double").alias("e")).select("e.*")
    now = v.where("vec_id % 11 <> 0").withColumn("score", F.when(F.col("vec_id") % 13 == 0, F.col("score") + 0.1).otherwise(F.col("score") + 0.01))
    both = stored.alias("s").join(now.alias("n"), ["vec_id", "label"], "full")
    state = F.when(F.col("n.score").isNull(), "gone").when(F.col("s.score").isNull(), "new").when(F.abs(F.col("s.score") - F.col("n.score")) > 0.05, "moved")
    return both.select("vec_id", "label", state.alias("state")).where("state IS NOT NULL")


STALE_SQL = """
SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 THEN 'gone' WHEN vec_id % 7 = 0 THEN 'new' ELSE 'moved' END AS state FROM embeddings
WHERE NOT (vec_id % 7 = 0 AND vec_id % 11 = 0) AND (vec_id % 11 = 0 OR vec_id % 7 = 0 OR vec_id % 13 = 0)
"""


def model_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which languages a proposer may be listed for: recall of 90 and precision of at least 84 among those with gold spans."""
    board = detection_scoreboard(spark, sf_dir).where("lang IS NOT NULL AND category IS NULL")
    return board.select("lang", "n_gold", F.coalesce((F.col("recall") >= 90) & (F.col("precision") >= 84), F.lit(False)).alias("listed"))


MODEL_VERDICT_SQL = f"SELECT lang, n_gold, coalesce(recall >= 90 AND precision >= 84, false) AS listed FROM ({SCOREBOARD_SQL}) WHERE lang IS NOT NULL AND category IS NULL"

QUERIES = [
    ("gold_round_trip", gold_round_trip, GOLD_SQL), ("span_comparison", span_comparison, COMPARISON_SQL), ("detection_scoreboard", detection_scoreboard, SCOREBOARD_SQL), ("label_scoreboard", label_scoreboard, LABEL_SCOREBOARD_SQL),
    ("verdict_diff", verdict_diff, VERDICT_SQL), ("stale_snapshot", stale_snapshot, STALE_SQL), ("model_verdict", model_verdict, MODEL_VERDICT_SQL),
]
