"""Decisions and edits as event logs: the state of a review is a fold over its ordered events.

Defined cases: an undo with nothing before it does nothing; events with equal order columns come in an arbitrary order, so callers give a full one;
null keys are a log of their own; an edit at a span's edge leaves it; empty logs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.sources.tables import table


def apply_undo(events: DataFrame, key: list[str], order: list[str], kind: str = "kind") -> DataFrame:
    """The decisions that hold: each 'undo' takes back the latest decision before it that isn't taken back yet.

    Read from the end, an undo waits for the next earlier decision: a decision holds if the undos still waiting there are none.
    The number waiting is a running sum that can't fall below zero, that is, the sum less its least value so far.
    """
    step = F.when(F.col(kind) == "undo", 1).otherwise(-1)
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("_s", F.sum(step).over(back))
    summed = summed.withColumn("_low", F.least(F.min("_s").over(back), F.lit(0)))
    before = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    waiting = F.coalesce(F.lag(F.col("_s") - F.col("_low")).over(before), F.lit(0))
    return summed.withColumn("_waiting", waiting).where((F.col(kind) != "undo") & (F.col("_waiting") == 0)).drop("_s", "_low", "_waiting")


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions per user that stand; errors count as undo."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "undo").otherwise(F.col("event_type")).alias("kind"))
    held = apply_undo(events, ["user_id"], ["event_id"])
    return held.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer and priority the last status, and how often it changed."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    seq = table(spark, sf_dir, "orders").withColumn("changed", F.coalesce(F.lag("o_orderstatus").over(w) != F.col("o_orderstatus"), F.lit(False)).cast("int"))
    return seq.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.sum("changed").alias("n_changes"))


LAST_STATE_SQL = """
WITH s AS (SELECT *, coalesce(CASE WHEN lag(o_orderstatus) OVER w <> o_orderstatus THEN 1 ELSE 0 END, 0) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS status, sum(c)::BIGINT AS n_changes FROM s GROUP BY 1, 2
"""


def rebase(spans: Column, edits: Column) -> Column:
    """spans (start, end) after edits (at, removed, inserted), ascending and disjoint: shifted, or dropped where an edit touches one."""

    def moved(s: Column) -> Column:
        before = F.filter(edits, lambda e: e["at"] + e["removed"] <= s["start"])
        shift = F.aggregate(before, F.lit(0), lambda a, e: (a + e["inserted"] - e["removed"]).cast("int"))
        return F.struct((s["start"] + shift).cast("int").alias("start"), (s["end"] + shift).cast("int").alias("end"))

    touched = lambda s: F.exists(edits, lambda e: (e["at"] < s["end"]) & (e["at"] + F.greatest(e["removed"], F.lit(1)) > s["start"]) & ~(e["at"] + e["removed"] <= s["start"]))
    return F.transform(F.filter(spans, lambda s: ~touched(s)), moved)


def rebase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spans per line item moved by an edit of its quantity and one of its line number."""
    q = F.col("l_quantity").cast("int")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(a + 4).alias("end")) for a in (0, 20, 40)])
    edits = F.array(F.struct((q % 10 + 6).alias("at"), F.lit(2).alias("removed"), F.col("l_linenumber").alias("inserted")), F.struct((q % 20 + 30).alias("at"), F.lit(0).alias("removed"), F.lit(5).alias("inserted")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rebase(spans, edits).alias("s"))
    return rows.groupBy("l_linenumber").agg(F.sum(F.size("s")).alias("n_kept"), F.sum(F.aggregate("s", F.lit(0), lambda a, x: a + x["start"])).alias("starts"))


REBASE_SQL = """
WITH r AS (SELECT l_linenumber AS i, l_quantity::INTEGER % 20 + 30 AS at2 FROM lineitem)
SELECT i AS l_linenumber, sum(2 + CASE WHEN at2 < 44 AND at2 + 1 > 40 AND NOT at2 <= 40 THEN 0 ELSE 1 END)::BIGINT AS n_kept,
  sum(0 + 20 + i - 2 + CASE WHEN at2 < 44 AND at2 > 40 THEN 0 ELSE 40 + i - 2 + CASE WHEN at2 <= 40 THEN 5 ELSE 0 END END)::BIGINT AS starts FROM r GROUP BY 1
"""

QUERIES = [("decision_log", decision_log, None), ("last_state", last_state, LAST_STATE_SQL), ("rebase_spans", rebase_spans, REBASE_SQL)]
