"""Shapes that a category's spans must have, proposals after all filters, statuses of scored texts, aliases beside machine-readable marks, and
identities taken out and in.

Defined cases: a category without a shape lets everything pass; null values have no shape; texts without flaws count as clean; empty
tables give empty results; repeated rows count once in proposals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import find_spans
from spanloom.operators.evaluation import COMPARISON_SQL, _compared
from spanloom.operators.filters import context_spans
from spanloom.operators.review import known_mentions
from spanloom.operators.rewrite import CATEGORIES
from spanloom.sources.tables import table


@dataclass(frozen=True)
class Shape:
    """What a category's value must match (require), must not (forbid), what must not stand just before it (forbid_before), how many
    letters and digits it needs, and a label before it that lifts all that."""

    require: str = ""
    forbid: str = ""
    forbid_before: str = ""
    least: int = 1
    lifted_by: str = ""


#: Shapes of our own; a host adds or replaces them.
SHAPES = {
    "PERSON": Shape(require=r"\p{Lu}", forbid=r"[0-9@]", least=2),
    "PHONE": Shape(require=r"^\+?[0-9 ()./-]+$", least=7, forbid_before=r"[$€£]\s*$", lifted_by=r"(?iu)(?:tel|phone)[.:]?\s*$"),
    "TAX": Shape(require=r"^[0-9]{10}(?:[0-9]{2})?$"),
    "CASE": Shape(require=r"[0-9].*[0-9]", forbid=r"^[0-9]+$", lifted_by=r"(?iu)case\s*(?:no\.?)?\s*$"),
    "DATE": Shape(require=r"[0-9]{4}|[0-9]{1,2}[./-][0-9]{1,2}"),
}


def shaped(value: Column, category: Column, before: Column, shapes: dict[str, Shape] | None = None) -> Column:
    """Whether a span has its category's shape."""
    result = F.lit(True)
    for name, shape in (SHAPES if shapes is None else shapes).items():
        code = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
        ok = (code >= shape.least) & (value.rlike(shape.require) if shape.require else F.lit(True)) & ~(value.rlike(shape.forbid) if shape.forbid else F.lit(False)) & ~(before.rlike(shape.forbid_before) if shape.forbid_before else F.lit(False))
        lifted = before.rlike(shape.lifted_by) if shape.lifted_by else F.lit(False)
        result = F.when(category == name, F.coalesce(ok | lifted, F.lit(False))).otherwise(result)
    return result


def shape_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in texts made from orders, taken for a phone, a tax number and a case each: which have the shape."""
    text = F.concat(F.lit("tel: 12 and $ "), F.col("o_orderkey"), F.lit("5551234 or case no. 77, then "), F.lpad(F.col("o_orderkey").cast("string"), 10, "7"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    spans = context_spans(docs, "[0-9]+").select("*", F.explode(F.array(*[F.lit(c) for c in ("PHONE", "TAX", "CASE", "OTHER")])).alias("category"))
    return spans.where(shaped(F.col("value"), F.col("category"), F.col("before"))).select("doc_id", "value", "category")


SHAPE_SQL = """
WITH v AS (SELECT o_orderkey AS k, o_orderkey || '5551234' AS m, lpad(o_orderkey::VARCHAR, 10, '7') AS t FROM orders)
SELECT k AS doc_id, '12' AS value, unnest(['PHONE', 'OTHER']) AS category FROM v UNION ALL SELECT k, m, unnest(CASE WHEN length(m) IN (10, 12) THEN ['TAX', 'OTHER'] ELSE ['OTHER'] END) FROM v
UNION ALL SELECT k, '77', unnest(['CASE', 'OTHER']) FROM v UNION ALL SELECT k, t, unnest(['PHONE', 'TAX', 'OTHER']) FROM v
"""


def proposals(spans: DataFrame) -> DataFrame:
    """What is proposed of a text's detections (doc_id, start_cp, end_cp, value, category, before, ...): those with their shape, each once, in
    order: place counts from 1 in a document."""
    from pyspark.sql import Window

    kept = spans.where(shaped(F.col("value"), F.col("category"), F.col("before"))).select("doc_id", "start_cp", "end_cp", "value", "category").distinct()
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_cp", F.desc("end_cp"), "category")))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored documents by status: clean, or what flaws they have; and by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    flaws = _compared(spark, sf_dir).where("result <> 'hit'").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("result")), "+").alias("status"))
    return docs.join(flaws, "doc_id", "left").groupBy("lang", F.coalesce("status", F.lit("clean")).alias("status")).agg(F.count("*").alias("n"))


STATUS_SQL = f"""
WITH f AS (SELECT doc_id, string_agg(result, '+' ORDER BY result) AS status FROM (SELECT DISTINCT doc_id, result FROM ({COMPARISON_SQL}) WHERE result <> 'hit') GROUP BY 1)
SELECT coalesce(lang, '') AS lang, coalesce(status, 'clean') AS status, count(*) AS n FROM documents LEFT JOIN f USING (doc_id) GROUP BY 1, 2
"""

#: An alias in a machine-readable zone: fillers beside it, and its check digit may follow without a gap.
GLUED = r"(?<![A-Z0-9_])(?:" + "|".join(CATEGORIES) + r")_[0-9]{1,10}(?=<|[A-Z]{3}[0-9])"


def glued_aliases(docs: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Aliases in machine-readable zones, told from the check digit behind them by which are known (key, alias): key, start_cp, alias,
    check. If both readings are known, the longer one is meant."""
    found = docs.where(F.col("text").contains("<")).select(key, F.inline(find_spans(F.col("text"), GLUED))).select(key, F.col("start").alias("start_cp"), F.col("text").alias("token"))
    shorter = F.expr("substring(token, 1, length(token) - 1)")
    readings = found.select(key, "start_cp", F.explode(F.array(F.struct(F.col("token").alias("alias"), F.lit("").alias("check")), F.struct(shorter.alias("alias"), F.substring("token", -1, 1).alias("check")))).alias("r")).select(key, "start_cp", "r.*")
    best = readings.where("alias rlike '_[0-9]+$'").join(known.select(key, "alias").distinct(), [key, "alias"]).groupBy(key, "start_cp").agg(F.max_by(F.struct("alias", "check"), F.length("alias")).alias("b"))
    return best.select(key, "start_cp", "b.*")


def exact_aliases(tokens: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of a text's tokens (key, token) those that are a known alias as written (key, alias, previous): key, token, state: current or
    earlier."""
    names = known.select(key, F.col("alias").alias("token"), F.lit("current").alias("state")).unionByName(known.select(key, F.explode("previous").alias("token"), F.lit("earlier").alias("state")))
    return tokens.select(key, "token").distinct().join(names.groupBy(key, "token").agg(F.min("state").alias("state")), [key, "token"])


def zone_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases with a check digit behind them in zones made from customers, and which of their tokens are known as written."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("P<UTOPERSON_"), k, F.lit("<<\nIDENTITY_1"), k % 10, F.lit("UTO69<\nas PERSON_"), k, F.lit(" said"))
    docs = table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))
    known = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("PERSON_"), "doc_id"), F.lit("IDENTITY_1"), F.lit("IDENTITY_14"))).alias("alias"), F.array(F.lit("PERSON_0")).alias("previous"))
    zones = glued_aliases(docs, known).select("doc_id", F.concat_ws("/", "alias", "check").alias("found"))
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Z])PERSON_[0-9]+(?= )"), F.lit(0))).alias("token"))
    return zones.unionByName(exact_aliases(tokens, known).select("doc_id", F.concat_ws(":", "token", "state").alias("found")))


#: In the first line the letters before the alias belong to the zone, so it is none.
ZONE_ALIASES_SQL = """
SELECT c_custkey AS doc_id, unnest([CASE WHEN c_custkey % 10 = 4 THEN 'IDENTITY_14/' ELSE 'IDENTITY_1/' || (c_custkey % 10) END, 'PERSON_' || c_custkey || ':current']) AS found FROM customer
"""


def exported(case: DataFrame) -> DataFrame:
    """Identities as JSON, one to a row: case_id, identity. Forgotten ones keep their names only."""
    return case.select("case_id", F.to_json(F.struct("pos", "alias", "previous", "category", "originals")).alias("identity"))


IDENTITY = "pos bigint, alias string, previous array<string>, category string, originals array<string>"


def seeded(rows: DataFrame) -> DataFrame:
    """The identities that exported wrote; rows that are no identity are left out."""
    return rows.select("case_id", F.from_json("identity", IDENTITY).alias("i")).where("i.alias is not null").select("case_id", "i.*")


def seed_documents(docs: DataFrame, case: DataFrame) -> DataFrame:
    """Mentions of a case's wordings in documents (doc_id, case_id, text) that join it, with the case's aliases: proposed as they stand."""
    wordings = case.select("case_id", F.explode("originals").alias("wording"), "alias")
    return known_mentions(docs, wordings, "case_id")


def case_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as identities of their region's case, written and read again; texts made from customers' nations meet them."""
    n = table(spark, sf_dir, "nation")
    case = n.select(F.col("n_regionkey").alias("case_id"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("ORG_"), "n_nationkey").alias("alias"), F.array().cast("array<string>").alias("previous"), F.lit("ORG").alias("category"), F.when(F.col("n_nationkey") % 6 != 0, F.array(F.lower("n_name"))).otherwise(F.array().cast("array<string>")).alias("originals"))
    docs = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc_id"), F.col("n_regionkey").alias("case_id"), F.concat(F.lit("From "), F.initcap("n_name"), F.lit(", not "), "n_name", F.lit("x.")).alias("text"))
    return seed_documents(docs, seeded(exported(case)))


SEEDING_SQL = "SELECT c_custkey AS doc_id, 5 AS start_cp, (5 + length(n_name))::INTEGER AS end_cp, upper(n_name[1]) || lower(substring(n_name, 2)) AS value, 'ORG_' || n_nationkey AS alias FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 6 <> 0"

QUERIES = [("shape_filter", shape_filter, SHAPE_SQL), ("status_counts", status_counts, STATUS_SQL), ("zone_aliases", zone_aliases, ZONE_ALIASES_SQL), ("case_seeding", case_seeding, SEEDING_SQL)]
