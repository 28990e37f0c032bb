"""Always and Never lists: effective lists, their differences, and their effect on detections.

Defined cases: null keys and texts match nothing and stay; an entry on both lists of a case is kept twice; repeated entries count once; of equal
revisions the greater key wins; empty lists change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.mapping import normalization_key
from spanloom.operators.recognizers import EMAIL_DETECT_SQL, email_detect
from spanloom.sources.tables import table


def effective(case: DataFrame, user: DataFrame) -> DataFrame:
    """The case's entries (list, key), and the user's unless the case has the key on either list."""
    return case.unionByName(user.join(case.select("key"), "key", "left_anti").select(case.columns))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select("p_partkey", normalization_key(F.col("p_name")).alias("key"))
    case = parts.where("p_partkey % 40 = 3").select(F.lit("always").alias("list"), "key").distinct()
    user = parts.where("p_partkey % 30 = 1").select(F.lit("never").alias("list"), "key").distinct()
    return case, user


_CASE = "(SELECT DISTINCT 'always' AS list, lower(p_name) AS key FROM part WHERE p_partkey % 40 = 3)"
_USER = "(SELECT DISTINCT 'never' AS list, lower(p_name) AS key FROM part WHERE p_partkey % 30 = 1)"


def effective_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective(*_lists(spark, sf_dir))


EFFECTIVE_SQL = f"SELECT * FROM {_CASE} UNION ALL SELECT * FROM {_USER} u WHERE key NOT IN (SELECT key FROM {_CASE})"


def list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new version of a list removes and adds; removals come first when it is applied."""
    case, user = (x.select("key") for x in _lists(spark, sf_dir))
    return case.exceptAll(user).select("key", F.lit("removed").alias("change"), F.lit(0).alias("step")).unionByName(user.exceptAll(case).select("key", F.lit("added").alias("change"), F.lit(1).alias("step")))


LIST_DIFF_SQL = f"SELECT key, 'removed' AS change, 0 AS step FROM {_CASE} c WHERE key NOT IN (SELECT key FROM {_USER}) UNION ALL SELECT key, 'added', 1 FROM {_USER} u WHERE key NOT IN (SELECT key FROM {_CASE})"


def never_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections without those whose wording is on the Never list (addresses at mail1 and mail3)."""
    found = email_detect(spark, sf_dir).withColumn("key", normalization_key(F.col("value")))
    never = found.where(F.col("key").rlike("@mail[13][.]")).select("key").distinct()
    return found.join(never, "key", "left_anti").select("doc_id", "start_cp", "value")


NEVER_SQL = f"SELECT doc_id, start_cp, value FROM ({EMAIL_DETECT_SQL}) WHERE NOT regexp_matches(lower(value), '@mail[13][.]')"


def always_mentions(docs: DataFrame, wordings: DataFrame) -> DataFrame:
    """Mentions of listed wordings (any number of words, in any case) as whole words; word_no counts from 0.

    Wordings meet the texts by their first word, an equi join, and are then compared as a slice of the document's words; a longer
    list costs more only where first words agree. Wordings without a letter or digit match nothing.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    listed = wordings.select("key").distinct().select("key", split("key").alias("want")).where(F.size("want") > 0).withColumn("w", F.get("want", F.lit(0)))
    longest = listed.agg(F.max(F.size("want"))).first()[0] or 1  # one number
    ahead = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws)), lambda k: F.struct((k - 1).alias("word_no"), F.get(ws, k - 1).alias("w"), F.slice(ws, k, F.lit(longest)).alias("ahead")))
    texts = docs.select("doc_id", split("text").alias("ws")).where(F.size("ws") > 0)
    tokens = texts.select("doc_id", F.inline(ahead(F.col("ws"))))
    return tokens.join(listed, "w").where(F.slice("ahead", F.lit(1), F.size("want")) == F.col("want")).select("doc_id", "word_no", "key")


def always_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in ("moron", "that in", "que la", "der die", "worthless", "all rights reserved", "of the of the")], "key string")
    return always_mentions(table(spark, sf_dir, "documents"), listed)


ALWAYS_SQL = r"""
WITH t AS (SELECT doc_id, unnest(w) AS w, (generate_subscripts(w, 1) - 1)::INTEGER AS word_no FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)),
g AS (SELECT doc_id, word_no, w, w || ' ' || lead(w) OVER o AS g, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS h, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS i FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY word_no))
SELECT doc_id, word_no, w AS key FROM g WHERE w IN ('moron', 'worthless') UNION ALL SELECT doc_id, word_no, g FROM g WHERE g IN ('that in', 'que la', 'der die')
UNION ALL SELECT doc_id, word_no, h FROM g WHERE h = 'all rights reserved' UNION ALL SELECT doc_id, word_no, i FROM g WHERE i = 'of the of the'
"""


def public_host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host, and no domain above it, is public (example.net here): each host's domains meet the list."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("host"))
    parts = F.split("host", "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    public = spark.createDataFrame([("example.net",), ("spam-farm.example.org",)], "domain string")
    listed = pages.select("page_id", F.explode(domains).alias("domain")).join(public, "domain", "left_semi")
    return pages.join(listed, "page_id", "left_anti")


PUBLIC_HOST_SQL = "SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages) WHERE NOT regexp_matches(host, '(^|[.])(example[.]net|spam-farm[.]example[.]org)$')"


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest revision per key wins; an older write that comes later changes nothing (a user's last order by date)."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey", "o_orderstatus")


LATEST_SQL = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"

QUERIES = [
    ("effective_lists", effective_lists, EFFECTIVE_SQL), ("list_diff", list_diff, LIST_DIFF_SQL), ("never_antijoin", never_antijoin, NEVER_SQL), ("always_semijoin", always_semijoin, ALWAYS_SQL),
    ("public_host_filter", public_host_filter, PUBLIC_HOST_SQL), ("latest_revision", latest_revision, LATEST_SQL),
]
