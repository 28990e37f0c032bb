"""Identities: keys that link wordings, alias numbers, cases, and hints to merge.

An alias is a category and a number by first appearance. A scope is a document unless a case joins several; numbering
groups by scope and category, after the mentions of a wording have been reduced to its first one, so a hot wording or
document costs one row per task and wording.

Defined cases: a null wording has a null key, which is a key like any other in numbering and meets nothing in joins; mentions at the same place
are numbered in the order of their keys; repeated mentions count each; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.lineage import cut
from spanloom.operators.recognizers import EMAIL_DETECT_SQL, email_detect
from spanloom.sources.tables import table


def normalization_key(value: Column) -> Column:
    """Lower case, quotes alike, white space as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(F.translate(value, "«»“”„", '"""""'), r"\s+", " ")))


def url_key(url: Column) -> Column:
    """An address without scheme, www. and trailing slash; host in lower case, the rest as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://", ""), r"^[Ww]{3}\.", ""), "/+$", "")
    host = F.regexp_extract(bare, "^[^/?#]*", 0)
    return F.concat(F.lower(host), F.substring(bare, F.length(host) + 1, F.length(bare)))


def spelling_key(value: Column) -> Column:
    """Letters and digits only, in lower case; what separates two digits becomes a space."""
    spaced = F.regexp_replace(F.lower(value), r"(?<=[0-9])[^\p{L}0-9]+(?=[0-9])", " ")
    return F.trim(F.regexp_replace(spaced, r"[^\p{L}0-9 ]|(?<![0-9]) | (?![0-9])", ""))


def number_aliases(mentions: DataFrame, scope: list[str], order: list[str], wide: bool = False) -> DataFrame:
    """Per scope and category, numbers of the keys by first appearance (order): scope, category, key, number, alias, n_mentions.

    wide: scopes may hold very many keys (a case rather than a document). Then keys are sorted over ranges, so that one scope spreads over
    many tasks, numbered within each range, and raised by how many keys of their scope lie in earlier ranges.
    """
    if wide:
        keyed = mentions.groupBy(*scope, "category", "key").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n_mentions"))
        ranged = cut(keyed.sort(*scope, "category", "first", "key").withColumn("_part", F.spark_partition_id()))
        groups = ranged.groupBy("_part", *scope, "category").agg(F.count("*").alias("_n"))
        before = groups.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*scope, "category").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_part", *scope, "category")]
        met = ranged.alias("r").join(before.alias("b"), on).select("r.*", "b._before")
        w = Window.partitionBy("_part", *scope, "category").orderBy("first", "key")
        numbered = met.withColumn("number", (F.row_number().over(w) + F.col("_before")).cast("int"))
        return numbered.withColumn("alias", F.concat_ws("_", "category", F.col("number").cast("string"))).drop("first", "_part", "_before")
    first = mentions.groupBy(*scope, "category", "key").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n_mentions"))
    w = Window.partitionBy(*scope, "category").orderBy("first", "key")
    return first.withColumn("number", F.row_number().over(w)).withColumn("alias", F.concat_ws("_", "category", F.col("number").cast("string"))).drop("first")


def _email_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return email_detect(spark, sf_dir).withColumn("category", F.lit("EMAIL")).withColumn("key", normalization_key(F.col("value")))


def alias_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of the addresses of each document."""
    return number_aliases(_email_mentions(spark, sf_dir), ["doc_id"], ["start_cp"]).select("doc_id", "category", "key", "number", "alias", "n_mentions")


ALIAS_NUMBERING_SQL = f"""
WITH f AS (SELECT doc_id, lower(value) AS key, min(start_cp) AS s, count(*) AS n_mentions FROM ({EMAIL_DETECT_SQL}) GROUP BY 1, 2)
SELECT doc_id, 'EMAIL' AS category, key, row_number() OVER w::INTEGER AS number, 'EMAIL_' || row_number() OVER w AS alias, n_mentions FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY s, key)
""".replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER")


def alias_numbering_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a source as the scope (a case): first appearance by document, then place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = _email_mentions(spark, sf_dir).join(docs, "doc_id")
    return number_aliases(found, ["source"], ["doc_id", "start_cp"], wide=True).select("source", "category", "key", "number", "alias", "n_mentions")


ALIAS_BY_SOURCE_SQL = f"""
WITH m AS (SELECT source, lower(value) AS key, e.doc_id, start_cp FROM ({EMAIL_DETECT_SQL}) e JOIN documents d USING (doc_id)),
f AS (SELECT source, key, min(struct_pack(d := doc_id, s := start_cp)) AS first, count(*) AS n_mentions FROM m GROUP BY 1, 2)
SELECT source, 'EMAIL' AS category, key, (row_number() OVER w)::INTEGER AS number, 'EMAIL_' || row_number() OVER w AS alias, n_mentions FROM f WINDOW w AS (PARTITION BY source ORDER BY first, key)
"""


def next_alias_number(used: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope and category the number after the highest ever used (numbers of forgotten identities included)."""
    return used.groupBy(*scope, "category").agg((F.max("number") + 1).alias("next_number"))


def next_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_alias_number(alias_numbering_by_source(spark, sf_dir), ["source"])


NEXT_ALIAS_SQL = f"SELECT source, category, max(number) + 1 AS next_number FROM ({ALIAS_BY_SOURCE_SQL}) GROUP BY 1, 2"


def url_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(url_key(F.col("url")).alias("key"), "page_id").groupBy("key").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


URL_KEY_SQL = r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '^[Ww]{3}\.', ''), '/+$', '') AS b FROM pages),
h AS (SELECT page_id, b, regexp_extract(b, '^[^/?#]*') AS h FROM b)
SELECT lower(h) || substring(b, length(h) + 1) AS key, count(*) AS n_pages, min(page_id) AS first_page FROM h GROUP BY 1
"""


def norm_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wordings joined to known identities by key: suppliers' names, upper-cased and spaced, find the suppliers."""
    known = table(spark, sf_dir, "supplier").select("s_suppkey", normalization_key(F.regexp_replace("s_name", "#", " # ")).alias("key"))
    said = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("said_by"), normalization_key(F.upper(F.regexp_replace("s_name", "#", "\n#  "))).alias("key"))
    return said.join(known, "key", "left").select("said_by", "key", F.col("s_suppkey").alias("identity_id"))


NORM_KEY_SQL = r"SELECT s_suppkey AS said_by, lower(regexp_replace(s_name, '#', ' # ')) AS key, s_suppkey AS identity_id FROM supplier"


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that read alike once punctuation goes: how many spellings each key has."""
    parts = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.initcap(F.translate("p_name", " ", "-")), F.concat("p_name", F.lit(".")))).alias("spelling"))
    return parts.groupBy(spelling_key(F.col("spelling")).alias("key")).agg(F.countDistinct("spelling").alias("n_spellings"), F.count("*").alias("n"))


SPELLING_SQL = "SELECT replace(p_name, ' ', '') AS key, 3::BIGINT AS n_spellings, 3 * count(*) AS n FROM part GROUP BY p_name"


def one_edit(names: DataFrame, name: str) -> DataFrame:
    """Pairs of distinct names (6 characters or more) that one edit separates.

    Blocked by each name's deletions (the name, and it without one character): names one edit apart share one, so there
    is never a pair that is not at least two edits close.
    """
    keyed = names.select(F.col(name).alias("name")).distinct().where(F.length("name") >= 6)
    n = F.col("name")
    shorter = F.transform(F.sequence(F.lit(1), F.length(n)), lambda k: F.concat(F.substring(n, F.lit(1), k - 1), F.substring(n, k + 1, F.length(n))))
    keyed = keyed.select("name", F.explode(F.array_distinct(F.concat(F.array(n), shorter))).alias("block"))
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("name"), F.col("b.name").alias("other")).distinct()
    return pairs.where(F.levenshtein("name", "other") == 1)


def near_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints to merge among part names and suppliers' numbers, one edit apart."""
    names = table(spark, sf_dir, "part").select("p_name").unionByName(table(spark, sf_dir, "supplier").select(F.substring("s_name", 10, 9).alias("p_name")))
    return one_edit(names, "p_name")


NEAR_NAMES_SQL = """
WITH n AS (SELECT DISTINCT p_name AS name FROM (SELECT p_name FROM part UNION ALL SELECT substring(s_name, 10, 9) FROM supplier) WHERE length(p_name) >= 6)
SELECT a.name, b.name AS other FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 1 AND levenshtein(a.name, b.name) = 1
"""


QUERIES = [
    ("alias_numbering", alias_numbering, ALIAS_NUMBERING_SQL), ("alias_numbering_by_source", alias_numbering_by_source, ALIAS_BY_SOURCE_SQL), ("next_alias", next_alias, NEXT_ALIAS_SQL),
    ("url_key_dedup", url_key_dedup, URL_KEY_SQL), ("norm_key_join", norm_key_join, NORM_KEY_SQL), ("spelling_variants", spelling_variants, SPELLING_SQL),
    ("near_duplicate_names", near_duplicate_names, NEAR_NAMES_SQL),
]
