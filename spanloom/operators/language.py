"""Signals of a text's language: letters per script, words in a name, the first signal that there is.

Defined cases: a null text has no letters and points at English; of equal counts the greater code wins; a path without a file name names nothing; an
empty set of languages is covered by the first offered one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import table

#: Scripts and the letters that point at one language, in the order of reports.
SCRIPTS = [("latin", "A-Za-zÀ-ÖØ-öø-ÿ"), ("cyrillic", "Ѐ-ӿ"), ("greek", "Ͱ-Ͽ"), ("french", "çêèœùÇÊÈ"), ("german", "äöüßÄÖÜ"), ("spanish", "ñóíáúÑÓÍ")]
LEAST = 3


def letter_counts(text: Column) -> list[Column]:
    return [(F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))).alias(name) for name, chars in SCRIPTS]


def lang_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters per script, and the language they point at: that of the most telling letters, at least three, else English."""
    counted = table(spark, sf_dir, "documents").select("doc_id", *letter_counts(F.col("text")))
    telling = F.array(*[F.struct(F.col(c).alias("n"), F.lit(code).alias("code")) for c, code in (("french", "fr"), ("german", "de"), ("spanish", "es"), ("cyrillic", "ru"))])
    best = F.array_max(F.filter(telling, lambda x: x["n"] >= LEAST))
    return counted.withColumn("guess", F.coalesce(best["code"], F.lit("en")))


def _sql_count(chars: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '[{chars}]', '', 'g')))::INTEGER"


LANG_SQL = f"""
WITH c AS (SELECT doc_id, {', '.join(f'{_sql_count(chars)} AS {name}' for name, chars in SCRIPTS)} FROM documents)
SELECT *, coalesce(list_aggregate(list_filter([struct_pack(n := french, code := 'fr'), struct_pack(n := german, code := 'de'), struct_pack(n := spanish, code := 'es'), struct_pack(n := cyrillic, code := 'ru')], lambda x: x.n >= {LEAST}), 'max').code, 'en') AS guess FROM c
"""


def first_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's language and where it is known from: the path, then the markup, then the default; with the reason."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1)
    markup = F.regexp_extract("html", '<html lang="([a-z]{2})"', 1)
    named = table(spark, sf_dir, "pages").select("page_id", F.nullif(path, F.lit("")).alias("p"), F.nullif(markup, F.lit("")).alias("m"))
    return named.select("page_id", F.coalesce("p", "m", F.lit("en")).alias("lang"), F.when(F.col("p").isNotNull(), "path").when(F.col("m").isNotNull(), "markup").otherwise("default").alias("reason"))


FIRST_SIGNAL_SQL = """
WITH n AS (SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1), '') AS p, nullif(regexp_extract(html, '<html lang="([a-z]{2})"', 1), '') AS m FROM pages)
SELECT page_id, coalesce(p, m, 'en') AS lang, CASE WHEN p IS NOT NULL THEN 'path' WHEN m IS NOT NULL THEN 'markup' ELSE 'default' END AS reason FROM n
"""


def closest_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the offered set of languages that covers what it has: the first superset, else the largest overlap, the earlier
    of equals."""
    offered = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, x)).alias("set")) for k, x in enumerate((["en"], ["de", "en"], ["en", "fr"], ["de", "en", "es"], ["de", "en", "es", "fr"]))])
    have = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("have"))
    rank = F.transform(offered, lambda o: F.struct((F.size(F.array_except("have", o["set"])) == 0).alias("all"), F.size(F.array_intersect("have", o["set"])).alias("n"), (-o["k"]).alias("k")))
    best = F.array_max(F.transform(rank, lambda r: F.struct(r["all"].alias("all"), F.when(r["all"], 0).otherwise(r["n"]).alias("n"), r["k"].alias("k"))))
    return have.select("source", F.array_join("have", ",").alias("langs"), (-best["k"]).alias("choice"))


CLOSEST_SQL = """
WITH h AS (SELECT source, list_sort(list_distinct(list(lang))) AS l FROM documents GROUP BY 1),
o AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([['en'], ['de', 'en'], ['en', 'fr'], ['de', 'en', 'es'], ['de', 'en', 'es', 'fr']]) AS s)
SELECT source, array_to_string(any_value(l), ',') AS langs, arg_max(k, struct_pack(a := list_has_all(s, l), n := CASE WHEN list_has_all(s, l) THEN 0 ELSE len(list_intersect(l, s)) END, k := -k))::INTEGER AS choice FROM h, o GROUP BY source
"""

#: Words in a file's name that name a language.
NAMED = {"english": "en", "eng": "en", "en": "en", "russian": "ru", "rus": "ru", "ru": "ru", "русский": "ru", "german": "de", "deutsch": "de", "de": "de", "french": "fr", "français": "fr", "fr": "fr", "spanish": "es", "español": "es", "es": "es"}


def named_languages(path: Column) -> Column:
    """Languages that the words of a file's name (without folders and extension) name, each once, in order."""
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/\\\\]*$", 0), r"\.[A-Za-z0-9]+$", "")
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(F.split(F.lower(stem), r"[^\p{L}]+"), lambda w: names[w])))


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named after documents' languages and sources: what the name says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/de/Report_"), F.coalesce("lang", F.lit("")), F.lit("-German"), F.col("doc_id").cast("string"), F.lit(" denim.fr")).alias("path"))
    return docs.select("doc_id", F.array_join(named_languages(F.col("path")), ",").alias("langs"))


FILE_LANGUAGES_SQL = "SELECT doc_id, CASE WHEN lang = 'de' OR lang IS NULL OR lang NOT IN ('en', 'fr', 'es', 'ru') THEN 'de' ELSE lang || ',de' END AS langs FROM documents"

QUERIES = [("file_languages", file_languages, FILE_LANGUAGES_SQL), ("lang_signal", lang_signal, LANG_SQL), ("first_signal", first_signal, FIRST_SIGNAL_SQL), ("closest_languages", closest_languages, CLOSEST_SQL)]
