"""Names: their parts, the forms a full name may take, and linking forms that fit one full name only.

Defined cases: a null or one-word name has fewer forms; a form that fits several people is linked to none; repeated names count once; null scopes
meet nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import let
from spanloom.operators.mapping import spelling_key
from spanloom.sources.tables import table

#: Particles that belong to the surname after them.
PARTICLES = "van von de der den del della di da la le du dos das ter ten zu zur af bin al".split()
#: Endings of Russian patronymics.
PATRONYMIC = r"(?iu)(?:(?:ович|евич|ич)(?:а|у|ем|е)?|(?:овн|евн|ичн|иничн)(?:а|ы|е|у|ой))$"


def name_words(name: Column) -> Column:
    """The words of a name; particles are joined to the word after them."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    particles = F.array(*[F.lit(p) for p in PARTICLES])

    def step(s: Column, w: Column) -> Column:
        full = F.when(s["open"] == "", w).otherwise(F.concat(s["open"], F.lit(" "), w))
        is_particle = F.array_contains(particles, F.lower(w)) & (w == F.lower(w))
        return F.struct(F.when(is_particle, full).otherwise("").alias("open"), F.when(is_particle, s["out"]).otherwise(F.concat(s["out"], F.array(full))).alias("out"))

    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(words, zero, step, lambda s: F.when(s["open"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))


def is_patronymic(word: Column) -> Column:
    return word.rlike(PATRONYMIC)


def initials(name: Column) -> Column:
    return F.array_join(F.transform(name_words(name), lambda w: F.upper(F.substring(w, F.lit(1), F.lit(1)))), "")


def forms(name: Column) -> Column:
    """(form, kind) of a full name: whole, reversed, surname, given name, initials with surname (both orders), bare initials."""

    def of(words: Column) -> Column:
        last, given = F.element_at(words, -1), F.slice(words, 1, F.size(words) - 1)
        dots = F.array_join(F.transform(given, lambda w: F.concat(F.upper(F.substring(w, F.lit(1), F.lit(1))), F.lit("."))), " ")
        one = lambda form, kind: F.struct(form.alias("form"), F.lit(kind).alias("kind"))
        several = F.array(
            one(F.array_join(words, " "), "whole"), one(F.concat_ws(" ", last, F.array_join(given, " ")), "reversed"), one(last, "surname"), one(F.element_at(words, 1), "given"), one(F.concat_ws(" ", dots, last), "initials"),
            one(F.concat_ws(" ", last, dots), "initials after"), one(F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, F.lit(1), F.lit(1)))), ""), "bare initials"),
        )
        return F.when(F.size(words) >= 2, several).otherwise(F.array(one(F.array_join(words, " "), "whole")))

    return let(name_words(name), of)


def link_forms(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """mentions (mention, scope) with the one person (person, scope) of their scope whose forms hold the mention; where several
    people fit, none. Forms meet mentions by an equi join, and uniqueness is an aggregate over (scope, form)."""
    formed = people.select("scope", "person", F.inline(forms(F.col("person")))).withColumn("key", F.lower("form"))
    single = formed.groupBy("scope", "key").agg(F.countDistinct("person").alias("n"), F.min("person").alias("person"), F.min("kind").alias("kind")).where("n = 1").drop("n")
    return mentions.withColumn("key", F.lower("mention")).join(single, ["scope", "key"], "left").select("scope", "mention", "person", "kind")


def merge_hints(people: DataFrame) -> DataFrame:
    """Pairs (person, other, hint) of one scope that may be the same: reversed order, or spellings that read alike."""
    known = people.select("scope", "person").distinct()
    turned = known.select("scope", F.col("person").alias("other"), F.explode(F.filter(forms(F.col("person")), lambda f: f["kind"] == "reversed")).alias("f")).select("scope", "other", F.col("f.form").alias("person"))
    flipped = known.join(turned, ["scope", "person"]).where("person < other").select("scope", "person", "other", F.lit("reversed").alias("hint"))
    keyed = known.withColumn("key", spelling_key(F.col("person")))
    a, b = keyed.alias("a"), keyed.alias("b")
    spelt = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.person") < F.col("b.person")))
    return flipped.unionByName(spelt.select("a.scope", F.col("a.person").alias("person"), F.col("b.person").alias("other"), F.lit("spelling").alias("hint")))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.initcap("p_name").alias("person")).distinct()


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of part names read as given name and surname."""
    return _people(spark, sf_dir).select("person").distinct().select("person", F.inline(forms(F.col("person"))))


NAME_FORMS_SQL = """
WITH n AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part), p AS (SELECT upper(w[1][1]) || w[1][2:] AS g, upper(w[2][1]) || w[2][2:] AS s FROM n)
SELECT g || ' ' || s AS person, f.form AS form, f.kind AS kind FROM (SELECT g, s, unnest([struct_pack(form := g || ' ' || s, kind := 'whole'), struct_pack(form := s || ' ' || g, kind := 'reversed'), struct_pack(form := s, kind := 'surname'),
  struct_pack(form := g, kind := 'given'), struct_pack(form := g[1] || '. ' || s, kind := 'initials'), struct_pack(form := s || ' ' || g[1] || '.', kind := 'initials after'), struct_pack(form := g[1] || s[1], kind := 'bare initials')]) AS f FROM p)
"""


def unique_form_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by initials and surname, and by surname, per brand: linked where exactly one name of the brand fits."""
    people = _people(spark, sf_dir)
    said = people.select("scope", F.explode(F.filter(forms(F.col("person")), lambda f: f["kind"].isin("initials", "surname"))).alias("f")).select("scope", F.col("f.form").alias("mention")).distinct()
    return link_forms(said, people)


UNIQUE_FORMS_SQL = f"""
WITH f AS (SELECT DISTINCT p_brand AS scope, n.person, form, kind FROM part JOIN ({NAME_FORMS_SQL}) n ON lower(n.person) = p_name),
u AS (SELECT scope, lower(form) AS key, min(person) AS person, min(kind) AS kind FROM f GROUP BY 1, 2 HAVING count(DISTINCT person) = 1),
m AS (SELECT DISTINCT scope, form AS mention FROM f WHERE kind IN ('initials', 'surname'))
SELECT scope, mention, person, kind FROM m LEFT JOIN u ON u.scope = m.scope AND u.key = lower(m.mention)
""".replace("SELECT scope, mention, person, kind FROM m", "SELECT m.scope AS scope, mention, person, kind FROM m")


def reversed_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints among part names and their reversed and hyphenated writings."""
    people = _people(spark, sf_dir).select(F.lit("all").alias("scope"), "person").distinct()
    words = F.split("person", " ")
    more = people.select("scope", F.concat_ws(" ", F.get(words, 1), F.get(words, 0)).alias("person")).unionByName(people.select("scope", F.concat_ws("-", F.get(words, 0), F.get(words, 1)).alias("person")))
    return merge_hints(people.unionByName(more))


REVERSED_SQL = """
WITH n AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part), p AS (SELECT upper(w[1][1]) || w[1][2:] AS g, upper(w[2][1]) || w[2][2:] AS s FROM n)
SELECT 'all' AS scope, least(g || ' ' || s, s || ' ' || g) AS person, greatest(g || ' ' || s, s || ' ' || g) AS other, 'reversed' AS hint FROM p WHERE g <> s
UNION ALL SELECT 'all', least(g || ' ' || s, g || '-' || s), greatest(g || ' ' || s, g || '-' || s), 'spelling' FROM p
"""

QUERIES = [("name_forms", name_forms, NAME_FORMS_SQL), ("unique_form_links", unique_form_links, UNIQUE_FORMS_SQL), ("reversed_hints", reversed_hints, REVERSED_SQL)]
