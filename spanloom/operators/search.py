"""Search in visible text, spelling, suggestions.

Defined cases: a null text or word has no hits and no suggestions; hits never overlap; a word on the dictionary is no suggestion for itself; repeated
words count once; a null language has a dictionary of its own; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import find_spans
from spanloom.sources.tables import table

WORDS = r"[\p{L}]+"


def find(text: Column, needle: str, whole_word: bool = False) -> Column:
    """Non-overlapping occurrences of a literal, in any case (Unicode), optionally as whole words."""
    quoted = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in needle)
    edge = r"[\p{L}\p{N}_]"
    return find_spans(text, f"(?iu){f'(?<!{edge})' if whole_word else ''}{quoted}{f'(?!{edge})' if whole_word else ''}")


def find_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = docs.select("doc_id", F.lit("anywhere").alias("mode"), F.inline(find(F.col("text"), "theat"))).unionByName(docs.select("doc_id", F.lit("whole").alias("mode"), F.inline(find(F.col("text"), "that", True))))
    return hits.select("doc_id", "mode", F.col("start").alias("start_cp"), F.col("text").alias("value"))


FIND_SQL = r"""
WITH m AS (SELECT doc_id, 'anywhere' AS mode, string_split(regexp_replace(text, '([tT][hH][eE][aA][tT])', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) AS p FROM documents
  UNION ALL SELECT doc_id, 'whole', list_transform(regexp_split_to_array(regexp_replace(text, '([\p{L}\p{N}_]+)', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)), lambda x: x) FROM documents),
u AS (SELECT doc_id, mode, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM m), e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, mode ORDER BY i) AS e FROM u)
SELECT doc_id, mode, (e - length(piece))::INTEGER AS start_cp, piece AS value FROM e WHERE i % 2 = 0 AND (mode = 'anywhere' OR lower(piece) = 'that')
"""


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null: empty), w as written and n: each distinct word of a document once."""
    words = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("w"))
    return words.groupBy("doc_id", "lang", "w").agg(F.count("*").alias("n"))


def dictionaries(counts: DataFrame, least: int) -> DataFrame:
    """lang, word: the words, in lower case, that so many documents of a language use, from word_counts."""
    return counts.select("doc_id", "lang", F.lower("w").alias("word")).distinct().groupBy("lang", "word").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least).select("lang", "word")


def unknown_words(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words (doc_id, lang, word, n) of word_counts that their language's dictionary (lang, word) doesn't have, in lower case; single
    letters and words all in capitals are skipped."""
    said = counts.where((F.length("w") > 1) & (F.col("w") != F.upper("w"))).groupBy("doc_id", "lang", F.lower("w").alias("word")).agg(F.sum("n").alias("n"))
    return said.join(dictionary.select("lang", "word").distinct(), ["lang", "word"], "left_anti").select("doc_id", "lang", "word", "n")


def spell_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a dictionary per language, of the words that 20 documents or more use: flagged words per document."""
    counts = word_counts(table(spark, sf_dir, "documents"))
    return unknown_words(counts, dictionaries(counts, 20)).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_flags"))


SPELL_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM documents), d AS (SELECT lang, lower(w) AS word FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 20),
c AS (SELECT doc_id, lang, lower(w) AS word, count(*) AS n FROM w WHERE length(w) > 1 AND w <> upper(w) GROUP BY 1, 2, 3)
SELECT doc_id, count(*) AS n_words, sum(n)::BIGINT AS n_flags FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND d.word = c.word) GROUP BY 1
"""


def _deletions(words: Column) -> Column:
    """The words of an array, and each without one character."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, less))))


def suggest(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Suggestions (word, suggestion, distance) within two edits among dictionary words.

    Blocked by what up to two deletions leave of each: words two edits apart share such a rest, wherever the edits are.
    """
    keyed = lambda df: df.select("word").distinct().select("word", F.explode(_deletions(_deletions(F.array("word")))).alias("block"))
    near = keyed(dictionary).withColumnRenamed("word", "suggestion")
    pairs = keyed(words).join(near, "block").where((F.abs(F.length("word") - F.length("suggestion")) <= 2) & (F.col("word") != F.col("suggestion"))).select("word", "suggestion").distinct()
    return pairs.select("word", "suggestion", F.levenshtein("word", "suggestion").alias("distance")).where("distance <= 2")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions among part names for misspelt ones (the first two letters swapped, the last one doubled or both)."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct()
    swapped = F.concat(F.substring("word", 2, 1), F.substring("word", 1, 1), F.substring("word", 3, 1000))
    doubled = lambda w: F.concat(w, F.substring("word", -1, 1))
    return suggest(names.select(F.explode(F.array(doubled(F.col("word")), swapped, doubled(swapped))).alias("word")), names)


SUGGEST_SQL = "WITH n AS (SELECT DISTINCT p_name AS w FROM part), v AS (SELECT w, w[2] || w[1] || substring(w, 3) AS x FROM n), m AS (SELECT DISTINCT unnest([w || right(w, 1), x, x || right(w, 1)]) AS word FROM v) SELECT word, w AS suggestion, levenshtein(word, w)::INTEGER AS distance FROM m JOIN n ON abs(length(word) - length(w)) <= 2 AND word <> w WHERE levenshtein(word, w) <= 2"

QUERIES = [("find_literal", find_literal, FIND_SQL), ("spell_check", spell_check, SPELL_SQL), ("suggestions", suggestions, SUGGEST_SQL)]
