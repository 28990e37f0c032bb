"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the failure bits with the measurements. Policies
(named, versioned sets of rules) are then masks over the stored bits: applying or comparing them never reads a
text again, and an ablation is an aggregation of bits. Built-in functions only.

Defined cases: a null text counts as empty (no words, so it fails ``few_words``); an empty table gives an empty
ledger; repeated rows are judged each on its own; a text of any length is measured whole; nothing depends on order, so
there are no ties; columns beside the id and the text, however named, are ignored by the ledger and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE_RE, documents, let, texts

SYMBOLS = "#*$%&|<>"


def _rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbol_ratio", 10 * c("n_symbols") > c("n_words")),
        ("duplicate_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        ("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        ("upper_case", 10 * c("n_upper") > 3 * c("word_chars")),
        ("exclamations", 5 * c("n_exclamations") > c("n_words")),
    ]


RULE_NAMES = ["few_words", "repeated_windows", "symbol_ratio", "duplicate_lines", "word_length", "upper_case", "exclamations"]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULE_NAMES.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(RULE_NAMES))


def _covered(starts: Column) -> Column:
    """Words in the 3-word windows that begin at starts (ascending)."""
    gaps = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts) - 1), lambda a, b: F.least(b - a, F.lit(3)))
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.lit(3) + F.aggregate(gaps, F.lit(0), lambda s, x: s + x.cast("int")))


def _repeated_at(n: Column, same) -> Column:
    """Places in a sorted array of n whose entry is next to an equal one."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k > 0) & same(k, k - 1)) | ((k < n - 1) & same(k, k + 1)))


def _repeat_words(h: Column, w: Column) -> Column:
    """Words in 3-word windows found twice or more; the windows' words decide.

    Sorting brings equal windows together. It is fast over hashes that share a long with the place, and right if all neighbours with
    equal hashes have equal words. Where any have not, and where places need more bits, the windows are sorted by their words.
    """
    bits = 20
    low = F.lit((1 << bits) - 1)
    words = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"))
    spelt = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.struct(words(i).alias("w"), i.alias("i"))))

    def exact(r: Column) -> Column:
        at = _repeated_at(F.size(r), lambda a, b: F.get(r, a)["w"] == F.get(r, b)["w"])
        return let(F.sort_array(F.transform(at, lambda k: F.get(r, k)["i"].cast("long"))), _covered)

    def fast(r: Column) -> Column:
        key, place = lambda k: F.shiftright(F.get(r, k), bits), lambda k: F.get(r, k).bitwiseAND(low)
        same = lambda a, b: key(a) == key(b)
        differ = lambda k: (k > 0) & same(k, k - 1) & (words(place(k).cast("int")) != words(place(k - 1).cast("int")))
        judged = lambda at: F.when(F.exists(at, differ), let(spelt, exact)).otherwise(let(F.sort_array(F.transform(at, place)), _covered))
        return let(_repeated_at(F.size(r), same), judged)

    packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, bits).bitwiseOR(i.cast("long"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).when(F.size(h) < 1 << bits, let(packed, fast)).otherwise(let(spelt, exact))


def measurements(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window_hash=None) -> DataFrame:
    """doc_id and what the rules measure. Each step is its own projection, so arrays are made once. window_hash: of three words; which one
    is used makes no difference to the result."""
    t, w = F.col("text"), F.col("w")
    chars = F.length(t).cast("long")
    less = lambda these: (chars - F.length(F.regexp_replace(t, these, ""))).cast("long")
    window_hash = window_hash or F.xxhash64
    hashes = lambda i: window_hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    counted = texts(docs, doc_id, text).select(
        "doc_id",
        F.array_remove(F.split(t, SPACE_RE), "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        less(f"[{SYMBOLS}]+").alias("n_symbols"),
        less("[A-Z]+").alias("n_upper"),
        (chars - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
    )
    hashed = counted.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        "n_upper",
        "n_exclamations",
        F.size("l").cast("long").alias("n_lines"),
        F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), hashes)).alias("h"),
        "w",
    )
    return hashed.withColumn("n_repeat_words", _repeat_words(F.col("h"), F.col("w")).cast("long")).drop("h", "w")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and fail_bits: bit k is set if rule k fails."""
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(_rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    # the id adds nothing, but keeps the optimizer from copying every measurement into filters on the bits
    stays = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    return measurements(docs, doc_id, text).withColumn("fail_bits", bits.bitwiseOR(stays))


def failed(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return book.withColumn("kept", ~failed(policy)).withColumn("policy", F.lit(f"{policy.name}@{policy.version}"))


def ablation(book: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """A row per rule of the policy: documents that fail it, that fail it alone, and that would go without it.

    The ledger shrinks to a row per set of failed rules first (2^rules at most); the rest is bit arithmetic.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    sets = book.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULE_NAMES.index(r)).cast("long").alias("bit")) for r in policy.rules])
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return (
        sets.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(count(has).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_alone"), count(F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0).alias("n_rejected_without"))
    )


def keep(docs: DataFrame, policy: Policy = DEFAULT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their own columns: measured in place, nothing is joined or moved."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    judged = ledger(packed.select("_row", F.col("_row")[text].alias("text")), "_row", "text")
    return judged.where(~failed(policy)).select("doc_id.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(documents(spark, sf_dir)))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed(BASE).alias("base_failed"), "kept", "fail_bits")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM m),
v AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM v WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines,
             (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
             (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations
      FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN 10 * n_upper > 3 * word_chars THEN 32 ELSE 0 END)
             + (CASE WHEN 5 * n_exclamations > n_words THEN 64 ELSE 0 END) AS fail_bits FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b
"""
