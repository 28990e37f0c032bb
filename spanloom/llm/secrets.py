"""Secret scans: fixed patterns, and strings that a character Markov model finds random.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from a
labelled table (text, label: 1 random, 0 ordinary). A token's log-likelihood ratio per character decides. The
training counts collapse to one row per pair of characters (65 * 65 at most), the only thing that reaches the
driver. Built-in functions only.

Offsets without Python: matches are wrapped in a mark that the text cannot hold (the mark's own occurrences are
swapped for another character of the same length first), the text is split at the marks, and running lengths
of the pieces give code-point offsets.

Defined cases: a null text is empty; no span gives empty ``spans`` and the digest of the empty string; repeated
rows are scanned each; a text of any length is scanned whole; spans that start together come in the order of KINDS; columns beside
the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import documents, let, texts

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With the least lengths in the patterns: a run that is too short holds no match that is long enough.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Strings that the Markov models judge: of 16 characters random strings are told from identifiers in 99 of 100 cases (test_scans.py).
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Mean log-likelihood ratio (nats a character) from which a token counts as random.
THRESHOLD = 0.65
MARK, SWAP = "\ue000", "\ue001"
SPANS = "array<struct<s:int,k:int,e:int>>"

#: Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "get set user name value count index list table data file path line text node item key map string number "
    "test result error message config option default first last next page size type code event handler request "
    "response server client session manager factory builder service module package class object method update "
    "create delete remove insert select order customer account address email phone invoice product category "
    "description information international organization temperature measurement document version release"
).split()


def labelled_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """n rows of each kind: base64, hexadecimal and alphanumeric digests; words joined as identifiers are."""
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    base64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    random = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, base64).otherwise(F.translate(base64, "+/=", "aZ9"))
    number = F.pmod(F.xxhash64("id"), F.lit(2100)).cast("string")
    parts = [pick(k) for k in range(4)]
    ordinary = (
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *parts[:3], number))
        .when(F.col("id") % 4 == 1, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]], number))
        .when(F.col("id") % 4 == 2, F.concat_ws("-", *parts))
        .otherwise(F.upper(F.concat_ws("_", *parts[:3])))
    )
    ids = spark.range(0, n, 1, 4)
    return ids.select(random.alias("text"), F.lit(1).alias("label")).unionByName(ids.select(ordinary.alias("text"), F.lit(0).alias("label")))


def _code(char: Column) -> Column:
    """A character's place in ALPHABET from 0; what isn't there shares the last place."""
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at > 0, at - 1).otherwise(F.lit(SIZE - 1))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters, random against ordinary: entry SIZE * a + b.

    Rows with a null, another label than 0 or 1, or fewer than two characters teach nothing.
    """
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    pairs = samples.where("text is not null and length(text) > 1 and label in (0, 1)").select(
        "label", F.explode(let(chars, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(_code(a).alias("a"), _code(b).alias("b"))))).alias("p")
    )
    counts = [[[0.5] * SIZE for _ in range(SIZE)] for _ in range(2)]
    for r in pairs.groupBy("label", "p.a", "p.b").count().collect():  # 2 * SIZE * SIZE rows at most
        counts[r["label"]][r["a"]][r["b"]] += r["count"]
    log = [[[math.log(x / sum(row)) for x in row] for row in kind] for kind in counts]
    return [round(log[1][a][b] - log[0][a][b], 4) for a in range(SIZE) for b in range(SIZE)]


def ratio(token: Column, model: Column) -> Column:
    """The mean log-likelihood ratio of a token's pairs of characters."""

    def mean(codes: Column) -> Column:
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(model, a * SIZE + b))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (F.size(codes) - 1)

    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), _code)
    return F.when(F.length(token) < 2, F.lit(0.0)).otherwise(let(codes, mean))


def _spans(text: Column, pattern: str, ok, kind: int) -> Column:
    """Spans (s, k, e) of the leftmost non-overlapping matches that ok(match) accepts."""
    none = F.array().cast(SPANS)
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, SWAP), f"({pattern})", f"{MARK}$1{MARK}"), MARK)

    def step(s: Column, x: Column) -> Column:
        # odd pieces, counted from 0, are the matches; the state carries the offset reached so far
        end = (s["at"] + F.length(x)).cast("int")
        span = F.array(F.struct(s["at"].alias("s"), F.lit(kind).alias("k"), end.alias("e")))
        return F.struct(end.alias("at"), (~s["match"]).alias("match"), F.when(s["match"] & ok(x), F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step, lambda s: s["out"])).otherwise(none)


def scan(docs: DataFrame, model: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and extra: arrays of (s, k, e) in code points; k counts KINDS."""
    t = F.col("text")
    model = train(labelled_samples(docs.sparkSession)) if model is None else model
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    base = F.sort_array(
        F.concat(
            _spans(t, ASSIGN, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 8, 0),
            _spans(t, ACCESS, lambda x: F.lit(True), 1),
            _spans(t, HEX, lambda x: F.lit(True), 2),
        )
    )
    random = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (ratio(x, table) >= THRESHOLD)
    found = texts(docs, doc_id, text).select("doc_id", base.alias("base"), _spans(t, CANDIDATE, random, 3).alias("more"))
    free = lambda x: ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    return found.select("doc_id", "base", F.filter("more", free).alias("extra"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "extra"))).alias("spans")
    )
