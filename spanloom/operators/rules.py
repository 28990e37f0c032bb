"""Rules as data: labelled values, filters on spans, boundary fixes.

A rule table is small and fixed with the code, so rules become expressions; spans are arrays of a document (start, end,
text, category) and every step is a fold or a filter over them, without a shuffle.

Defined cases: a null text or span array gives no spans or null; rules are tried each by themselves, so their matches may overlap; spans that
start together are ordered by their end; equal spans stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import chunks, find_spans, let, overlaps, part
from spanloom.operators.recognizers import icao_check
from spanloom.sources.tables import table


@dataclass(frozen=True)
class LabelRule:
    """A value beside a label on the same line: label, what may stand between, the value; after: the value comes first."""

    category: str
    label: str
    value: str
    between: str = r"[ \t]*[:#№=]?[ \t]*"
    after: bool = False
    least_digits: int = 0


#: Rules of our own for four languages; a host adds or replaces them.
LABEL_RULES = [
    LabelRule("CASE", r"(?:case no\.?|case number|docket no\.?|aktenzeichen|az\.|дело №)", r"[A-ZА-Я0-9][A-ZА-Я0-9./-]{3,24}", least_digits=2),
    LabelRule("PHONE", r"(?:tel\.?|phone|mobile|telefon|tél\.?|teléfono|тел\.?)", r"\+?[0-9][0-9 ()./-]{5,18}[0-9]", least_digits=7),
    LabelRule("BANK", r"(?:iban)", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?", least_digits=10),
    LabelRule("BANK", r"(?:account no\.?|konto|cuenta|compte|р/с)", r"[0-9][0-9 ]{6,24}[0-9]", least_digits=8),
    LabelRule("IDENTITY", r"(?:passport no\.?|passport|reisepass|pasaporte|passeport|паспорт)", r"[A-Z]{0,2}[0-9][0-9 ]{5,11}[0-9]", least_digits=6),
    LabelRule("DATE", r"(?:date of birth|dob|born|geboren am|né le|nacido el|дата рождения)", r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"),
    LabelRule("DATE", r"(?:г\.р\.|date of birth)", r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", between=r"[ \t(]*", after=True),
    LabelRule("PERSON", r"(?:surname|last name|first name|full name|nachname|vorname|apellidos?|nom|фамилия|имя)", r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2}", between=r"[ \t]*:[ \t]*"),
]


def labelled_values(text: Column, rules: list[LabelRule] | None = None) -> Column:
    """Detections of label rules: start, end, text, category of the values (labels are found in any case, values as written)."""
    found = []
    for rule in LABEL_RULES if rules is None else rules:
        edge, label, value = r"(?<![\p{L}\p{N}])", f"(?iu:{rule.label})", f"(?:{rule.value})"
        whole = rf"{edge}{value}(?:{rule.between}){label}" if rule.after else rf"{edge}{label}(?:{rule.between}){value}(?![\p{{L}}\p{{N}}])"
        head = rf"^{value}" if rule.after else rf"^{label}(?:{rule.between})"

        def one(s: Column, rule=rule, head=head) -> Column:
            lead = F.length(F.regexp_extract(s["text"], head, 0))
            start = s["start"] if rule.after else s["start"] + lead
            end = s["start"] + lead if rule.after else s["end"]
            piece = F.substring(s["text"], F.lit(1), lead) if rule.after else F.substring(s["text"], lead + 1, F.length(s["text"]))
            return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), piece.alias("text"), F.lit(rule.category).alias("category"))

        values = F.transform(find_spans(text, whole), one_argument(one))
        enough = lambda s, n=rule.least_digits: F.length(F.regexp_replace(s["text"], "[^0-9]", "")) >= n
        found.append(F.filter(values, one_argument(enough)))
    return F.concat(*found)


def one_argument(f):
    """f with its defaults bound: lambdas over arrays must show one argument only."""
    return lambda s: f(s)


#: Latin and Greek letters that look like Cyrillic ones.
LOOKALIKE = ("ABCEHKMOPTXaceopxyΑΒΕΗΚΜΟΡΤΧ", "АВСЕНКМОРТХасеорхуАВЕНКМОРТХ")


def lookalike_key(word: Column) -> Column:
    """A word with look-alike letters as Cyrillic, in lower case: equals a known word's key if it only pretends to be a name."""
    return F.lower(F.translate(word, *LOOKALIKE))


def mixed_script(word: Column) -> Column:
    return word.rlike(r"\p{IsCyrillic}") & word.rlike(r"\p{IsLatin}")


def safe_span(span: Column) -> Column:
    """At most 1024 bytes, a letter or digit, no line break and no Markdown syntax at an edge."""
    t = span["text"]
    return (F.octet_length(t) <= 1024) & t.rlike(r"[\p{L}\p{N}]") & ~t.contains("\n") & ~t.rlike(r"^[|>#]|\|$")


def generated_alias(span: Column) -> Column:
    return span["text"].rlike(r"(?i)^(PERSON|ORG|EMAIL|URL|PHONE|ADDRESS|IDENTITY|TAX|BANK|CASE|DATE|REDACTED)([_\- ][0-9]{1,9})?$")


def whole_word(pieces: Column, span: Column) -> Column:
    """No letter, digit, underscore, slash, backslash or at-sign touches the span (pieces: the text in chunks)."""
    before = F.when(span["start"] > 0, part(pieces, span["start"] - 1, span["start"])).otherwise("")
    after = part(pieces, span["end"], span["end"] + 1)
    glue = r"[\p{L}\p{N}_/\\@]"
    return ~before.rlike(glue) & ~after.rlike(glue)


def mid_sentence(pieces: Column, span: Column) -> Column:
    """Whether a word stands inside a sentence: not at a line's start, nor after a period, exclamation or question mark."""
    before = part(pieces, F.greatest(span["start"] - 8, F.lit(0)), span["start"])
    return (span["start"] > 0) & ~before.rlike(r"(?:[.!?…]|\n)[\s\"'»”)]*$") & ~before.rlike(r"^\s*$")


def in_reference(span: Column, references: Column) -> Column:
    """Inside a match of a legal reference: the span goes."""
    return F.exists(references, lambda r: (r["start"] <= span["start"]) & (span["end"] <= r["end"]))


REFERENCE = r"(?iu)(?:§{1,2}\s?[0-9]+[a-z]?(?:\s?(?:Abs\.|Satz)\s?[0-9]+)*(?:\s[A-Z][A-Za-z]{1,5})?|Art(?:icle|ículo|\.)\s?[0-9]+(?:\([0-9]+\))?|ст(?:\.|атья)\s?[0-9]+)"


def strip_list_marker(spans: Column) -> Column:
    """'- Ann Lee' loses its marker, and the start moves."""

    def one(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["text"], r"^(?:[-*•+]|[0-9]{1,3}[.)])[ \t]+", 0))
        return F.struct((s["start"] + lead).cast("int").alias("start"), s["end"].alias("end"), F.substring(s["text"], lead + 1, F.length(s["text"])).alias("text"), s["category"].alias("category"))

    return F.transform(spans, one)


def join_names(text: Column, spans: Column) -> Column:
    """Neighbouring PERSON spans with one space between become one (spans in ascending order)."""
    kind = "array<struct<start:int,end:int,text:string,category:string>>"

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & (last["category"] == "PERSON") & (s["category"] == "PERSON") & (s["start"] == last["end"] + 1) & (F.substring(text, last["end"] + 1, F.lit(1)) == " ")
        both = F.struct(last["start"].alias("start"), s["end"].alias("end"), F.concat(last["text"], F.lit(" "), s["text"]).alias("text"), last["category"].alias("category"))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def beside_rules(spans: Column, rules: Column) -> Column:
    """Model spans cut around rule values inside or across them: the parts before and after, without spaces at their edges."""
    kind = "array<struct<start:int,end:int,text:string,category:string>>"

    def part(s: Column, start: Column, end: Column) -> Column:
        raw = F.substring(s["text"], start - s["start"] + 1, end - start)
        lead = F.length(raw) - F.length(F.ltrim(raw))
        return F.struct((start + lead).cast("int").alias("start"), (start + lead + F.length(F.trim(raw))).cast("int").alias("end"), F.trim(raw).alias("text"), s["category"].alias("category"))

    def one(s: Column) -> Column:
        hit = F.array_sort(F.filter(rules, lambda r: overlaps(r, s)))
        first, last = F.try_element_at(hit, F.lit(1)), F.try_element_at(hit, F.lit(-1))
        parts = F.array(part(s, s["start"], F.greatest(first["start"], s["start"])), part(s, F.least(last["end"], s["end"]), s["end"]))
        return F.when(F.size(hit) == 0, F.array(s)).otherwise(F.filter(parts, lambda p: F.length(p["text"]) > 0)).cast(kind)

    return F.flatten(F.transform(spans, one))


def ranked_union(spans: Column) -> Column:
    """Spans of several models (rank, start, end, category, text): a lower-ranked one that overlaps a kept one goes."""
    kind = "array<struct<rank:int,start:int,end:int,category:string,text:string>>"
    step = lambda out, s: F.when(F.exists(out, lambda o: overlaps(o, s)), out).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(F.array_sort(spans.cast(kind)), F.array().cast(kind), step)


def machine_zone(line: Column) -> Column:
    """Fields of the second line of a passport's zone (44 characters): number, birth, expiry, each with whether its check digit holds."""
    field = lambda a, n: F.substring(line, a, n)
    holds = lambda a, n: icao_check(field(a, n)) == field(a + n, 1).cast("int")
    valid = line.rlike("^[A-Z0-9<]{9}[0-9][A-Z<]{3}[0-9]{6}[0-9][MFX<][0-9]{6}[0-9][A-Z0-9<]{14}[0-9<][0-9]$")
    return F.when(valid, F.struct(F.regexp_replace(field(1, 9), "<+$", "").alias("number"), holds(1, 9).alias("number_holds"), field(14, 6).alias("birth"), holds(14, 6).alias("birth_holds"), field(22, 6).alias("expiry"), holds(22, 6).alias("expiry_holds")))


def labelled_in_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rules over lines made from orders: cases, phones, birth dates, in several writings."""
    n = F.col("o_orderkey")
    text = F.concat(F.lit("Case No. A-"), n, F.lit("/24, Tel: +1 555 "), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit(" 12; born 0"), n % 9 + 1, F.lit(".11.19"), n % 90 + 10, F.lit(" case nox"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(labelled_values(text)))
    return made.select("o_orderkey", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("value"), "category")


LABELLED_SQL = """
WITH m AS (SELECT o_orderkey, 'A-' || o_orderkey || '/24' AS a, '+1 555 ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' 12' AS b, '0' || (o_orderkey % 9 + 1) || '.11.19' || (o_orderkey % 90 + 10) AS c FROM orders)
SELECT o_orderkey, 9 AS start_cp, (9 + length(a))::INTEGER AS end_cp, a AS value, 'CASE' AS category FROM m
UNION ALL SELECT o_orderkey, (16 + length(a))::INTEGER, (16 + length(a) + length(b))::INTEGER, b, 'PHONE' FROM m
UNION ALL SELECT o_orderkey, (23 + length(a) + length(b))::INTEGER, (23 + length(a) + length(b) + length(c))::INTEGER, c, 'DATE' FROM m
"""


def capital_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of four letters or more in all documents, by whether they stand inside a sentence, and are whole: a look at
    the left context per word."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    found = find_spans(text, r"(?<!\p{L})\p{Lu}\p{Ll}{3,}(?!\p{L})")
    judged = let(chunks(text), lambda c: F.transform(found, lambda s: F.struct(mid_sentence(c, s).alias("mid"), whole_word(c, s).alias("whole"))))
    return docs.where("text is not null").select("doc_id", F.inline(judged)).groupBy("mid", "whole").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


#: The context is cut out of the text around each match, found by running lengths of what lies between matches.
CAPITAL_SQL = r"""
WITH p AS (SELECT doc_id, text, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, text, string_split(regexp_replace(text, '(^|[^\p{L}])(\p{Lu}\p{Ll}{3,})', '\1' || chr(57344) || '\2' || chr(57344), 'g'), chr(57344)) AS p FROM documents)),
e AS (SELECT doc_id, text, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p),
s AS (SELECT doc_id, (e - length(x))::BIGINT AS s, substring(text, greatest(e - length(x) - 7, 1)::BIGINT, least(e - length(x), 8)::BIGINT) AS b, substring(text, (e + 1)::BIGINT, 1) AS a FROM e WHERE i % 2 = 0),
j AS (SELECT doc_id, s > 0 AND NOT regexp_matches(b, '([.!?…]|\n)[\s"''»”)]*$') AND NOT regexp_matches(b, '^\s*$') AS mid,
  NOT regexp_matches(right(b, 1), '[\p{L}\p{N}_/\\@]') AND NOT regexp_matches(a, '[\p{L}\p{N}_/\\@]') AS whole FROM s WHERE NOT regexp_matches(a, '\p{L}'))
SELECT mid, whole, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM j GROUP BY 1, 2
"""


QUERIES = [("labelled_values", labelled_in_orders, LABELLED_SQL), ("capital_words", capital_words, CAPITAL_SQL)]
