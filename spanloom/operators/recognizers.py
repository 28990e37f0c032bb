"""Recognisers: span-producing scans of whole texts, and the checksums behind them.

Scores and the order of evidence follow the rules-only scan: labelled tax and identity numbers 0.95, e-mail addresses 0.9,
web addresses and list entries 1.0. Card and IP scans are extensions of our own, marked as such by their category.

Defined cases: a null or empty text has no detections; a text of any length is scanned whole; repeated rows are scanned each; matches of one
recogniser never overlap, those of several may; only the id and the text are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import SPAN, chunks, find_spans, let, part
from spanloom.sources.tables import table

#: Letters and digits of any script, quoted local parts, a leading plus or underscore, escaped underscores; no at-sign around it.
EMAIL = r"(?<![\p{L}\p{N}._%+@'’-])(?:\"[^\"\r\n@]{1,64}\"|(?:[\p{L}\p{N}+_]|\\_)(?:[\p{L}\p{N}._%+'’-]|\\_)*)@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+(?![\p{L}\p{N}@-])"
URL = r"(?:https?://|www\.)[^\s<>\"'\]]*[^\s<>\"'\].,;:!?)]"
CARD = r"(?<![0-9])[0-9]{16}(?![0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
#: Labels that must stand on the same line within 80 characters of a number.
TAX_LABEL = r"(?iu)(?:\bИНН\b|\binn\b|tax\s+id)"
REGISTRATION_LABEL = r"(?iu)(?:ОГРНИП|ОГРН|\bogrn\b)"
SNILS_LABEL = r"(?iu)(?:СНИЛС|\bsnils\b)"


def _digit(number: Column, k: int) -> Column:
    return F.substring(number, k + 1, 1).cast("int")


def _weighted(number: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + _digit(number, k) * w
    return total


def inn_valid(number: Column) -> Column:
    """Taxpayer numbers of 10 and 12 digits: weighted sums modulo 11, then modulo 10."""
    ten = _weighted(number, [2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10 == _digit(number, 9)
    first = _weighted(number, [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10 == _digit(number, 10)
    second = _weighted(number, [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) % 11 % 10 == _digit(number, 11)
    digits = number.rlike("^[0-9]+$")
    return F.coalesce(F.when(digits & (F.length(number) == 10), ten).when(digits & (F.length(number) == 12), first & second), F.lit(False))


def registration_valid(number: Column) -> Column:
    """Registration numbers: 13 digits modulo 11, 15 digits modulo 13, then modulo 10."""
    digits = number.rlike("^[0-9]+$")
    short = F.substring(number, 1, 12).cast("bigint") % 11 % 10 == _digit(number, 12)
    long = F.substring(number, 1, 14).cast("bigint") % 13 % 10 == _digit(number, 14)
    return F.coalesce(F.when(digits & (F.length(number) == 13), short).when(digits & (F.length(number) == 15), long), F.lit(False))


def snils_valid(number: Column) -> Column:
    """Insurance numbers of 11 digits: nine weighted digits modulo 101 (100 counts as 0) make the last two; all zeros declined."""
    sum_ = _weighted(number, [9, 8, 7, 6, 5, 4, 3, 2, 1]) % 101 % 100
    return F.coalesce(F.when(number.rlike("^[0-9]{11}$") & (number != "0" * 11), sum_ == F.substring(number, 10, 2).cast("int")), F.lit(False))


def icao_check(field: Column) -> Column:
    """The check digit of a machine-readable field: weights 7, 3, 1; letters from 10, fillers 0."""
    chars = F.filter(F.split(field, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(F.lit(0))
    weighted = F.transform(chars, lambda c, i: value(c) * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1))
    return F.aggregate(weighted, F.lit(0), lambda s, x: s + x) % 10


#: Zones that a bare domain may end in.
ZONES = "com|org|net|info|biz|edu|gov|io|eu|ru|uk|de|fr|es|it|nl|pl|ch|at|be|us|ca|invalid|example|test|рф"
#: A domain by itself: a known zone in lower case (or the whole host in capitals), two characters or more before it (three letters before a
#: two-letter zone, unless a path follows), no at-sign beside it; then a port and a path.
BARE = rf"(?<![\p{{L}}\p{{N}}@/._-])(?:(?:[\p{{L}}\p{{N}}-]+\.)*(?:[\p{{L}}\p{{N}}-]*\p{{L}}[\p{{L}}\p{{N}}-]*\p{{L}}[\p{{L}}\p{{N}}-]*\p{{L}}[\p{{L}}\p{{N}}-]*|(?=[\p{{L}}\p{{N}}-]*\p{{L}})[\p{{L}}\p{{N}}-]{{2,}}(?=\.\p{{L}}{{3}})|(?=[\p{{L}}\p{{N}}-]*\p{{L}})[\p{{L}}\p{{N}}-]+(?=\.\p{{L}}+/))\.(?:{ZONES}))(?![\p{{L}}\p{{N}}@_-])(?::[0-9]{{1,5}})?(?:/[^\s<>\"'\]]*[^\s<>\"'\].,;:!?)])?"
#: Trailing marks that an address doesn't end with are cut off a match of URL by its last character class.
ANY_URL = f"{URL}|{BARE}"


def host_of(url: Column) -> Column:
    """The host of an address, in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@\s]*@)?([^/?#:]+)", 1))


def mrz_lines(text: Column) -> Column:
    """Machine-readable zones of travel documents in a text: kind (TD1, TD2, TD3), surname, given names, number, whether the number's check
    digit holds. Letters that a scanner takes for digits are read as digits in the number's check digit."""
    lines = F.split(F.regexp_replace(F.upper(text), " ", ""), "\n")
    digit = lambda c: F.translate(c, "OILSB", "01158")

    def zone(kind: str, first: Column, second: Column, name: Column) -> Column:
        number = F.substring(first, 6, 9) if kind == "TD1" else F.substring(second, 1, 9)
        check = digit(F.substring(first, 15, 1) if kind == "TD1" else F.substring(second, 10, 1))
        names = F.split(name, "<<")
        clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<+", " "))
        return F.struct(F.lit(kind).alias("kind"), clean(F.get(names, F.lit(0))).alias("surname"), clean(F.get(names, F.lit(1))).alias("given"), F.regexp_replace(number, "<+$", "").alias("number"), F.coalesce(icao_check(number) == check.try_cast("int"), F.lit(False)).alias("holds"))

    def at(k: Column, ls: Column) -> Column:
        a, b, c = F.get(ls, k), F.get(ls, k + 1), F.get(ls, k + 2)
        passport = a.rlike("^P[A-Z<][A-Z<]{42}$") & b.rlike("^[A-Z0-9<]{44}$")
        card = a.rlike("^[ACI][A-Z0-9<]{29}$") & b.rlike("^[A-Z0-9<]{30}$") & c.rlike("^[A-Z<]{30}$")
        visa = a.rlike("^[ACIV][A-Z<][A-Z<]{34}$") & b.rlike("^[A-Z0-9<]{36}$")
        return F.when(passport, zone("TD3", a, b, F.substring(a, 6, 39))).when(card, zone("TD1", a, b, c)).when(visa, zone("TD2", a, b, F.substring(a, 6, 31)))

    found = let(lines, lambda ls: F.array_compact(F.transform(F.sequence(F.lit(0), F.size(ls) - 1), lambda k: at(k, ls))))
    return F.when(text.rlike("<<"), found).otherwise(F.array().cast("array<struct<kind:string,surname:string,given:string,number:string,holds:boolean>>"))


#: Initials: capitals with or without periods ('J.B.', 'Я. В.', 'JB'), as they may stand for a person named beside them.
INITIALS = r"(?<![\p{L}\p{N}.])(?:\p{Lu}\. ?){1,2}\p{Lu}\.?(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\p{Lu}{2,3}(?![\p{L}\p{N}])"


def initials_of(name: Column) -> Column:
    """The capitals that a name of two words or more begins with."""
    words = F.filter(F.split(name, r"[\s-]+"), lambda w: w.rlike(r"^\p{Lu}"))
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def placed_initials(initials: DataFrame, persons: DataFrame) -> DataFrame:
    """Initials (doc_id, start_cp, end_cp, value) that fit exactly one person (doc_id, value) of the same document, in either order of the
    names: doc_id, start_cp, end_cp, value, person."""
    own = persons.select("doc_id", F.col("value").alias("person"), initials_of(F.col("value")).alias("i")).where("i is not null").distinct()
    keys = own.select("doc_id", "person", F.explode(F.array_distinct(F.array("i", F.concat(F.substring("i", -1, 1), F.expr("substring(i, 1, length(i) - 1)")), F.concat(F.expr("substring(i, 2)"), F.substring("i", 1, 1))))).alias("i")).distinct()
    one = keys.groupBy("doc_id", "i").agg(F.count("*").alias("n"), F.min("person").alias("person")).where("n = 1").select("doc_id", "i", "person")
    return initials.withColumn("i", F.regexp_replace("value", r"[^\p{L}]", "")).join(one, ["doc_id", "i"]).select("doc_id", "start_cp", "end_cp", "value", "person")


def guess_category(value: Column, line: Column) -> Column:
    """The category of a manual selection: a checksum's number with its label on the line, an e-mail or web address, the shape of a bank,
    card, phone or case number, else OTHER."""
    bare = F.regexp_replace(value, "[^0-9]", "")
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(line.rlike(TAX_LABEL) & inn_valid(bare), "TAX").when(line.rlike(REGISTRATION_LABEL) & registration_valid(bare), "TAX").when(line.rlike(SNILS_LABEL) & snils_valid(bare), "IDENTITY")
        .when(whole(EMAIL), "EMAIL").when(whole(ANY_URL), "URL").when(whole(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"), "BANK").when(whole(r"(?:[0-9]{4}[ -]?){3}[0-9]{4}") & luhn_valid(value), "BANK")
        .when(whole(r"\+[0-9][0-9 ()-]{7,17}[0-9]"), "PHONE").when(whole(r"(?i)[\p{L}0-9]{1,4}-[0-9]{1,7}(?:-[0-9]+)?/[0-9]{2,4}"), "CASE").otherwise("OTHER")
    )


def luhn_valid(number: Column) -> Column:
    chars = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike("[0-9]")))
    double = F.transform(chars, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(double, F.lit(0), lambda s, x: s + x) % 10 == 0


def _labelled(text: Column, label: str, digits: str, valid, category: str) -> Column:
    """Numbers whose line holds the label within the 80 characters before them, and whose checksum holds. Texts without the label are
    not searched for digits at all."""
    spans = find_spans(text, rf"(?<![0-9]){digits}(?![0-9])")
    before = lambda c, s: F.element_at(F.split(part(c, F.greatest(s["start"] - 80, F.lit(0)), s["start"]), "\n"), -1)
    bare = lambda s: F.regexp_replace(s["text"], "[^0-9]", "")
    return F.when(text.rlike(label), let(chunks(text), lambda c: F.filter(spans, lambda s: valid(bare(s)) & before(c, s).rlike(label)))).otherwise(F.array().cast(SPAN))


def _kind(spans: Column, category: str, score: float, recognizer: str) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(category).alias("category"), F.lit(score).alias("score"), F.lit(recognizer).alias("recognizer"), F.lit(True).alias("is_rule"))
    )


def rule_spans(text: Column, extensions: bool = True) -> Column:
    """All rule detections of a text."""
    found = [
        _kind(find_spans(text, EMAIL), "EMAIL", 0.9, "email"),
        _kind(find_spans(text, URL), "URL", 1.0, "url"),
        _kind(_labelled(text, TAX_LABEL, "(?:[0-9]{12}|[0-9]{10})", inn_valid, "TAX"), "TAX", 0.95, "inn"),
        _kind(_labelled(text, REGISTRATION_LABEL, "(?:[0-9]{15}|[0-9]{13})", registration_valid, "TAX"), "TAX", 0.95, "registration"),
        _kind(_labelled(text, SNILS_LABEL, "[0-9]{3}-?[0-9]{3}-?[0-9]{3}[ -]?[0-9]{2}", snils_valid, "IDENTITY"), "IDENTITY", 0.95, "snils"),
    ]
    if extensions:
        found += [_kind(F.filter(find_spans(text, CARD), lambda s: luhn_valid(s["text"])), "X-CARD", 0.8, "card"), _kind(find_spans(text, IP), "X-IP", 0.8, "ip")]
    return F.concat(*found)


def detections(docs: DataFrame, extensions: bool = True) -> DataFrame:
    """One row per detection."""
    return docs.select("doc_id", F.inline(rule_spans(F.col("text"), extensions)))


def email_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.inline(find_spans(F.col("text"), EMAIL))).select("doc_id", "lang", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("value"))


def sql_spans(pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """DuckDB: (key, start_cp, end_cp, value) of a pattern's matches, by running lengths between marks."""
    return f"""(SELECT {key}, (e - length(piece))::INTEGER AS start_cp, e::INTEGER AS end_cp, piece AS value FROM (
      SELECT {key}, piece, i, sum(length(piece)) OVER (PARTITION BY {key} ORDER BY i) AS e FROM (
        SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
          SELECT {key}, string_split(regexp_replace({text}, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS p
          FROM {source} WHERE regexp_matches({text}, '{pattern}')))) WHERE i % 2 = 0)"""


EMAIL_SQL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+"
EMAIL_DETECT_SQL = f"SELECT s.doc_id, lang, start_cp, end_cp, value FROM {sql_spans(EMAIL_SQL_PATTERN)} s JOIN documents d USING (doc_id)"


def email_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = email_detect(spark, sf_dir)
    return found.groupBy("lang").agg(F.count("*").alias("n_mentions"), F.countDistinct(F.lower("value")).alias("n_distinct"), F.countDistinct("doc_id").alias("n_docs"))


EMAIL_BY_LANG_SQL = f"SELECT lang, count(*) AS n_mentions, count(DISTINCT lower(value)) AS n_distinct, count(DISTINCT doc_id) AS n_docs FROM ({EMAIL_DETECT_SQL}) GROUP BY lang"


def rules_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detections(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("value"), "category", "score", "recognizer", "is_rule")


_LUHN = "(SELECT sum(CASE WHEN k % 2 = 0 THEN (CASE WHEN c * 2 > 9 THEN c * 2 - 9 ELSE c * 2 END) ELSE c END) % 10 = 0 FROM (SELECT k, CAST(substring(value, 17 - k, 1) AS INTEGER) AS c FROM range(1, 17) r(k)))"
RULES_SCAN_SQL = f"""
SELECT doc_id, start_cp, end_cp, value, 'EMAIL' AS category, 0.9::DOUBLE AS score, 'email' AS recognizer, true AS is_rule FROM {sql_spans(EMAIL_SQL_PATTERN)}
UNION ALL SELECT doc_id, start_cp, end_cp, value, 'X-CARD', 0.8::DOUBLE, 'card', true FROM {sql_spans('[0-9]+')} s WHERE length(value) = 16 AND {_LUHN}
UNION ALL SELECT doc_id, start_cp, end_cp, value, 'X-IP', 0.8::DOUBLE, 'ip', true FROM {sql_spans('[0-9.]*[0-9]')} WHERE regexp_matches(value, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$')
"""


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every checksum on numbers made from order keys: how many of each kind are valid (a tenth or a hundredth, about)."""
    n = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select(
        F.lpad((n * 7919 % 10**10).cast("string"), 10, "0").alias("inn10"),
        F.lpad((n * 104729 % 10**12).cast("string"), 12, "0").alias("inn12"),
        F.lpad((n * 1299709 % 10**13).cast("string"), 13, "0").alias("reg13"),
        F.lpad((n * 15485863 % 10**15).cast("string"), 15, "0").alias("reg15"),
        F.lpad((n * 611953 % 10**11).cast("string"), 11, "0").alias("snils"),
        F.lpad((n * 32452843 % 10**16).cast("string"), 16, "0").alias("card"),
    )
    count = lambda c: F.count_if(c)
    return made.agg(
        count(inn_valid(F.col("inn10"))).alias("inn10"), count(inn_valid(F.col("inn12"))).alias("inn12"), count(registration_valid(F.col("reg13"))).alias("reg13"),
        count(registration_valid(F.col("reg15"))).alias("reg15"), count(snils_valid(F.col("snils"))).alias("snils"), count(luhn_valid(F.col("card"))).alias("card"), F.sum(icao_check(F.col("inn10"))).alias("icao_sum"),
    )


def _sql_weighted(column: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substring({column}, {k + 1}, 1) AS INTEGER) * {w}" for k, w in enumerate(weights)) + ")"


CHECKSUMS_SQL = f"""
WITH m AS (SELECT lpad((o_orderkey * 7919 % 10000000000)::VARCHAR, 10, '0') AS a, lpad((o_orderkey * 104729 % 1000000000000)::VARCHAR, 12, '0') AS b,
  lpad((o_orderkey * 1299709 % 10000000000000)::VARCHAR, 13, '0') AS c, lpad((o_orderkey * 15485863 % 1000000000000000)::VARCHAR, 15, '0') AS d,
  lpad((o_orderkey * 611953 % 100000000000)::VARCHAR, 11, '0') AS e, lpad((o_orderkey * 32452843 % 10000000000000000)::VARCHAR, 16, '0') AS f FROM orders)
SELECT count(*) FILTER (WHERE {_sql_weighted('a', [2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = CAST(right(a, 1) AS INTEGER)) AS inn10,
  count(*) FILTER (WHERE {_sql_weighted('b', [7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = CAST(substring(b, 11, 1) AS INTEGER)
    AND {_sql_weighted('b', [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = CAST(right(b, 1) AS INTEGER)) AS inn12,
  count(*) FILTER (WHERE CAST(left(c, 12) AS BIGINT) % 11 % 10 = CAST(right(c, 1) AS INTEGER)) AS reg13,
  count(*) FILTER (WHERE CAST(left(d, 14) AS BIGINT) % 13 % 10 = CAST(right(d, 1) AS INTEGER)) AS reg15,
  count(*) FILTER (WHERE e <> '00000000000' AND {_sql_weighted('e', [9, 8, 7, 6, 5, 4, 3, 2, 1])} % 101 % 100 = CAST(right(e, 2) AS INTEGER)) AS snils,
  count(*) FILTER (WHERE (SELECT sum(CASE WHEN k % 2 = 0 THEN (CASE WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END) ELSE x END) % 10 = 0
    FROM (SELECT k, CAST(substring(f, 17 - k, 1) AS INTEGER) AS x FROM range(1, 17) r(k)))) AS card,
  sum({_sql_weighted('a', [7, 3, 1] * 3 + [7])} % 10)::BIGINT AS icao_sum FROM m
"""


def url_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web addresses in pages' markup, and in their own address column with a period behind it."""
    pages = table(spark, sf_dir, "pages")
    texts = pages.select("page_id", F.lit("html").alias("place"), F.col("html").alias("text")).unionByName(pages.select("page_id", F.lit("url").alias("place"), F.concat("url", F.lit(". See")).alias("text")))
    return texts.select("page_id", "place", F.inline(find_spans(F.col("text"), URL))).select("page_id", "place", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("value"))


_SQL_URL = "(https?://|www[.])[^\\s<>\"''\\]]*[^\\s<>\"''\\].,;:!?)]"
URL_DETECT_SQL = f"SELECT page_id, 'html' AS place, start_cp, end_cp, value FROM {sql_spans(_SQL_URL, 'pages', 'page_id', 'html')} UNION ALL SELECT page_id, 'url', 0, length(url)::INTEGER, url FROM pages"

def _check(weights: list[int], digits: str, length: int) -> str:
    """SQL that Spark and DuckDB read alike: a weighted sum modulo 11, then 10, of a string of digits."""
    return "(" + " + ".join(f"CAST(substring({digits}, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(weights)) + ") % 11 % 10"


#: Nine digits and the check digit that makes them a taxpayer's number.
_NINE = "lpad(CAST((o_orderkey * 7919) % 1000000000 AS STRING), 9, '0')"
_TEN = f"concat({_NINE}, CAST({_check([2, 4, 10, 3, 5, 9, 4, 6, 8], _NINE, 9)} AS STRING))"
#: Twelve digits and the registration number's check digit.
_TWELVE = "lpad(CAST((o_orderkey * 104729) % 1000000000000 AS STRING), 12, '0')"
_THIRTEEN = f"concat({_TWELVE}, CAST(CAST({_TWELVE} AS BIGINT) % 11 % 10 AS STRING))"
LABELLED_NOTE = f"""concat('Write to o''venn+', o_orderkey, '@kéy.example; see www.site', o_orderkey % 7, '.org/a). ИНН: ', {_TEN}, ', ОГРН ', {_THIRTEEN}, '; tax id
', {_TEN}, ' shop', o_orderkey % 5, '.example:8080/x, v1.de file.No 5 me@shop.example')"""


def labelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules-only scan of texts made from orders, whose numbers have right check digits: a number on the line after its label is none."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(LABELLED_NOTE).alias("text"))
    found = detections(docs, extensions=False).select("doc_id", F.col("text").alias("value"), "category", "recognizer")
    bare = docs.select("doc_id", F.inline(find_spans(F.col("text"), BARE))).select("doc_id", F.col("text").alias("value"), F.lit("URL").alias("category"), F.lit("domain").alias("recognizer"))
    return found.unionByName(bare)


LABELLED_NUMBERS_SQL = f"""
WITH n AS (SELECT o_orderkey AS k, {_TEN.replace('STRING', 'VARCHAR')} AS a, {_THIRTEEN.replace('STRING', 'VARCHAR')} AS b FROM orders)
SELECT k AS doc_id, 'o''venn+' || k || '@kéy.example' AS value, 'EMAIL' AS category, 'email' AS recognizer FROM n UNION ALL SELECT k, 'me@shop.example', 'EMAIL', 'email' FROM n UNION ALL SELECT k, 'www.site' || (k % 7) || '.org/a', 'URL', 'url' FROM n
UNION ALL SELECT k, a, 'TAX', 'inn' FROM n UNION ALL SELECT k, b, 'TAX', 'registration' FROM n
UNION ALL SELECT k, 'www.site' || (k % 7) || '.org/a', 'URL', 'domain' FROM n UNION ALL SELECT k, 'shop' || (k % 5) || '.example:8080/x', 'URL', 'domain' FROM n
"""


def zones_and_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine-readable zones made from customers (one in five numbers is damaged), with initials that fit one person or more."""
    k = F.col("c_custkey")
    number = F.lpad(k.cast("string"), 9, "0")
    check = icao_check(number).cast("string")
    shown = F.when(k % 5 == 0, ((icao_check(number) + 1) % 10).cast("string")).otherwise(F.translate(check, "05", "OS"))
    first = F.rpad(F.concat(F.lit("P<UTOROE"), F.translate((k % 26).cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("<<ANN<MARY")), 44, "<")
    second = F.rpad(F.concat(number, shown, F.lit("UTO6908061F9406236")), 44, "<")
    text = F.concat(F.lit("Scan\n"), first, F.lit("\n"), second, F.lit("\nAnn Roe met John Brown; A.R. wrote to JB and X. Y."))
    docs = table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))
    zones = docs.select("doc_id", F.inline(mrz_lines(F.col("text")))).select("doc_id", F.concat_ws("/", "kind", "surname", "given", "number", "holds").alias("found"))
    spans = lambda p: docs.select("doc_id", F.inline(find_spans(F.col("text"), p))).select("doc_id", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("value"))
    placed = placed_initials(spans(INITIALS), spans("Ann Roe|John Brown")).select("doc_id", F.concat_ws("=", "value", "person").alias("found"))
    return zones.unionByName(placed)


ZONES_SQL = """
SELECT c_custkey AS doc_id, unnest(['TD3/ROE' || translate((c_custkey % 26)::VARCHAR, '0123456789', 'ABCDEFGHIJ') || '/ANN MARY/' || lpad(c_custkey::VARCHAR, 9, '0') || '/' || CASE WHEN c_custkey % 5 = 0 THEN 'false' ELSE 'true' END, 'A.R.=Ann Roe', 'JB=John Brown']) AS found FROM customer
"""


def manual_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses for selections made from orders: numbers with and without their label, addresses, phones, cases."""
    made = table(spark, sf_dir, "orders").select(F.expr(f"inline(array(struct({_TEN} AS value, 'my tax id' AS line), struct({_TEN} AS value, 'some number' AS line), struct(concat('a', o_orderkey, '@ex.org') AS value, '' AS line), struct('shop.example/a' AS value, '' AS line), struct(concat('+1 (743) 555-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) AS value, '' AS line), struct(concat('A40-', o_orderkey, '/2024') AS value, '' AS line)))"))
    return made.groupBy(guess_category(F.col("value"), F.col("line")).alias("category")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


GUESSES_SQL = f"""
WITH v AS (SELECT {_TEN.replace('STRING', 'VARCHAR')} AS t, o_orderkey AS k FROM orders)
SELECT 'TAX' AS category, count(*) AS n, count(DISTINCT t) AS n_values FROM v UNION ALL SELECT 'OTHER', count(*), count(DISTINCT t) FROM v UNION ALL SELECT 'EMAIL', count(*), count(DISTINCT k) FROM v UNION ALL SELECT 'URL', count(*), 1 FROM v
UNION ALL SELECT 'PHONE', count(*), count(DISTINCT k % 10000) FROM v UNION ALL SELECT 'CASE', count(*), count(DISTINCT k) FROM v
"""

QUERIES = [
    ("labelled_numbers", labelled_numbers, LABELLED_NUMBERS_SQL), ("zones_and_initials", zones_and_initials, ZONES_SQL), ("manual_guesses", manual_guesses, GUESSES_SQL),
    ("email_detect", email_detect, EMAIL_DETECT_SQL), ("email_by_lang", email_by_lang, EMAIL_BY_LANG_SQL), ("rules_scan", rules_scan, RULES_SCAN_SQL),
    ("checksums", checksums, CHECKSUMS_SQL), ("url_detect", url_detect, URL_DETECT_SQL),
]
