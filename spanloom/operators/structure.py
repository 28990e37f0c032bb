"""Structure of Markdown texts: lines, blocks, tables, windows; and the normalised view that a scan reads.

Defined cases: a null text has no lines and reads as the empty view; repeated rows are read each; where rewrites overlap, insertions come first,
then the earliest, then the longest; a text of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from spanloom.operators.syntax import read_inline
from spanloom.sources.tables import table

STRIDE, WINDOW_WORDS = 96, 128
SPACE_RE = r"[\x20\x09-\x0D]+"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_class(line: Column) -> Column:
    """What a Markdown line is: blank, heading, rule, quote, list, task, footnote, table, html, text."""
    return (
        F.when(F.trim(line) == "", "blank").when(line.rlike(r"^ {0,3}#{1,6}(\s|$)"), "heading").when(line.rlike(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"), "rule")
        .when(line.rlike(r"^ {0,3}>"), "quote").when(line.rlike(r"^\s*[-*+] \[[ xX]\] "), "task").when(line.rlike(r"^\s*(?:[-*+]|[0-9]{1,9}[.)])\s"), "list")
        .when(line.rlike(r"^\[\^[^\]]+\]:"), "footnote").when(line.rlike(r"(?<!\\)\|"), "table").when(line.rlike(r"^ {0,3}</?[A-Za-z]"), "html").otherwise("text")
    )


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})(?:\s|$)", 1))


def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs: runs of lines between lines that end in a period, per document (blocks by gaps and islands)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    numbered = lines(table(spark, sf_dir, "documents")).withColumn("is_break", F.coalesce(F.lag("line").over(w).endswith("."), F.lit(False)).cast("int"))
    block = numbered.withColumn("block", F.sum("is_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return block.groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.sum(F.length("line")).alias("n_chars"))


PARAGRAPH_SQL = """
WITH l AS (SELECT doc_id, unnest(p) AS line, (generate_subscripts(p, 1) - 1)::INTEGER AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
b AS (SELECT *, coalesce(CASE WHEN suffix(lag(line) OVER w, '.') THEN 1 ELSE 0 END, 0) AS br FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
k AS (SELECT *, (sum(br) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS block FROM b)
SELECT doc_id, block, count(*) AS n_lines, min(line_no) AS first_line, sum(length(line))::BIGINT AS n_chars FROM k GROUP BY 1, 2
"""


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each class a language has; every third line is given a Markdown mark first."""
    marks = F.array(*[F.lit(m) for m in ("", "# ", "### ", "- ", "1. ", "> ", "- [x] ", "[^a]: ", "<p>", "***")])
    mark = F.get(marks, (F.col("doc_id") + F.col("line_no")) % 10)
    docs = table(spark, sf_dir, "documents")
    marked = lines(docs).select("doc_id", F.concat(mark, "line").alias("line")).join(docs.select("doc_id", "lang"), "doc_id")
    return marked.groupBy("lang", line_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"), F.sum(heading_level(F.col("line"))).alias("levels"))


LINE_CLASSES_SQL = r"""
WITH l AS (SELECT doc_id, lang, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS k FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents)),
m AS (SELECT lang, ['', '# ', '### ', '- ', '1. ', '> ', '- [x] ', '[^a]: ', '<p>', '***'][1 + (doc_id + k) % 10] || line AS line FROM l)
SELECT lang, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^ {0,3}#{1,6}(\s|$)') THEN 'heading'
  WHEN regexp_matches(line, '^ {0,3}((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})$') THEN 'rule' WHEN regexp_matches(line, '^ {0,3}>') THEN 'quote'
  WHEN regexp_matches(line, '^\s*[-*+] \[[ xX]\] ') THEN 'task' WHEN regexp_matches(line, '^\s*([-*+]|[0-9]{1,9}[.)])\s') THEN 'list'
  WHEN regexp_matches(line, '^\[\^[^\]]+\]:') THEN 'footnote' WHEN regexp_matches(line, '(^|[^\\])\|') THEN 'table' WHEN regexp_matches(line, '^ {0,3}</?[A-Za-z]') THEN 'html' ELSE 'text' END AS class,
  count(*) AS n, sum(length(regexp_extract(line, '^ {0,3}(#{1,6})(\s|$)', 1)))::BIGINT AS levels FROM m GROUP BY 1, 2
"""


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of lines with unescaped pipes: position, code-point range, whether the line is the first of its run (a header)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(table(spark, sf_dir, "documents")).where(F.col("line").rlike(r"(?<!\\)\|"))
    head = rows.withColumn("is_header", F.coalesce(F.lag("line_no").over(w) != F.col("line_no") - 1, F.lit(True)))
    cells = head.select("doc_id", "line_no", "is_header", F.posexplode(F.split("line", r"(?<!\\)\|")).alias("col_no", "cell"))
    c = Window.partitionBy("doc_id", "line_no").orderBy("col_no")
    placed = cells.withColumn("end_cp", F.sum(F.length("cell") + 1).over(c.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return placed.select("doc_id", "line_no", "col_no", "is_header", (F.col("end_cp") - F.length("cell")).alias("start_cp"), "end_cp", F.trim("cell").alias("value"))


TABLE_CELLS_SQL = """
WITH l AS (SELECT doc_id, unnest(p) AS line, (generate_subscripts(p, 1) - 1)::INTEGER AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
h AS (SELECT *, coalesce(lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) <> line_no - 1, true) AS is_header FROM l WHERE contains(line, '|')),
c AS (SELECT doc_id, line_no, is_header, unnest(string_split(line, '|')) AS cell, (generate_subscripts(string_split(line, '|'), 1) - 1)::INTEGER AS col_no FROM h),
e AS (SELECT *, (sum(length(cell) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY col_no) - 1)::BIGINT AS end_cp FROM c)
SELECT doc_id, line_no, col_no, is_header, (end_cp - length(cell))::BIGINT AS start_cp, end_cp, trim(cell, ' ') AS value FROM e
"""


def column_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the header of their column: header fill down a run of table lines."""
    cells = table_cells(spark, sf_dir)
    w = Window.partitionBy("doc_id", "col_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = cells.withColumn("header", F.last(F.when(F.col("is_header"), F.col("value")), ignorenulls=True).over(w)).where(~F.col("is_header") & (F.col("value") != ""))
    return filled.select("doc_id", "line_no", "col_no", "header", "value")


COLUMN_HEADERS_SQL = f"""
WITH c AS ({TABLE_CELLS_SQL}), f AS (SELECT *, last_value(CASE WHEN is_header THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id, col_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS header FROM c)
SELECT doc_id, line_no, col_no, header, value FROM f WHERE NOT is_header AND value <> ''
"""


def long_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 words, 96 apart, over each text's words."""
    n = F.size(F.array_remove(F.split("text", SPACE_RE), ""))
    starts = table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words")).where("n_words > 0").select("doc_id", "n_words", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1 - (WINDOW_WORDS - STRIDE), F.lit(0)), F.lit(STRIDE))).alias("start_word"))
    return starts.select("doc_id", "start_word", F.least(F.col("start_word") + WINDOW_WORDS, "n_words").alias("end_word"))


LONG_LINE_SQL = r"""
WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, s::INTEGER AS start_word, least(s + 128, n)::INTEGER AS end_word FROM (SELECT doc_id, n, unnest(range(0, greatest(n - 33, 0) + 1, 96)) AS s FROM n WHERE n > 0)
"""


def pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy windows of whole lines up to 128 words: a line opens a new window when it doesn't fit."""
    sizes = F.transform(F.split("text", "\n"), lambda x: F.size(F.array_remove(F.split(x, SPACE_RE), "")))

    def step(s: Column, n: Column) -> Column:
        fits = s["open"] + n <= WINDOW_WORDS
        return F.struct(F.when(fits, s["open"] + n).otherwise(n).cast("int").alias("open"), (s["windows"] + F.when(fits, 0).otherwise(1)).cast("int").alias("windows"), F.greatest(s["most"], F.when(fits, s["open"] + n).otherwise(n)).cast("int").alias("most"))

    zero = F.struct(F.lit(0).alias("open"), F.lit(1).alias("windows"), F.lit(0).alias("most"))
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(sizes, zero, step).alias("p")).select("doc_id", F.col("p.windows").alias("n_windows"), F.col("p.most").alias("most_words"))


def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct line once, as a model would read it, with how often and where first it stands."""
    found = lines(table(spark, sf_dir, "documents")).where(F.trim("line") != "")
    return found.groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("f")).select("line_md5", "n", F.col("f.doc_id").alias("first_doc"), F.col("f.line_no").alias("first_line"))


DISTINCT_LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(p) AS line, (generate_subscripts(p, 1) - 1)::INTEGER AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
g AS (SELECT md5(line) AS line_md5, count(*) AS n, min(struct_pack(d := doc_id, k := k)) AS f FROM l WHERE trim(line) <> '' GROUP BY 1) SELECT line_md5, n, f.d AS first_doc, f.k AS first_line FROM g
"""

# --- the view ---------------------------------------------------------------------------------------------------------

INVISIBLE = "­​‌‍⁠﻿"
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
BROKEN_LINE = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t]*(?=[^\W\d_])")
FOOTNOTE = re.compile(r"\[\^[^\]\s]+\](?!:)")


CAPITAL = "[A-ZÀ-ÖØ-Þ]", "[Ѐ-Я]"
SPACED = re.compile("|".join(rf"(?<!\w){c}(?: {c})+(?: {{2,}}{c}(?: {c})+)*(?!\w)" for c in CAPITAL))
NOTE_MARK = re.compile(r"(?<=[^\W\d_])(?=[¹²³⁰⁴-⁹])")
MOJIBAKE = re.compile(r"(?<=[^\W\d_])Â+(?!\w)")
BETWEEN_MARKS = re.compile(r"(?<=\w)(\*{1,3}|_{1,3}) \1(?=\w)")
SMALL_TAG = re.compile(r"</?su[bp]>", re.I)
DESTINATION = re.compile(r"\]\((?!(?:mailto|tel|data|javascript):)([^()\s]*)")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+|_")
DELIMITER_ROW = re.compile(r" {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
PIPE = re.compile(r"(?<!\\)\|")
#: Column headers that name an identifier.
IDENTIFIER_HEADERS = frozenset(
    "паспорт|паспорт рф|номер паспорта|серия и номер|инн|снилс|огрн|огрнип|кпп|бик|счет|номер счета|расчетный счет|р/с|карта|номер карты|полис|телефон|номер телефона|e-mail|email|почта|"
    "tax id|tin|ein|ssn|ni number|passport|passport number|account|account number|bank account|iban|sort code|routing number|card|card number|policy|policy number|phone|phone number|telephone".split("|")
)


def header_name(header: str) -> str:
    """A column header in lower case without marks and 'No.'."""
    return " ".join(w for w in re.sub("[*:#№]", " ", header.lower().replace("ё", "е")).split() if w not in ("no", "no."))


def _spaced_words(text: str) -> list[tuple[int, int, str]]:
    """Letter-spaced words ('И Н Н'): the spaces go where the run has a word of three letters and stands apart from words beside it."""
    out = []
    for m in SPACED.finditer(text):
        before, after = text[: m.start()].rpartition("\n")[2], text[m.end() :].partition("\n")[0]
        near = lambda side: bool(re.match(r"[*_~]*\s{0,2}[*_~]*[^\W_]", side))
        if near(before[::-1]) or near(after) or not any(len(w) >= 5 for w in re.split(" {2,}", m[0])):
            continue
        out += [(m.start() + g.start(), m.start() + g.end(), "" if len(g[0]) == 1 else " ") for g in re.finditer(" +", m[0])]
    return out


def _headed_cells(text: str) -> list[tuple[int, int, str]]:
    """Before each value with a digit or an at-sign in an identifier's column: its header, as an insertion."""
    out, lines, at = [], text.split("\n"), 0
    headers: list[str | None] = []
    for k, line in enumerate(lines):
        cells = PIPE.split(line.strip().removeprefix("|").removesuffix("|"))
        if k + 1 < len(lines) and "|" in line and DELIMITER_ROW.match(lines[k + 1]) and len(PIPE.split(lines[k + 1].strip().removeprefix("|").removesuffix("|"))) == len(cells):
            headers = [c.strip(" *:") if header_name(c) in IDENTIFIER_HEADERS else None for c in cells]
        elif not line.strip():
            headers = []
        elif headers and not DELIMITER_ROW.match(line):
            place = at + len(line) - len(line.lstrip()) + line.lstrip().startswith("|")
            for cell, name in zip(cells, headers, strict=False):
                if name and re.search("[0-9@]", cell):
                    start = place + len(cell) - len(cell.lstrip())
                    out.append((start, start, f"{name}: "))
                place += len(cell) + 1
        at += len(line) + 1
    return out


def _inline_joins(text: str) -> list[tuple[int, int, str]]:
    """Marks inside or between emphasised words, which a reader doesn't see."""
    out = [(m.start(), m.end(), " ") for m in BETWEEN_MARKS.finditer(text)] + [(m.start(), m.end(), "") for m in SMALL_TAG.finditer(text)]
    if "*" in text:
        for start, end, kind, n, m in read_inline(text):
            # emphasis of a part of a word: its marks go on both sides
            if kind in ("emphasis", "strong") and (text[end : end + 1].isalnum() or text[max(start - 1, 0) : start].isalnum()):
                out += [(start, start + n, ""), (end - m, end, "")]
    return out


def _destinations(text: str) -> list[tuple[int, int, str]]:
    """Link destinations as they read: percent codes decoded, underscores as spaces; opaque schemes are left alone."""
    out = []
    for m in DESTINATION.finditer(text):
        for p in PERCENT.finditer(m[1]):
            value = " " if p[0] == "_" else bytes.fromhex(p[0].replace("%", "")).decode("utf-8", "replace")
            if "\ufffd" not in value:
                out.append((m.start(1) + p.start(), m.start(1) + p.end(), value))
    return out


def decoded(text: str | None) -> str:
    """A text as a scan reads it, without the way back."""
    return read_view(text or "")[0]


def wording(text: str | None) -> str:
    """A value as a scan reads it, white space as one space, none at the ends."""
    return " ".join(decoded(text).split())


def _references(text: str) -> list[tuple[int, int, str]]:
    """Character references, decoded."""
    return [(m.start(), m.end(), value) for m in ENTITY.finditer(text) if (value := html.unescape(m[0])) != m[0]]


def markup_view(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A view of markup, with nothing but character references decoded: the other rewrites are for Markdown ('A A A' in a page's title is
    no letter-spaced word)."""
    return _applied(text, _references(text))


def discovery_view(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A view with nothing but the joins of emphasised words: repeats are looked for in it, which other rewrites would make too many of."""
    return _applied(text, _inline_joins(text))


def read_view(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A text as a scan reads it, with the edits (source start, end, view start, end) that lead back.

    Character references are decoded, invisible characters dropped, full-width forms narrowed, base and marks composed, words joined over
    a line-end hyphen or letter by letter, footnote references dropped, marks inside emphasised words dropped, link destinations
    decoded, note marks set apart, and identifier columns' headers repeated before their values. Where rewrites overlap, the first wins.
    """
    rewrites: list[tuple[int, int, str]] = _spaced_words(text) + _headed_cells(text) + _inline_joins(text) + _destinations(text)
    rewrites += [(m.start(), m.start(), " ") for m in NOTE_MARK.finditer(text)] + [(m.start(), m.end(), " ") for m in MOJIBAKE.finditer(text)]
    rewrites += _references(text)
    rewrites += [(m.start(), m.end(), "") for m in BROKEN_LINE.finditer(text)]
    rewrites += [(m.start(), m.end(), "") for m in FOOTNOTE.finditer(text)]
    if not text.isascii():
        i = 0
        while i < len(text):
            c, j = text[i], i + 1
            while j < len(text) and unicodedata.combining(text[j]):
                j += 1
            if j > i + 1 and (composed := unicodedata.normalize("NFC", text[i:j])) != text[i:j]:
                rewrites.append((i, j, composed))
            elif c in INVISIBLE:
                rewrites.append((i, i + 1, ""))
            elif "！" <= c <= "～":
                rewrites.append((i, i + 1, chr(ord(c) - 0xFEE0)))
            elif c == "　":
                rewrites.append((i, i + 1, " "))
            i = j
    return _applied(text, rewrites)


def _applied(text: str, rewrites: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, int, int]]]:
    out, edits, at, length = [], [], 0, 0
    for s, e, value in sorted(rewrites, key=lambda x: (x[0], x[0] < x[1], -x[1])):  # insertions, then the longest
        if s < at:
            continue
        out += [text[at:s], value]
        length += s - at
        edits.append((s, e, length, length + len(value)))
        length += len(value)
        at = e
    return "".join([*out, text[at:]]), edits


def source_range(start: int, end: int, edits) -> tuple[int, int]:
    """A view's range in the source; a boundary inside a rewritten part takes all of it."""

    def back(at: int, low: bool) -> int:
        shift = 0
        for s, e, a, b in edits:
            if (at <= a) if low else (at < b or at == b == a):
                return at - shift if at <= a else e
            if at < b:
                return s if low else e
            shift += (b - a) - (e - s)
        return at - shift

    return back(start, True), back(end, False)


def view_range(start: int, end: int, edits) -> tuple[int, int]:
    """A source range in the view; a boundary inside a rewritten part takes all of what it reads as."""

    def forth(at: int, low: bool) -> int:
        shift = 0
        for s, e, a, b in edits:
            if at <= s if low else at < e or at == s == e:
                return at + shift if at <= s else b
            if at < e:
                return a if low else b
            shift += (b - a) - (e - s)
        return at + shift

    return forth(start, True), forth(end, False)


EDIT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("src_start", "src_end", "view_start", "view_end")])
VIEW = T.StructType([T.StructField("text", T.StringType()), T.StructField("edits", T.ArrayType(EDIT))])


def _views(read, texts: pd.Series) -> pd.DataFrame:
    rows = [read(t or "") for t in texts]
    return pd.DataFrame({"text": [r[0] for r in rows], "edits": [[dict(zip(("src_start", "src_end", "view_start", "view_end"), e, strict=True)) for e in r[1]] for r in rows]})


@pandas_udf(VIEW)
def view(texts: pd.Series) -> pd.DataFrame:
    return _views(read_view, texts)


@pandas_udf(VIEW)
def markup(texts: pd.Series) -> pd.DataFrame:
    return _views(markup_view, texts)


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of pages' markup: character references decoded; sizes and number of edits, null for a page without markup."""
    seen = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("html").isNotNull(), markup("html")).alias("v"))
    return seen.select("page_id", F.length("v.text").alias("n_chars"), F.size("v.edits").alias("n_edits"))


_REFERENCES = ["&amp;", "&lt;", "&gt;", "&quot;", "&#x27;", "&copy;", "&middot;", "&nbsp;", "&#39;"]
_COUNT = {r: f"(len(string_split(html, '{r}')) - 1)" for r in _REFERENCES}

READ = """concat('R', cast(o_orderkey % 9 as string), ' P A S S  N O:', ' Ann**a** **Lee** **Roe** X<sup>2</sup> said', '¹ and RosalindÂ, see [x](A_b%20c', cast(o_orderkey % 5 as string), '.pdf) or [y](mailto:a_b@ex.org).
| Name | Passport |
|---|---|
| Ann | ', cast(o_orderkey as string), ' |
| Bob | none |')"""


def document_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of texts made from orders, with every rewrite but character references; and where the last cell's value reads."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(READ).alias("text"))
    seen = docs.select("doc_id", view("text").alias("v"))
    return seen.select("doc_id", F.col("v.text").alias("text"), F.size("v.edits").alias("n_edits"))


#: The letters after R and a digit are too close to a word to be letter-spaced; both gaps between emphasised words are joined.
DOCUMENT_VIEWS_SQL = """
SELECT o_orderkey AS doc_id, 'R' || (o_orderkey % 9) || ' P A S S  N O: Anna Lee Roe** X2 said ¹ and Rosalind , see [x](A b c' || (o_orderkey % 5) || '.pdf) or [y](mailto:a_b@ex.org).
| Name | Passport |
|---|---|
| Ann | Passport: ' || o_orderkey || ' |
| Bob | none |' AS text, 10::INTEGER AS n_edits FROM orders
"""

PAGE_VIEWS_SQL = f"""
SELECT page_id, (length(html) - ({' + '.join(f'{len(r) - 1} * {n}' for r, n in _COUNT.items())}))::INTEGER AS n_chars, ({' + '.join(_COUNT.values())})::INTEGER AS n_edits FROM pages
"""

QUERIES = [
    ("paragraph_islands", paragraph_islands, PARAGRAPH_SQL), ("line_classes", line_classes, LINE_CLASSES_SQL), ("table_cells", table_cells, TABLE_CELLS_SQL), ("column_headers", column_headers, COLUMN_HEADERS_SQL),
    ("long_line_windows", long_line_windows, LONG_LINE_SQL), ("pack_lines", pack_lines, None), ("line_windows_distinct", distinct_lines, DISTINCT_LINES_SQL), ("page_views", page_views, PAGE_VIEWS_SQL), ("document_views", document_views, DOCUMENT_VIEWS_SQL),
]
