"""Tables in texts: pipe tables with a delimiter row, values under labelled columns, names under name columns, edits of rows and columns.

Tables are found with windows over a document's lines (gaps and islands); cells are an explode of a line's pieces with running lengths
for offsets. Offsets are code points, half-open. Defined cases: a header needs a delimiter row of as many cells below it; a table ends at a
blank line; short rows have fewer cells, cells beyond the header are left out; escaped pipes are text; null texts have no tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import let, running_sums
from spanloom.sources.tables import table

DELIMITER = r"^ {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$"


def _pieces(line: Column) -> tuple[Column, Column]:
    """A row's cells as they stand, and the length of what comes before the first."""
    lead = F.length(F.regexp_extract(line, r"^\s*\|?", 0))
    body = F.regexp_replace(F.substring(line, lead + 1, F.length(line)), r"(?<!\\)\|\s*$", "")
    return F.split(body, r"(?<!\\)\|"), lead


def table_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, table_no, row_no (0 is the header), start_cp (of the line), line, columns (of the header), aligns."""
    found = docs.select(key, F.split(text, "\n").alias("_l")).where(F.col("_l").isNotNull())
    placed = found.select(key, F.posexplode(F.arrays_zip(F.col("_l").alias("line"), running_sums(F.transform("_l", lambda x: F.length(x) + 1)).alias("start_cp"))).alias("line_no", "x")).select(key, "line_no", "x.line", "x.start_cp")
    cells = F.size(_pieces(F.col("line"))[0])
    w = Window.partitionBy(key).orderBy("line_no")
    marked = placed.select("*", cells.alias("n"), F.col("line").rlike(DELIMITER).alias("rule"), (F.trim("line") == "").alias("blank"))
    before, after = F.lag(F.struct("line", "n", "rule")).over(w), F.lead(F.struct("n", "rule", "line")).over(w)
    marked = marked.select("*", before.alias("before"), after.alias("after"))
    head = F.col("line").contains("|") & ~F.col("rule") & F.coalesce(F.col("after.rule") & (F.col("after.n") == F.col("n")), F.lit(False))
    rule = F.col("rule") & F.coalesce(F.col("before.line").contains("|") & ~F.col("before.rule") & (F.col("before.n") == F.col("n")), F.lit(False))
    marked = marked.select("*", head.alias("head"), rule.alias("under"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    begun = marked.select("*", F.last(F.when(F.col("head"), F.col("line_no")), ignorenulls=True).over(run).alias("h"), F.last(F.when(F.col("blank"), F.col("line_no")), ignorenulls=True).over(run).alias("b"))
    inside = begun.where("h is not null and (b is null or b < h) and not under")
    aligns = F.transform(_pieces(F.col("after.line"))[0], lambda c: F.when(F.trim(c).rlike("^:-*:$"), "center").when(F.trim(c).rlike("^:"), "left").when(F.trim(c).rlike(":$"), "right").otherwise("none"))
    of = Window.partitionBy(key, "h").orderBy("line_no")
    rows = inside.select("*", (F.row_number().over(of) - 1).alias("row_no"), F.first(F.when(F.col("head"), F.col("n")), ignorenulls=True).over(of).alias("columns"), F.first(F.when(F.col("head"), aligns), ignorenulls=True).over(of).alias("aligns"))
    return rows.select(key, F.dense_rank().over(Window.partitionBy(key).orderBy("h")).alias("table_no"), "row_no", "start_cp", "line", "columns", "aligns")


def cells(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, table_no, row_no, col_no (from 0), start_cp, value (trimmed, without emphasis around it), align of each cell."""
    pieces, lead = _pieces(F.col("line"))

    def placed(p: Column) -> Column:
        at = running_sums(F.transform(p, lambda x: F.length(x) + 1))
        return F.arrays_zip(p.alias("raw"), at.alias("at"))

    opened = rows.select(key, "table_no", "row_no", "start_cp", lead.alias("lead"), "columns", "aligns", F.posexplode(let(pieces, placed)).alias("col_no", "c")).where("col_no < columns")
    mark = F.length(F.regexp_extract("c.raw", r"^\s*(\*\*|__|\*|_)?", 0))
    bare = F.regexp_replace(F.regexp_replace("c.raw", r"^\s*(?:\*\*|__|\*|_)?", ""), r"(?:\*\*|__|\*|_)?\s*$", "")
    wrapped = F.col("c.raw").rlike(r"^\s*(\*\*|__|\*|_).+\1\s*$")
    value = F.when(wrapped, bare).otherwise(F.trim("c.raw"))
    inner = F.when(wrapped, mark).otherwise(F.length("c.raw") - F.length(F.ltrim("c.raw")))
    return opened.select(key, "table_no", "row_no", "col_no", (F.col("start_cp") + F.col("lead") + F.col("c.at") + inner).cast("int").alias("start_cp"), value.alias("value"), F.get("aligns", F.col("col_no")).alias("align"))


def header_key(header: Column) -> Column:
    """A column header in lower case, without marks and 'No.', words single-spaced."""
    plain = F.regexp_replace(F.translate(F.lower(header), "ё*:#№", "е    "), r"(?<!\S)no\.?(?!\S)", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def with_headers(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Body cells with their column's header key: an equi join on document, table and column."""
    heads = found.where("row_no = 0").select(key, "table_no", "col_no", header_key(F.col("value")).alias("header"))
    return found.where("row_no > 0").join(heads, [key, "table_no", "col_no"])


def labelled_cells(found: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Values under columns whose header is a label (labels: header, category, value, a pattern the whole cell must match):
    key, start_cp, end_cp, value, category."""
    hits = with_headers(found, key).withColumnRenamed("value", "cell").join(labels, "header").where(F.regexp(F.col("cell"), F.concat(F.lit("^(?:"), F.col("value"), F.lit(")$"))))
    return hits.select(key, "start_cp", (F.col("start_cp") + F.length("cell")).cast("int").alias("end_cp"), F.col("cell").alias("value"), "category")


#: Headers of columns that hold a name or a part of one, cells that are none.
NAME_HEADERS = ["name", "full name", "first name", "last name", "surname", "given name", "фамилия", "имя", "отчество", "фио", "nom", "prénom", "nachname", "vorname", "apellido", "nombre"]
NOT_NAMES = ["total", "итого", "none", "n/a", "all", "name", "unknown"]
NAME_LIKE = r"^\p{Lu}[\p{L}'’ʼ]*[\p{L}](?:[-‐‑–]\p{L}+)*(?: (?:(?:de|di|da|van|von|der|la|le|el|al|bin)(?= )|\p{Lu}[\p{L}'’ʼ]*\p{L}(?:[-‐‑–]\p{L}+)*|\p{Lu}\.)){0,3}$"


def name_cells(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells under name columns that look like names; a header repeated in the body, a total and a placeholder are none."""
    named = with_headers(found, key).where(F.col("header").isin(NAME_HEADERS) & F.col("value").rlike(NAME_LIKE) & ~header_key(F.col("value")).isin(NOT_NAMES + NAME_HEADERS))
    return named.select(key, "start_cp", (F.col("start_cp") + F.length("value")).cast("int").alias("end_cp"), "value", F.lit("PERSON").alias("category"))


def without_column(line: Column, column: Column) -> Column:
    """A row without one of its columns (from 0); a row that lacks it stays as it is."""
    pieces, _ = _pieces(line)
    return let(pieces, lambda p: F.when(column >= F.size(p), line).otherwise(F.concat(F.lit("|"), F.array_join(F.concat(F.slice(p, F.lit(1), column), F.slice(p, column + 2, F.size(p))), "|"), F.lit("|"))))


def with_column_after(line: Column, column: Column, value: Column) -> Column:
    """A row with a new cell after a column (from 0; -1 is before the first)."""
    pieces, _ = _pieces(line)
    return let(pieces, lambda p: F.concat(F.lit("|"), F.array_join(F.concat(F.slice(p, F.lit(1), column + 1), F.array(F.concat(F.lit(" "), value, F.lit(" "))), F.slice(p, column + 2, F.size(p))), "|"), F.lit("|")))


def _price_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per nation: its suppliers in a table, with a total, then a row after a blank line that belongs to none."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("| **Ann Lee-"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"), F.lit("** | 45 "), "s_suppkey", F.lit(r" \| x |")).alias("row"))
    rows = s.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    return rows.select(F.col("s_nationkey").alias("doc_id"), F.concat(F.lit("Nation "), "s_nationkey", F.lit("\n\n| Full  Name: | Passport No. |\n|:---|---:|\n"), "rows", F.lit("\n| Total | - | 9 |\n\n| Bob Roe | 46 1 |")).alias("text"))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and identity numbers in the tables of texts made from suppliers."""
    docs = _price_lists(spark, sf_dir)
    found = cells(table_rows(docs))
    labels = spark.createDataFrame([("passport", "IDENTITY", r"[0-9]{2} [0-9]+ .*"), ("name", "PERSON", ".*")], "header string, category string, value string")
    spans = name_cells(found).unionByName(labelled_cells(found, labels)).join(docs, "doc_id")
    return spans.select("doc_id", "value", "category", (F.expr("substring(text, start_cp + 1, end_cp - start_cp)") == F.col("value")).alias("in_place"))


TABLE_COLUMNS_SQL = r"""
SELECT s_nationkey AS doc_id, unnest(['Ann Lee-' || translate(s_suppkey::VARCHAR, '0123456789', 'abcdefghij'), '45 ' || s_suppkey || ' \| x']) AS value, unnest(['PERSON', 'IDENTITY']) AS category, true AS in_place FROM supplier
"""


def table_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables' rows with a column added, one taken out, and the header's alignment."""
    rows = table_rows(_price_lists(spark, sf_dir))
    added = with_column_after(F.col("line"), F.lit(0), F.concat(F.lit("r"), F.col("row_no").cast("string")))
    return rows.select("doc_id", "row_no", added.alias("added"), without_column(F.col("line"), F.lit(1)).alias("removed"), F.array_join("aligns", ",").alias("aligns"))


TABLE_EDITS_SQL = r"""
WITH s AS (SELECT s_nationkey AS d, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, ' **Ann Lee-' || translate(s_suppkey::VARCHAR, '0123456789', 'abcdefghij') || '** ' AS a, ' 45 ' || s_suppkey || ' \| x ' AS b FROM supplier),
r AS (SELECT d, i, a, '|' || b || '|' AS b FROM s UNION ALL SELECT d, 0, ' Full  Name: ', '| Passport No. |' FROM s GROUP BY d UNION ALL SELECT d, count(*) + 1, ' Total ', '| - | 9 |' FROM s GROUP BY d)
SELECT d AS doc_id, i::INTEGER AS row_no, '|' || a || '| r' || i || ' ' || b AS added, '|' || a || CASE WHEN a = ' Total ' THEN '| 9 |' ELSE '|' END AS removed, 'left,right' AS aligns FROM r
"""

QUERIES = [("table_columns", table_columns, TABLE_COLUMNS_SQL), ("table_edits", table_edits, TABLE_EDITS_SQL)]
