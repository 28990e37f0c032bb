"""Documents in: admission, HTML, CSV, pages; repeated headers, assembly, left-out notes, rejects.

Defined cases: null markup and paths give null or are not admitted; empty pages take part in no assembly; pages with equal numbers are ordered by
their text; repeated pages are read each; empty tables give no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from spanloom.sources.tables import table

#: What is admitted by extension, and the first bytes that tell a format.
EXTENSIONS = ["md", "markdown", "txt", "pdf", "doc", "docx", "docm", "xls", "xlsx", "xlsm", "ppt", "pptx", "odt", "ods", "odp", "rtf", "epub", "csv", "html"]
MAGIC = [("pdf", "25504446"), ("zip", "504B0304"), ("ole", "D0CF11E0"), ("rtf", "7B5C727466")]
MOST_BYTES = 2 * 1024 * 1024


def admitted(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(EXTENSIONS)


def sniff(content: Column) -> Column:
    """The format that the first bytes show, or null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*[F.when(head.startswith(magic), name) for name, magic in MAGIC])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified, content, format of the files below path that are admitted by extension or content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), "content", sniff(F.col("content")).alias("format")).where(admitted(F.col("path")) | F.col("format").isNotNull())


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """A CSV file's rows as lines of a Markdown table (pipes escaped)."""
    rows = spark.read.option("sep", sep).option("encoding", encoding).option("header", "true").csv(path)
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"\|", r"\\|") for c in rows.columns]), F.lit(" |")).alias("line"))


SKIPPED = {"script", "style", "head", "template", "noscript"}
BLOCKS = {"p", "div", "article", "section", "nav", "ul", "ol", "table", "tr", "blockquote", "pre", "header", "footer", "main", "aside", "form", "figure"}


def as_table(rows: list[list[str]]) -> str:
    """Rows as a pipe table; the first is the header, short rows are filled up."""
    rows = [[re.sub(r"\s*\n\s*", "<br>", c.strip()).replace("|", r"\|") for c in r] for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "s": "~~", "del": "~~", "mark": "=="}


class _Markdown(HTMLParser):
    """Builds Markdown in nested buffers: what an element holds is known before its marks are set."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.buffers: list[list[str]] = [[]]
        self.opened: list[tuple[str, str]] = []  # tag and link target of each buffer but the first
        self.skip: list[str] = []
        self.lists: list[list] = []  # kind and next number
        self.tables: list[list[list[str]]] = []
        self.depths: list[int] = []  # elements open outside each table

    def _write(self, text: str) -> None:
        self.buffers[-1].append(text)

    def _break(self) -> None:
        if self.buffers[-1] and not self.buffers[-1][-1].endswith("\n\n"):
            self._write("\n\n")

    def _open(self, tag: str, target: str = "") -> None:
        self.buffers.append([])
        self.opened.append((tag, target))

    def _close(self, tag: str) -> None:
        """Closes the innermost element of that tag, and what was left open inside it."""
        if tag not in [t for t, _ in self.opened]:
            return
        while True:
            name, target = self.opened.pop()
            inner = "".join(self.buffers.pop())
            bare = inner.strip()
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :] if bare else ""
            if name in MARKS:  # marks stand beside letters, white space goes outside
                self._write(f"{lead}{MARKS[name]}{bare}{MARKS[name]}{tail}" if bare else inner)
            elif name == "a":
                safe = re.match(r"(?:https?:|mailto:|[/#?.]|[^:]*$)", target, re.I)
                self._write(f"{lead}[{bare}]" + (f"({target})" if target and safe else "") + tail if bare else inner)
            elif self.tables:  # a cell
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append(re.sub(r"\n{2,}", "\n", bare))
            if name == tag:
                return

    def _close_cell(self) -> None:
        while len(self.opened) > self.depths[-1]:
            self._close(self.opened[-1][0])

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip.append(tag)
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self._break()
            self._write("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            if not self.lists:
                self._break()
            start = dict(attrs).get("start") or "1"
            self.lists.append([tag, int(start) if start.isdigit() else 1])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1]
            self._write("\n" + "   " * max(len(self.lists) - 1, 0) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
            kind[1] += 1
        elif tag == "br":
            self._write("\n")
        elif tag in MARKS:
            self._open(tag)
        elif tag == "a":
            self._open(tag, dict(attrs).get("href") or "")
        elif tag == "table":
            self._break()
            self.tables.append([])
            self.depths.append(len(self.opened))
        elif tag == "tr" and self.tables:
            self._close_cell()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self._close_cell()
            self._open(tag)
        elif tag in BLOCKS:
            self._break()

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag in MARKS or tag in ("a", "td", "th"):
            self._close(tag)
        elif tag == "table" and self.tables:
            self._close_cell()
            self.depths.pop()
            self._write(as_table(self.tables.pop()))
            self._break()
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            if not self.lists:
                self._break()
        elif tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            self._break()

    def handle_data(self, data):
        if not self.skip:
            self._write(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        while self.opened:
            self._close(self.opened[-1][0])
        while self.tables:
            self._write(as_table(self.tables.pop()))
        return "".join(self.buffers[0])


def to_markdown(markup: str | None) -> str | None:
    """HTML as Markdown: headings, numbered and nested lists, emphasis whose marks touch words, pipe tables, links with safe targets;
    scripts, styles and comments are left out. Null stays null; what is left open closes at the end."""
    if markup is None:
        return None
    parser = _Markdown()
    parser.feed(markup)
    parser.close()
    lines = [re.sub(r"(?<=\S)[ \t]+", " ", x).rstrip() for x in parser.text().split("\n")]
    text = "\n".join(x if re.match(r" +(?:-|[0-9]+\.) ", x) else x.lstrip() for x in lines)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@pandas_udf(T.StringType())
def markdown(column: pd.Series) -> pd.Series:
    return column.map(to_markdown)


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "pages").select("page_id", markdown("html").alias("t"))
    return text.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"), F.size(F.regexp_extract_all("t", F.lit(r"(?m)^#{1,6} "), F.lit(0))).alias("n_headings"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of pages' links with how often they occur."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


PAGE_LINKS_SQL = """SELECT target, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1"""


def drop_running_lines(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Lines per document and page without those that repeat, at the top or bottom of a page, an earlier page's line there;
    numbers count as different."""
    ls = pages.select(key, page, F.posexplode(F.split(text, "\n")).alias("line_no", "line"), F.size(F.split(text, "\n")).alias("n"))
    band = F.when(F.col("line_no") < 1, "top").when(F.col("line_no") >= F.col("n") - 1, "bottom")
    w = Window.partitionBy(key, "band", F.trim("line")).orderBy(page, "line_no")
    return ls.withColumn("band", band).withColumn("copy", F.row_number().over(w)).where("band IS NULL OR copy = 1 OR trim(line) = ''").select(key, page, "line_no", "line")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("\n", head, "text", F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("text"))


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages with a running title: what is left of each."""
    return drop_running_lines(_paged(spark, sf_dir), "conv_id", "turn", "text").groupBy("conv_id", "turn").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


RUNNING_SQL = """
WITH f AS (SELECT conv_id, min(turn) AS f FROM conversations GROUP BY 1)
SELECT conv_id, turn, (len(string_split(text, chr(10))) + CASE WHEN turn = f THEN 2 ELSE 1 END)::BIGINT AS n_lines, (CASE WHEN turn = f THEN 0 ELSE 1 END)::INTEGER AS first_line FROM conversations JOIN f USING (conv_id)
"""


def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined in order, a blank line between those that aren't empty."""
    pages = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return pages.groupBy("conv_id").agg(F.md5(joined).alias("text_md5"), F.count("*").alias("n_pages"))


ASSEMBLY_SQL = "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS text_md5, count(*) AS n_pages FROM conversations WHERE trim(text) <> '' GROUP BY 1"


def resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages still to scan: those whose digest and settings the cache of finished pages doesn't hold (here two thirds)."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("digest"), F.lit("v1").alias("settings"))
    done = pages.where("page_id % 3 = 0").select("digest", "settings").distinct()
    return pages.join(done, ["digest", "settings"], "left_anti").select("page_id", "digest")


RESUMABLE_SQL = "SELECT page_id, md5(html) AS digest FROM pages WHERE md5(html) NOT IN (SELECT md5(html) FROM pages WHERE page_id % 3 = 0)"


def left_out_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's text leaves out, as a note: a line per kind that occurs."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    counts = [("scripts", n("<script")), ("styles", n("<style")), ("comments", n("<!--")), ("pictures", n("<img"))]
    lines = F.array_compact(F.array(*[F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {name}"))) for name, c in counts]))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(lines, "; ").alias("note"))


LEFT_OUT_SQL = """
SELECT page_id, concat_ws('; ', CASE WHEN a > 0 THEN a || ' scripts' END, CASE WHEN b > 0 THEN b || ' styles' END, CASE WHEN c > 0 THEN c || ' comments' END, CASE WHEN d > 0 THEN d || ' pictures' END) AS note FROM
(SELECT page_id, len(regexp_extract_all(html, '<script')) AS a, len(regexp_extract_all(html, '<style')) AS b, len(regexp_extract_all(html, '<!--')) AS c, len(regexp_extract_all(html, '<img')) AS d FROM pages)
"""


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages admitted by the extension of their address; documents beyond the limit of a scan are rejected whole, with the reason, and long
    ones named."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), "page_id").alias("item"), F.when(admitted(F.regexp_replace("url", "[?#].*$", "")), "admitted").otherwise("extension").alias("state"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("document "), "doc_id").alias("item"), F.when(F.octet_length("text") > MOST_BYTES, "too long").when(F.octet_length("text") > 20000, "long").otherwise("admitted").alias("state"))
    return pages.unionByName(docs)


ADMISSION_SQL = f"""
SELECT 'page ' || page_id AS item, CASE WHEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[.]([A-Za-z0-9]+)$', 1)) IN ({', '.join(repr(x) for x in EXTENSIONS)}) THEN 'admitted' ELSE 'extension' END AS state FROM pages
UNION ALL SELECT 'document ' || doc_id, CASE WHEN strlen(text) > 2097152 THEN 'too long' WHEN strlen(text) > 20000 THEN 'long' ELSE 'admitted' END FROM documents
"""

QUERIES = [
    ("html_text", html_text, None), ("page_links", page_links, PAGE_LINKS_SQL), ("running_headers", running_headers, RUNNING_SQL), ("page_assembly", page_assembly, ASSEMBLY_SQL), ("resumable", resumable, RESUMABLE_SQL),
    ("left_out_note", left_out_note, LEFT_OUT_SQL), ("admission", admission, ADMISSION_SQL),
]
