"""Files to Markdown with what Python itself can read: text, Markdown, CSV, HTML, Word, OpenDocument, Excel, PowerPoint, EPUB, RTF.

``converted`` reads each file once, in batches on the executors, and gives its Markdown, counters of what was left out, its comments (data,
never part of the Markdown) and an error if there is one: ``locked`` (protected by a password), ``unsupported`` (no parser for PDF and the
binary Office formats here), ``damaged``, ``too large``. A failed file is a row with an error, never a failed job.

Defined cases: null or empty content gives empty Markdown; a file is judged by its content first, then its extension; equal files are
converted each; columns beside path and content are kept.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources.imports import as_table, to_markdown
from spanloom.sources.tables import table

#: The largest file that is read, and the largest that a packed file may unfold to.
MOST_CONTENT, MOST_UNPACKED = 256 * 1024 * 1024, 512 * 1024 * 1024
COUNTERS = ("pictures", "comments", "hidden", "notes")


class Refused(Exception):
    """Why a file has no Markdown."""


def guess_text(content: bytes) -> str:
    """Text in the encoding that fits: by its mark, UTF-8, else Windows-1251 if that gives mostly Cyrillic letters, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        high = sum(b >= 0xC0 for b in content)
        letters = sum(b > 0x7F for b in content)
        words = re.findall(rb"[\xc0-\xff]{3,}", content)
        return content.decode("cp1251" if letters and high > 0.8 * letters and words else "cp1252", "replace")


def from_csv(content: bytes) -> str:
    """A table; the separator is the one that parts the first lines most evenly."""
    text = guess_text(content)
    head = text.split("\n")[:20]

    def even(sep: str) -> tuple[int, int]:
        sizes = [len(r) for r in csv.reader(head, delimiter=sep) if r]
        return (sizes.count(max(sizes, key=sizes.count)) if sizes and max(sizes) > 1 else 0, max(sizes, default=0))

    sep = max(",;\t|", key=even)
    return as_table(list(csv.reader(io.StringIO(text), delimiter=sep)))


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


class _Zip:
    def __init__(self, content: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            infos = self.zip.infolist()
        except zipfile.BadZipFile as e:
            raise Refused("damaged") from e
        if any(i.flag_bits & 1 for i in infos):
            raise Refused("locked")
        if sum(i.file_size for i in infos) > MOST_UNPACKED:
            raise Refused("too large")
        self.names = [i.filename for i in infos]

    def xml(self, name: str):
        try:
            return ElementTree.fromstring(self.zip.read(name)) if name in self.names else None
        except ElementTree.ParseError as e:
            raise Refused("damaged") from e


def _runs(p) -> str:
    """A Word paragraph's text: deleted text left out, breaks and tabs as such."""
    out = []
    for e in p.iter():
        n = _name(e)
        if n == "t":
            out.append(e.text or "")
        elif n in ("br", "cr"):
            out.append("\n")
        elif n == "tab":
            out.append("\t")
    return "".join(out).strip()


def from_docx(content: bytes) -> tuple[str, dict[str, int], list[tuple[str, str]]]:
    z = _Zip(content)
    root = z.xml("word/document.xml")
    if root is None:
        raise Refused("damaged")
    body = next((e for e in root if _name(e) == "body"), root)
    hidden = sum(_name(e) == "vanish" for e in root.iter())
    out = []

    def block(e) -> None:
        n = _name(e)
        if n == "p":
            text = _runs(e)
            style = next((_attribute(s, "val") or "" for s in e.iter() if _name(s) == "pStyle"), "")
            level = re.search(r"(?i)heading\s*([1-6])", style)
            listed = any(_name(s) == "numPr" for s in e.iter())
            if text:
                out.append(("#" * int(level[1]) + " " if level else "- " if listed else "") + text)
        elif n == "tbl":
            out.append(as_table([["\n".join(filter(None, (_runs(p) for p in c.iter() if _name(p) == "p"))) for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]))
        elif n in ("sdt", "sdtContent"):
            for child in e:
                block(child)

    for e in body:
        block(e)
    comments = z.xml("word/comments.xml")
    said = [] if comments is None else [(_attribute(c, "author") or "", _runs(c)) for c in comments if _name(c) == "comment"]
    notes = sum(sum(_name(e) == tag and _attribute(e, "type") is None for e in x) for name, tag in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")) if (x := z.xml(name)) is not None)
    return "\n\n".join(filter(None, out)), {"pictures": sum(_name(e) == "drawing" for e in root.iter()), "comments": len(said), "hidden": hidden, "notes": notes}, said


def from_odf(content: bytes) -> tuple[str, dict[str, int], list[tuple[str, str]]]:
    z = _Zip(content)
    manifest = z.xml("META-INF/manifest.xml")
    if manifest is not None and any(_name(e) == "encryption-data" for e in manifest.iter()):
        raise Refused("locked")
    root = z.xml("content.xml")
    if root is None:
        raise Refused("damaged")
    out, said = [], []

    def text(e) -> str:
        parts = [e.text or ""]
        for child in e:
            n = _name(child)
            if n == "annotation":
                said.append((next(("".join(c.itertext()) for c in child if _name(c) == "creator"), ""), " ".join("".join(c.itertext()) for c in child if _name(c) == "p")))
            elif n == "line-break":
                parts.append("\n")
            elif n in ("s", "tab"):
                parts.append(" ")
            else:
                parts.append(text(child))
            parts.append(child.tail or "")
        return "".join(parts)

    def block(e) -> None:
        n = _name(e)
        if n == "h":
            out.append("#" * min(int(_attribute(e, "outline-level") or 1), 6) + " " + text(e).strip())
        elif n == "p":
            out.append(text(e).strip())
        elif n == "list-item":
            items = [text(p).strip() for p in e if _name(p) == "p"]
            out.extend("- " + x for x in items if x)
        elif n == "table":
            out.append(as_table([["\n".join(text(p).strip() for p in c if _name(p) == "p") for c in r if _name(c) == "table-cell"] for r in e.iter() if _name(r) == "table-row"]))
        else:
            for child in e:
                block(child)

    block(next((e for e in root if _name(e) == "body"), root))
    return "\n\n".join(filter(None, out)), {"pictures": sum(_name(e) == "image" for e in root.iter()), "comments": len(said), "hidden": 0, "notes": sum(_name(e) == "note" for e in root.iter())}, said


def from_xlsx(content: bytes) -> tuple[str, dict[str, int], list[tuple[str, str]]]:
    z = _Zip(content)
    book = z.xml("xl/workbook.xml")
    if book is None:
        raise Refused("damaged")
    shared = z.xml("xl/sharedStrings.xml")
    strings = [] if shared is None else ["".join(t.text or "" for t in s.iter() if _name(t) == "t") for s in shared]
    sheets = [(_attribute(e, "name") or "", _attribute(e, "state") or "visible") for e in book.iter() if _name(e) == "sheet"]
    files = sorted((n for n in z.names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.sub("[^0-9]", "", n)))
    out = []
    for (name, state), file in zip(sheets, files, strict=False):
        if state != "visible":
            continue
        rows = []
        for r in (e for e in z.xml(file).iter() if _name(e) == "row"):
            row: list[str] = []
            for c in (e for e in r if _name(e) == "c"):
                column = 0
                for letter in re.sub("[^A-Z]", "", _attribute(c, "r") or ""):
                    column = column * 26 + ord(letter) - 64
                row += [""] * (max(column, len(row) + 1) - len(row))
                value = "".join(t.text or "" for t in c.iter() if _name(t) in ("v", "t"))
                row[-1] = strings[int(value)] if _attribute(c, "t") == "s" and value.isdigit() and int(value) < len(strings) else value
            rows.append(row)
        out += [f"## {name}", as_table(rows)]
    said = [("", "".join(t.text or "" for t in e.iter() if _name(t) == "t")) for n in z.names if re.fullmatch(r"xl/comments[0-9]*\.xml", n) for e in z.xml(n).iter() if _name(e) == "comment"]
    return "\n\n".join(filter(None, out)), {"pictures": sum(n.startswith("xl/media/") for n in z.names), "comments": len(said), "hidden": sum(s != "visible" for _, s in sheets), "notes": 0}, said


def from_pptx(content: bytes) -> tuple[str, dict[str, int], list[tuple[str, str]]]:
    z = _Zip(content)
    slides = sorted((n for n in z.names if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)), key=lambda n: int(re.sub("[^0-9]", "", n)))
    out, hidden = [], 0
    for k, name in enumerate(slides):
        root = z.xml(name)
        if _attribute(root, "show") == "0":
            hidden += 1
            continue
        out.append(f"## {k + 1}")
        out += [t for p in root.iter() if _name(p) == "p" and (t := "".join(r.text or "" for r in p.iter() if _name(r) == "t").strip())]
    said = [("", "".join(t.text or "" for t in e.iter() if _name(t) == "text")) for n in z.names if n.startswith("ppt/comments/") for e in z.xml(n).iter() if _name(e) == "cm"]
    return "\n\n".join(out), {"pictures": sum(n.startswith("ppt/media/") for n in z.names), "comments": len(said), "hidden": hidden, "notes": sum(n.startswith("ppt/notesSlides/notes") for n in z.names)}, said


def from_epub(content: bytes) -> tuple[str, dict[str, int], list[tuple[str, str]]]:
    z = _Zip(content)
    if "META-INF/encryption.xml" in z.names:
        raise Refused("locked")
    pages = [n for n in z.names if re.search(r"\.x?html?$", n)]
    return "\n\n".join(filter(None, (to_markdown(guess_text(z.zip.read(n))) for n in pages))), {"pictures": sum(bool(re.search(r"\.(?:png|jpe?g|gif|svg)$", n, re.I)) for n in z.names), "comments": 0, "hidden": 0, "notes": 0}, []


def from_rtf(content: bytes) -> str:
    """The text of an RTF file: groups that hold no text left out, characters by code page or number."""
    source = content.decode("latin-1")
    page = re.search(r"\\ansicpg([0-9]+)", source)
    code = f"cp{page[1]}" if page else "cp1252"
    out, skip, depth = [], 0, 0
    for m in re.finditer(r"\\\*|\\u(-?[0-9]+) ?(?:\\'[0-9a-f]{2}|\?)?|\\'([0-9a-f]{2})|\\([a-z]+)(-?[0-9]+)? ?|\\([^a-z])|([{}])|([^\\{}\r\n]+)", source):
        number, byte, word, _, sign, brace, text = m.groups()
        if brace == "{":
            depth += 1
        elif brace:
            skip = 0 if skip == depth else skip
            depth -= 1
        elif skip:
            continue
        elif m[0] == r"\*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer"):
            skip = depth
        elif number:
            out.append(chr(int(number) % 65536))
        elif byte:
            out.append(bytes.fromhex(byte).decode(code, "replace"))
        elif word in ("par", "line", "row", "page"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif sign and sign in "{}\\":
            out.append(sign)
        elif sign == "~":
            out.append(" ")
        elif text:
            out.append(text)
    return re.sub(r"\n{2,}", "\n\n", "".join(out).replace("\n", "\n\n")).strip()


def kind_of(path: str, content: bytes) -> str:
    """The format by content, or by extension where content doesn't tell."""
    extension = path.rpartition(".")[2].lower()
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith(b"{\\rtf"):
        return "rtf"
    if content.startswith(b"\xd0\xcf\x11\xe0"):
        return "locked" if extension in ("docx", "xlsx", "pptx", "docm", "xlsm") else "ole"
    if content.startswith(b"PK\x03\x04"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
        except zipfile.BadZipFile:
            return "damaged"
        if "mimetype" in names and "content.xml" in names:
            return "odf"
        for name, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("META-INF/container.xml", "epub")):
            if name in names:
                return kind
        return "zip"
    return {"htm": "html", "xhtml": "html", "markdown": "md", "tsv": "csv"}.get(extension, extension)


def convert(path: str, content: bytes | None) -> dict:
    """markdown, error, counters and comments (author, text) of one file."""
    content = content or b""
    row = {"markdown": None, "error": None, "comments_said": [], **dict.fromkeys(COUNTERS, 0)}
    try:
        if len(content) > MOST_CONTENT:
            raise Refused("too large")
        kind = kind_of(path or "", content)
        if kind in ("locked", "damaged"):
            raise Refused(kind)
        if kind == "pdf":
            raise Refused("locked" if b"/Encrypt" in content else "unsupported")
        rich = {"docx": from_docx, "odf": from_odf, "xlsx": from_xlsx, "pptx": from_pptx, "epub": from_epub}
        plain = {"csv": from_csv, "rtf": from_rtf, "html": lambda c: to_markdown(guess_text(c)), "md": guess_text, "txt": guess_text}
        if kind in rich:
            row["markdown"], counts, row["comments_said"] = rich[kind](content)
            row |= counts
        elif kind in plain:
            row["markdown"] = plain[kind](content).replace("\r\n", "\n")
            if kind == "html":
                said = re.findall(r"<!--(.*?)-->", guess_text(content), re.S)
                row |= {"comments": len(said), "pictures": len(re.findall(rb"<img\b", content, re.I))}
                row["comments_said"] = [("", x.strip()) for x in said]
        else:
            raise Refused("unsupported")
    except Refused as e:
        row["error"] = str(e)
    except (KeyError, ValueError, IndexError, EOFError, zipfile.BadZipFile, UnicodeError) as e:
        row["error"] = f"damaged: {type(e).__name__}"
    return row


def converted(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """files without their content, with markdown, error, pictures, comments, hidden, notes and comments_said (author, text)."""
    rest = [c for c in files.columns if c != content]
    said = T.ArrayType(T.StructType([T.StructField("author", T.StringType()), T.StructField("text", T.StringType())]))
    added = [T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in COUNTERS], T.StructField("comments_said", said)]
    kind = pa.list_(pa.struct([("author", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [convert(p, c) for p, c in zip(batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist(), strict=True)]
            columns = [pa.array([r[f.name] for r in rows], pa.string() if isinstance(f.dataType, T.StringType) else pa.int32()) for f in added[:-1]]
            talk = pa.array([[{"author": a, "text": t} for a, t in r["comments_said"]] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *columns, talk], [*rest, *[f.name for f in added]])

    source = files.select(*rest, files[path].alias("_path"), files[content].cast("binary").alias("_content"))
    return source.mapInArrow(run, T.StructType([*[files.schema[c] for c in rest], *added]))


def left_out(frame: DataFrame) -> DataFrame:
    """frame with note: a line of what its Markdown leaves out; nothing for zeros."""
    lines = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c), F.lit(c))) for c in COUNTERS]))
    return frame.withColumn("note", F.array_join(lines, "; "))


def comment_rows(frame: DataFrame, key: str = "path") -> DataFrame:
    """Comments as a table of their own: key, author, text."""
    return frame.select(key, F.inline("comments_said"))


def routed_pages(pages: DataFrame, least: int = 16) -> DataFrame:
    """Scanned documents' pages (doc_id, page, native, recognized): a page's own text if it has least letters or digits, else what was
    recognised, else nothing; doc_id, page, text, source (text, recognition, none)."""
    enough = F.length(F.regexp_replace(F.coalesce("native", F.lit("")), r"[^\p{L}\p{N}]", "")) >= least
    seen = F.length(F.trim(F.coalesce("recognized", F.lit("")))) > 0
    return pages.select("doc_id", "page", F.when(enough, F.col("native")).when(seen, F.col("recognized")).otherwise("").alias("text"), F.when(enough, "text").when(seen, "recognition").otherwise("none").alias("source"))


def page_warnings(routed: DataFrame) -> DataFrame:
    """Documents some of whose pages have no text at all: doc_id, n_pages, missing (numbers of pages, in order)."""
    rows = routed.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.when(F.col("source") == "none", F.col("page")))).alias("missing"))
    return rows.where(F.size("missing") > 0)


def write_texts(frame: DataFrame, out: str, text: str = "text", ending: str | None = None) -> None:
    """Texts as Parquet beside their keys, with line ends as they were: ending names a column with '\\n' or '\\r\\n'."""
    done = F.col(text) if ending is None else F.when(F.col(ending) == "\r\n", F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n", "\r\n")).otherwise(F.col(text))
    frame.withColumn(text, done).write.mode("errorifexists").parquet(out)


def line_ending(text):
    """'\\r\\n' where the first line ends so, else '\\n'."""
    return F.when(text.rlike("^[^\n]*\r\n"), "\r\n").otherwise("\n")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a path but READMEs and guides: path, name, text, in the order of names."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return files.where(~F.upper(F.regexp_extract("name", r"^([^.]+)", 1)).isin("README", "GUIDE")).orderBy("path")


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and their regions as CSV files in several encodings and separators, converted."""
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t")), (F.col("n_regionkey") % 3 + 1).cast("int"))
    n = table(spark, sf_dir, "nation").withColumn("sep", sep)
    line = F.concat(F.lit('"'), "n_name", F.lit(' ""x"" '), "sep", F.lit('"'), "sep", F.lit("a|é"), "n_nationkey")
    text = F.concat(F.lit("name"), "sep", F.lit("key\r\n"), line, F.lit("\r\n"))
    files = n.select(F.concat("n_nationkey", F.lit(".csv")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1")).alias("content"))
    return converted(files).select("path", "markdown", "error")


CSV_TABLES_SQL = r"""
SELECT n_nationkey || '.csv' AS path, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || rtrim(n_name || ' "x" ' || trim([',', ';', chr(9)][n_regionkey % 3 + 1], chr(9))) || ' | a\|é' || n_nationkey || ' |' AS markdown, NULL::VARCHAR AS error FROM nation
"""


def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scanned documents: every third turn has no text of its own, every ninth nothing recognised either."""
    c = table(spark, sf_dir, "conversations")
    own = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("a page of enough letters "), "text"))
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), own.alias("native"), F.when((F.col("turn") % 3 == 0) & (F.col("conv_id") % 3 != 0), "seen").alias("recognized"))
    return page_warnings(routed_pages(pages)).select("doc_id", "n_pages", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


ROUTING_SQL = "SELECT conv_id AS doc_id, count(*) AS n_pages, string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE turn % 3 = 0) AS missing FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1 HAVING count(*) FILTER (WHERE turn % 3 = 0) > 0"

QUERIES = [("csv_tables", csv_tables, CSV_TABLES_SQL), ("page_routing", page_routing, ROUTING_SQL)]
