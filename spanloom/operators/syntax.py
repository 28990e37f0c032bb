"""Markdown syntax: what of a text is marks and not words, and which spans may be replaced without breaking it.

``inline_spans`` and ``protected_ranges`` need a parser's state, so they are Arrow UDFs over whole texts; predicates over their results
are higher-order functions; line and link scans are built-in expressions. Offsets are code points, half-open.

Defined cases: a null text has no spans; unclosed marks are text; a mark inside a code span is text; nested emphasis gives a span
each, ordered by start, then the longer first; a text of any length is read once, a line at a time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from spanloom.functions.spans import find_spans
from spanloom.sources.tables import spread, table

# --- links, alerts, breaks: built-in expressions ---------------------------------------------------------------------

LINK = r"(?<!\\)(?<!!)\[((?:[^\[\]\\\n]|\\.)*)\]\(<?([^\s()<>]*(?:\([^\s()<>]*\)[^\s()<>]*)*)>?(?:\s+\"[^\"\n]*\")?\)"
IMAGE = r"(?<!\\)!\[((?:[^\[\]\\\n]|\\.)*)\]\(<?([^\s()<>]*)>?(?:\s+\"[^\"\n]*\")?\)"
AUTOLINK = r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)>"


def links(text: Column) -> Column:
    """(kind, label, target) of links, images and autolinks, in the order of kinds."""

    def of(kind: str, pattern: str, label: int, target: int) -> Column:
        labels = F.regexp_extract_all(text, F.lit(pattern), F.lit(label)) if label else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda _: F.lit(""))
        return F.zip_with(labels, F.regexp_extract_all(text, F.lit(pattern), F.lit(target)), lambda a, b: F.struct(F.lit(kind).alias("kind"), a.alias("label"), b.alias("target")))

    return F.coalesce(F.concat(of("link", LINK, 1, 2), of("image", IMAGE, 1, 2), of("auto", AUTOLINK, 0, 1)), F.array().cast("array<struct<kind:string,label:string,target:string>>"))


def alert_kind(line: Column) -> Column:
    """NOTE, TIP, IMPORTANT, WARNING or CAUTION of a quote's first line '> [!NOTE]'; else null."""
    return F.nullif(F.upper(F.regexp_extract(line, r"^ {0,3}> ?\[!(?i:(note|tip|important|warning|caution))\]\s*$", 1)), F.lit(""))


def cell_breaks(cell: Column) -> Column:
    """A table cell's lines: parted at <br>, <br/> and the like."""
    return F.split(cell, r"(?i)<br\s*/?>")


def css_color(value: Column) -> Column:
    """#rrggbb of a colour written as #rgb, #rrggbb or rgb(r, g, b); else null."""
    short = F.regexp_replace(F.regexp_extract(value, "(?i)^#([0-9a-f]{3})$", 1), "(.)", "$1$1")
    long = F.regexp_extract(value, "(?i)^#([0-9a-f]{6})$", 1)
    number = lambda k: F.regexp_extract(value, r"^rgb\(\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*\)$", k).try_cast("int")
    ok = (number(1) <= 255) & (number(2) <= 255) & (number(3) <= 255)
    rgb = F.concat(*[F.lpad(F.hex(number(k)), 2, "0") for k in (1, 2, 3)])
    return F.lower(F.concat(F.lit("#"), F.coalesce(F.nullif(short, F.lit("")), F.nullif(long, F.lit("")), F.when(ok, rgb))))


def base_direction(text: Column) -> Column:
    """rtl if the first strong letter is Hebrew or Arabic, else ltr."""
    first = F.regexp_extract(text, r"\p{L}", 0)
    return F.when(first.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"), "rtl").otherwise("ltr")


def math_fences(text: Column) -> Column:
    """Blocks between $$ lines written as ```math fences."""
    return F.regexp_replace(text, r"(?m)^\$\$[ \t]*\n((?:(?!\$\$)[^\n]*\n)*)\$\$[ \t]*$", "```math\n$1```")


def ordered_items(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, level (from 1), label of ordered list items: a list starts with its first number and counts on; a deeper list
    starts anew each time. Levels are three spaces wide. A line that is no item ends all lists, blank lines don't."""
    from pyspark.sql import Window

    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    item = F.regexp_extract("line", r"^( *)([0-9]{1,9})[.)] ", 2)
    level = (F.floor(F.length(F.regexp_extract("line", r"^( *)", 1)) / 3) + 1).cast("int")
    marked = lines.select(key, "line_no", F.nullif(item, F.lit("")).cast("long").alias("number"), level.alias("level"))
    w = Window.partitionBy(key).orderBy("line_no")
    runs = marked.withColumn("run", F.sum(F.col("number").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("number is not null")
    # a list of a level begins where the item before, in the same run, of this level or a shallower one is shallower
    before = Window.partitionBy(key, "run").orderBy("line_no")
    levels = [F.coalesce(F.last(F.when(F.col("level") <= k, F.col("level")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k in range(1, 7)]
    begun = runs.withColumn("last", F.element_at(F.array(*levels), F.least("level", F.lit(6)))).withColumn("begins", (F.col("last") < F.col("level")).cast("int"))
    same = Window.partitionBy(key, "run", "level").orderBy("line_no")
    lists = begun.withColumn("list", F.sum("begins").over(same))
    inner = Window.partitionBy(key, "run", "level", "list").orderBy("line_no")
    return lists.select(key, "line_no", "level", (F.first("number").over(inner) + F.row_number().over(inner) - 1).alias("label"))


# --- inline spans: a parser --------------------------------------------------------------------------------------------

INLINE = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n == "kind" else T.IntegerType()) for n in ("start", "end", "kind", "open", "close")]))
RANGES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end")]))
_CODE = re.compile(r"`+")
_AUTO = re.compile(AUTOLINK)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|<!--.*?-->")
_LINK = re.compile(r"!?\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?:[^()\s\\]|\\.|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)")
_ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PUNCTUATION = re.compile(r"[^\w\s]|_")
_PAIRED = {"~~": "strike", "==": "highlight"}
#: A bracketed label that no target follows, whatever the next line is; what a tag over several lines begins with.
_LABEL = re.compile(r"\[[^\[\]\\]*\](?!\()")
_TAG_BEGINS = re.compile(r"[A-Za-z/]|$")
_MATH = re.compile(r"\$(?!\s)[^$\n]+(?<!\s)\$(?![0-9])")
#: The longest lines whose reading is remembered.
CACHED = 2000
#: Every character that can begin something; the others are passed over.
_MARKS = re.compile(r"[\\`<!\[$~=*_]")


def _line_spans(t: str, at: int, end: int, loose: list[int] | None = None) -> list[tuple[int, int, str, int, int]]:
    """Spans (start, end, kind, marks before, marks after) of the text t[at:end], a paragraph, a line or a link's label. loose: gets
    the place of what more text after the end could still close."""
    out: list[tuple[int, int, str, int, int]] = []
    runs: list[list] = []  # place, character, left, opens, closes
    paired: dict[str, int] = {}
    while found := _MARKS.search(t, at, end):
        at, c = found.start(), found[0]
        if c == "\\" and at + 1 < end and t[at + 1] in _ESCAPABLE:
            out.append((at, at + 2, "escape", 1, 0))
            at += 2
        elif c == "`":
            n = len(_CODE.match(t, at, end)[0])
            close = next((m for m in _CODE.finditer(t, at + n, end) if len(m[0]) == n), None)
            if close:
                out.append((at, close.end(), "code", n, n))
            elif loose is not None:
                loose.append(at)
            at = close.end() if close else at + n
        elif c == "<" and (m := _AUTO.match(t, at, end) or _TAG.match(t, at, end)):
            out.append((at, m.end(), "autolink" if m.re is _AUTO else "html", 1, 1))
            at = m.end()
        elif c in "![" and (m := _LINK.match(t, at, end)):
            lead = 2 if c == "!" else 1
            out.append((at, m.end(), "image" if c == "!" else "link", lead, m.end() - m.end(1)))
            out += _line_spans(t, m.start(1), m.end(1))
            at = m.end()
        elif c == "$" and (m := _MATH.match(t, at, end)):
            out.append((at, m.end(), "math", 1, 1))
            at = m.end()
        elif t[at : at + 2] in _PAIRED:
            mark = t[at : at + 2]
            if mark in paired:
                start = paired.pop(mark)
                if at > start + 2:
                    out.append((start, at + 2, _PAIRED[mark], 2, 2))
            else:
                paired[mark] = at
            at += 2
        elif c in "*_":
            n = at
            while n < end and t[n] == c:
                n += 1
            before, after = t[at - 1] if at else "\n", t[n] if n < len(t) else "\n"
            left = not after.isspace() and (not _PUNCTUATION.match(after) or before.isspace() or bool(_PUNCTUATION.match(before)))
            right = not before.isspace() and (not _PUNCTUATION.match(before) or after.isspace() or bool(_PUNCTUATION.match(after)))
            opens = left and (c == "*" or not right or bool(_PUNCTUATION.match(before)))
            closes = right and (c == "*" or not left or bool(_PUNCTUATION.match(after)))
            size, whole = n - at, n - at
            if closes:
                k = len(runs) - 1
                while k >= 0 and size:
                    r = runs[k]
                    odd = (r[4] or opens) and (r[5] + whole) % 3 == 0 and not (r[5] % 3 == 0 and whole % 3 == 0)
                    if r[1] == c and r[3] and r[2] and not odd:
                        use = 2 if r[2] >= 2 and size >= 2 else 1
                        r[2] -= use
                        start = r[0] + r[2]
                        stop = at + (whole - size) + use
                        out.append((start, stop, "strong" if use == 2 else "emphasis", use, use))
                        size -= use
                        del runs[k + 1 :]
                        if not r[2]:
                            runs.pop()
                            k -= 1
                    else:
                        k -= 1
            if opens and size:
                runs.append([n - size, c, size, True, closes, whole])
            at = n
        else:
            if loose is not None and (c == "[" and not _LABEL.match(t, at, end) or c == "<" and _TAG_BEGINS.match(t, at + 1, end)):
                loose.append(at)
            at += 1
    if loose is not None:
        loose += [*paired.values(), *(r[0] for r in runs)]
    return out


@lru_cache(maxsize=256)
def _own_spans(line: str) -> list[tuple[int, int, str, int, int]] | None:
    """The spans of a line by itself; None if they depend on the lines beside it."""
    loose: list[int] = []
    spans = _line_spans(line, 0, len(line), loose)
    return None if loose else spans


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def read_inline(text: str | None) -> list[tuple[int, int, str, int, int]]:
    """All inline spans of a text; paragraphs end at blank lines, fenced code is left out."""
    t, out, at, fence, start = text or "", [], 0, "", None

    def flush(end: int) -> None:
        nonlocal start
        if start is not None:
            at, lines = start, t[start:end].split("\n")
            own = [(_own_spans if len(line) <= CACHED else _own_spans.__wrapped__)(line) for line in lines]
            if None in own:
                out.extend(_line_spans(t, start, end))
            else:
                for line, spans in zip(lines, own, strict=True):
                    out.extend([(s + at, e + at, kind, n, m) for s, e, kind, n, m in spans])
                    at += len(line) + 1
        start = None

    for line in t.split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
        elif m:
            flush(at)
            fence = m[1]
        elif not line.strip():
            flush(at)
        elif start is None:
            start = at
        at += len(line) + 1
    flush(len(t))
    return sorted(out, key=lambda x: (x[0], -x[1]))


@pandas_udf(INLINE)
def inline_spans(column: pd.Series) -> pd.Series:
    """start, end, kind (code, escape, link, image, autolink, html, emphasis, strong, strike, highlight, math), marks at either side."""
    return column.map(lambda t: [dict(zip(("start", "end", "kind", "open", "close"), x, strict=True)) for x in read_inline(t)])


def emphasis_edge(spans: Column, at: Column, end: Column) -> Column:
    """How many characters of emphasis marks lie from at on, of emphasis that ends after end (nested ones add up)."""
    around = F.filter(spans, lambda s: s["kind"].isin("emphasis", "strong") & (s["end"] > end) & (s["start"] >= at))

    def step(reach: Column, s: Column) -> Column:
        return F.when(s["start"] == at + reach, (reach + s["open"]).cast("int")).otherwise(reach)

    return F.aggregate(F.sort_array(F.transform(around, lambda s: F.struct(s["start"].alias("start"), s["open"].alias("open")))), F.lit(0), step)


# --- protected syntax ----------------------------------------------------------------------------------------------------

_LIST = re.compile(r"((?: {0,3}> ?)*\s*)([-+*]|[0-9]{1,9}[.)])([ \t]+|$)")
_HEADING = re.compile(r"((?: {0,3}> ?)* {0,3})(#{1,6})(?=[ \t]|$)(?:.*?([ \t]+#+[ \t]*)$)?")
_TAG_PARTS = re.compile(r"<(/?[A-Za-z][A-Za-z0-9-]*)|([\w:.-]+)(?=\s*=)|(\s*/?>)")


def read_protected(text: str | None) -> list[tuple[int, int]]:
    """Ranges that no replacement may touch: list markers, heading marks, names of tags and attributes, the ends of links."""
    t, out, at, prose = text or "", [], 0, False
    for line in t.split("\n"):
        m, h = _LIST.match(line), _HEADING.match(line)
        # an ordered item other than 1 can't interrupt a paragraph, nor a plus before a digit: then it is the value's own
        if m and not (prose and (m[2][0].isdigit() and m[2][:-1] != "1" or m[2] == "+" and line[m.end() :][:1].isdigit())):
            out.append((at + m.start(2), at + m.end()))
            prose = False
        elif h:
            out.append((at + h.start(2), at + h.end(2)))
            if h[3]:
                out.append((at + h.start(3), at + h.end(3)))
            prose = False
        else:
            prose = bool(line.strip())
        at += len(line) + 1
    for m in _TAG.finditer(t):
        if not m[0].startswith("<!--"):
            out += [(m.start() + p.start(), m.start() + p.end()) for p in _TAG_PARTS.finditer(m[0])]
    for m in _LINK.finditer(t):
        out += [(m.start(), m.start() + (2 if m[0][0] == "!" else 1)), (m.end(1), m.end(1) + 2), (m.end() - 1, m.end())]
    merged: list[list[int]] = []
    for s, e in sorted(x for x in out if x[0] < x[1]):
        if merged and merged[-1][1] >= s:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


@pandas_udf(RANGES)
def protected_ranges(column: pd.Series) -> pd.Series:
    return column.map(lambda t: [{"start": s, "end": e} for s, e in read_protected(t)])


def crosses_syntax(text: Column, span: Column, protected: Column) -> Column:
    """Whether a span meets protected syntax, line breaks written as <br> wholly inside it apart."""
    breaks = find_spans(F.substring(text, span["start"] + 1, span["end"] - span["start"]), r"(?i)<br\s*/?>")
    inside = lambda p: F.exists(breaks, lambda b: (span["start"] + b["start"] <= p["start"]) & (p["end"] <= span["start"] + b["end"]))
    return F.exists(protected, lambda p: (p["start"] < span["end"]) & (span["start"] < p["end"]) & ~inside(p))


@lru_cache(maxsize=256)
def _line_kind(line: str) -> tuple[str, int]:
    return ("list" if _LIST.match(line) else "heading" if _HEADING.match(line) else "quote" if line.lstrip().startswith(">") else "fence" if _FENCE.match(line) else "text" if line.strip() else "blank", line.count("|"))


def _line_kinds(t: str) -> list[tuple[str, int]]:
    """What each line of a block is."""
    return [(_line_kind if len(line) <= CACHED else _line_kind.__wrapped__)(line) for line in t.split("\n")]


@lru_cache(maxsize=4)
def _shape(t: str) -> list[tuple[str, int]]:
    """The kinds of a block's inline spans with how deep they lie."""
    depth, ends = [], []
    for s, e, kind, _, _ in read_inline(t):
        while ends and ends[-1] <= s:
            ends.pop()
        if kind != "escape":
            depth.append((kind, len(ends)))
        ends.append(e)
    return depth


def keeps_structure(text: str, start: int, end: int) -> bool:
    """Whether a plain token in place of a span leaves the structure of its block as it was; line breaks inside the span are text."""
    inside_line = text[:start].rpartition("\n")[2].strip(" >")
    if inside_line and not any(c in text[start:end] for c in "\\*_~=`$#\n<[]|"):
        return True
    first = text.rfind("\n\n", 0, start)
    first = 0 if first < 0 else first + 2
    last = text.find("\n\n", end)
    block = text[first : len(text) if last < 0 else last]
    a, b = start - first, end - first
    joined = block[:a] + block[a:b].replace("\n", " ") + block[b:]
    changed = block[:a] + "PERSON1" + block[b:]
    return _line_kinds(joined) == _line_kinds(changed) and _shape(joined) == _shape(changed)


@pandas_udf(T.BooleanType())
def plain_text_span(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([t is not None and keeps_structure(t, int(s), int(e)) for t, s, e in zip(text, start, end, strict=True)])


# --- queries -----------------------------------------------------------------------------------------------------------------

MARKED = """concat('# Order ', cast(o_orderkey as string), case when o_orderkey % 3 = 0 then ' #' else '' end, '
> [!', case when o_orderkey % 2 = 0 then 'NOTE' else 'Tip' end, ']
See [order *', cast(o_orderkey % 7 as string), '*](https://ex.org/o_', cast(o_orderkey as string), ' "t") and ![p](i', cast(o_orderkey % 5 as string), '.png) or <mailto:a', cast(o_orderkey % 9 as string), '@ex.org>.
', cast(o_orderkey % 4 + 1 as string), '. one
   7. in **bold _', cast(o_orderkey % 11 as string), '_ x**
   9. also `a*b*`
', cast(o_orderkey % 4 + 5 as string), '. two \\\\*no\\\\*
| a<br>b', cast(o_orderkey % 6 as string), '<BR/>c | ', case when o_orderkey % 2 = 0 then '#0aF' else 'rgb(1, 20, 255)' end, ' |')"""
MARKED_SQL = f"(SELECT o_orderkey AS doc_id, {MARKED.replace('as string', 'as varchar').replace(chr(92) * 2, chr(92))} AS text FROM orders)"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(MARKED).alias("text"))


def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, images and autolinks of texts made from orders."""
    return _marked(spark, sf_dir).select("doc_id", F.inline(links(F.col("text"))))


LINKS_SQL = """
SELECT o_orderkey AS doc_id, 'link' AS kind, 'order *' || (o_orderkey % 7) || '*' AS label, 'https://ex.org/o_' || o_orderkey AS target FROM orders
UNION ALL SELECT o_orderkey, 'image', 'p', 'i' || (o_orderkey % 5) || '.png' FROM orders UNION ALL SELECT o_orderkey, 'auto', '', 'mailto:a' || (o_orderkey % 9) || '@ex.org' FROM orders
"""


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts, list labels, cell lines and colours of the same texts."""
    docs = _marked(spark, sf_dir)
    items = ordered_items(docs).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("line_no").cast("string"), 2, "0"), "level", "label"))), " ").alias("items"))
    lines = F.split("text", "\n")
    cells = F.split(F.element_at(lines, -1), r"\|")
    seen = docs.select("doc_id", alert_kind(F.get(lines, F.lit(1))).alias("alert"), F.array_join(cell_breaks(F.trim(F.get(cells, F.lit(1)))), "/").alias("cell"), css_color(F.trim(F.get(cells, F.lit(2)))).alias("color"), base_direction(F.col("text")).alias("direction"))
    return seen.join(items, "doc_id")


LINES_SQL = """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'NOTE' ELSE 'TIP' END AS alert, 'a/b' || (o_orderkey % 6) || '/c' AS cell, CASE WHEN o_orderkey % 2 = 0 THEN '#00aaff' ELSE '#0114ff' END AS color, 'ltr' AS direction,
  '03:1:' || (o_orderkey % 4 + 1) || ' 04:2:7 05:2:8 06:1:' || (o_orderkey % 4 + 2) AS items FROM orders
"""


def markdown_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline spans of the same texts: kind, text."""
    found = _marked(spark, sf_dir).withColumn("s", inline_spans("text"))
    return found.select("doc_id", "text", F.inline("s")).select("doc_id", "kind", F.expr("substring(text, start + 1, end - start)").alias("value"))


INLINE_SQL = """
SELECT o_orderkey AS doc_id, unnest(['link', 'emphasis', 'image', 'autolink', 'strong', 'emphasis', 'code', 'escape', 'escape', 'html', 'html']) AS kind,
  unnest(['[order *' || (o_orderkey % 7) || '*](https://ex.org/o_' || o_orderkey || ' "t")', '*' || (o_orderkey % 7) || '*', '![p](i' || (o_orderkey % 5) || '.png)', '<mailto:a' || (o_orderkey % 9) || '@ex.org>',
    '**bold _' || (o_orderkey % 11) || '_ x**', '_' || (o_orderkey % 11) || '_', '`a*b*`', chr(92) || '*', chr(92) || '*', '<br>', '<BR/>']) AS value FROM orders
"""


def span_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the same texts (numbers, words with marks, cells) against protected syntax and structure."""
    docs = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.expr(MARKED).alias("text"))
    found = docs.withColumn("protected", protected_ranges("text")).withColumn("s", F.explode(find_spans(F.col("text"), r"# Order [0-9]+|\*[0-9]\*|_[0-9]+_ x|a<br>b[0-9]|(?<=bold )_[0-9]+_")))
    judged = found.withColumn("crosses", crosses_syntax(F.col("text"), F.col("s"), F.col("protected"))).withColumn("plain", plain_text_span("text", F.col("s.start"), F.col("s.end")))
    return judged.select("doc_id", F.col("s.text").alias("value"), "crosses", "plain")


#: Of these, '_4_ x' is found before '_4_' alone can be; it would take emphasis away.
SPAN_SYNTAX_SQL = """
SELECT o_orderkey AS doc_id, unnest(['# Order ' || o_orderkey, '*' || (o_orderkey % 7) || '*', '_' || (o_orderkey % 11) || '_ x', 'a<br>b' || (o_orderkey % 6)]) AS value, unnest([true, false, false, false]) AS crosses, unnest([false, false, false, false]) AS plain FROM orders
"""

QUERIES = [("markdown_links", markdown_links, LINKS_SQL), ("markdown_lines", markdown_lines, LINES_SQL), ("markdown_inline", markdown_inline, INLINE_SQL), ("span_syntax", span_syntax, SPAN_SYNTAX_SQL)]
