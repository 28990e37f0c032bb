"""File conversion, windows and streams: what SQL can't check."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.operators import mapping, syntax, windows
from spanloom.sources import convert
from spanloom.streaming import events


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = packed(
    {
        "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>two</w:t></w:r><w:drawing/></w:p>'
        f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
        "word/comments.xml": f'<w:comments {W}><w:comment w:author="Ann"><w:p><w:r><w:t>check</w:t></w:r></w:p></w:comment></w:comments>',
    }
)
XLSX = packed(
    {
        "xl/workbook.xml": '<workbook><sheets><sheet name="S1"/><sheet name="S2" state="hidden"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="B2"><v>7</v></c></row></worksheet>',
        "xl/worksheets/sheet2.xml": "<worksheet/>",
    }
)
ODT = packed({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<d xmlns:t="t" xmlns:o="o"><o:body><o:text><t:h t:outline-level="3">H</t:h><t:p>x<t:s/>y<o:annotation><t:p>note</t:p></o:annotation></t:p><t:list><t:list-item><t:p>i</t:p></t:list-item></t:list></o:text></o:body></d>'})
PPTX = packed({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": '<s xmlns:a="a"><a:p><a:r><a:t>Hi </a:t></a:r><a:r><a:t>all</a:t></a:r></a:p></s>', "ppt/slides/slide2.xml": '<s show="0"/>'})
EPUB = packed({"META-INF/container.xml": "<c/>", "a.xhtml": "<h1>Book</h1><p>text</p>", "b.png": "x"})


def test_formats():
    row = convert.convert("x.docx", DOCX)
    assert row["markdown"] == "## Title\n\nOne two\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |" and (row["pictures"], row["comments"], row["hidden"]) == (1, 1, 1) and row["comments_said"] == [("Ann", "check")]
    assert convert.convert("x.xlsx", XLSX)["markdown"] == "## S1\n\n| Name |  | 5 |\n| --- | --- | --- |\n|  | 7 |  |" and convert.convert("x.xlsx", XLSX)["hidden"] == 1
    assert convert.convert("x.odt", ODT)["markdown"] == "### H\n\nx y\n\n- i" and convert.convert("x.odt", ODT)["comments_said"] == [("", "note")]
    assert convert.convert("x.pptx", PPTX)["markdown"] == "## 1\n\nHi all" and convert.convert("x.pptx", PPTX)["hidden"] == 1
    assert convert.convert("x.epub", EPUB)["markdown"] == "# Book\n\ntext" and convert.convert("x.epub", EPUB)["pictures"] == 1
    assert convert.convert("x.rtf", rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}\'cf\'f0 \u233?t\'e9\par{\*\x hidden}end\{\}}")["markdown"].split("\n\n")[1] == "end{}"
    assert convert.convert("x.html", b"<p>a<!-- c --><img></p>")["comments_said"] == [("", "c")] and convert.convert("x.md", "a\r\nb".encode("utf-16"))["markdown"] == "a\nb"
    assert convert.convert("x.txt", "Привет, мир".encode("cp1251"))["markdown"] == "Привет, мир" and convert.convert("x.txt", "déjà vu".encode("cp1252"))["markdown"] == "déjà vu"


@pytest.mark.parametrize(
    ("path", "content", "error"),
    [("a.pdf", b"%PDF-1.7 /Encrypt", "locked"), ("a.pdf", b"%PDF-1.7", "unsupported"), ("a.docx", b"\xd0\xcf\x11\xe0....", "locked"), ("a.doc", b"\xd0\xcf\x11\xe0....", "unsupported"), ("a.docx", b"PK\x03\x04junk", "damaged"), ("a.exe", b"MZ", "unsupported"), ("a.zip", packed({"x": "y"}), "unsupported"), ("a.odt", packed({"mimetype": "m", "content.xml": "<a", "META-INF/manifest.xml": "<m/>"}), "damaged")],
)
def test_refusals(path, content, error):
    row = convert.convert(path, content)
    assert row["markdown"] is None and row["error"].startswith(error)


def test_converted(spark):
    rows = [("a.docx", bytearray(DOCX), "x"), ("b.csv", bytearray(b"k;v\n1;2\n"), "y"), ("c.pdf", bytearray(b"%PDF"), "z"), ("d.md", None, None)]
    files = spark.createDataFrame(rows, "path string, content binary, markdown_of string")
    done = convert.left_out(convert.converted(files)).cache()
    got = {r.path: r for r in done.collect()}
    assert got["b.csv"].markdown == "| k | v |\n| --- | --- |\n| 1 | 2 |" and got["b.csv"].markdown_of == "y" and got["c.pdf"].error == "unsupported" and got["d.md"].markdown == ""
    assert got["a.docx"].note == "1 pictures; 1 comments; 1 hidden" and got["b.csv"].note == ""
    assert [tuple(r) for r in convert.comment_rows(done).collect()] == [("a.docx", "Ann", "check")]
    assert convert.converted(files.limit(0)).count() == 0


def test_texts_out_and_in(spark, tmp_path):
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "b.md").write_text("two")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("one")
    assert [r.name for r in convert.read_fixtures(spark, str(tmp_path)).collect()] == ["b.md", "a.md"]
    df = spark.createDataFrame([(1, "a\r\nb"), (2, "a\nb")], "k int, text string").withColumn("end", convert.line_ending(F.col("text"))).withColumn("text", F.regexp_replace("text", "\r\n", "\n"))
    convert.write_texts(df, str(tmp_path / "out"), ending="end")
    assert {r.k: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "a\r\nb", 2: "a\nb"}


def test_windows_of_paragraphs():
    words = lambda n, w="w": " ".join([w] * n)
    assert windows.paragraphs("a\nb\n\n## H\nc\n") == [(0, 3, False), (5, 9, True), (10, 11, False)]
    text = f"{words(60)}\n\n{words(60)}\n\n{words(60)}"
    assert [len(t.split()) for _, t in windows.plan_windows(text)] == [120, 60]
    long = f"# Head\n{words(100)}\n{words(100)}\n\ntail"
    got = windows.plan_windows(long)
    assert [t.split()[0] for _, t in got] == ["#", "w", "tail"] and all(long[s : s + len(t)] == t for s, t in got)


def test_windows_within_tokens():
    text = " ".join(f"word{k}" for k in range(100))
    count = lambda t: 10 * len(t.split())
    got = windows.bounded_windows(text, count, 200)
    assert all(count(t) <= 200 and text[s : s + len(t)] == t for s, t in got)
    assert {w for _, t in got for w in t.split()} == set(text.split()) and windows.bounded_windows("", count) == []
    with pytest.raises(windows.WordTooLong):
        windows.bounded_windows("x", lambda t: 10_000)


def test_numbers_over_ranges(spark):
    rows = [(s, "EMAIL", f"k{(7 * k + s) % 90}", k) for s in (1, 2) for k in range(200)] + [(None, "EMAIL", "x", 1)]
    df = spark.createDataFrame(rows, "scope int, category string, key string, at int").repartition(7)
    plain, wide = (mapping.number_aliases(df, ["scope"], ["at"], wide=w) for w in (False, True))
    columns = ["scope", "category", "key", "number", "alias", "n_mentions"]
    assert sorted(map(repr, plain.select(columns).collect())) == sorted(map(repr, wide.select(columns).collect()))


def test_scan_stream_scans_once(spark, tmp_path):
    docs = [(1, "to a@x.org"), (2, "none"), (1, "to b@x.org")]
    for k, rows in enumerate([docs, [(1, "to c@x.org"), (3, "d@x.org")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        events.scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out" / "*")).collect()
        assert sorted(r.doc_id for r in found) == [[1], [1, 3]][k]


def test_inline_syntax():
    kinds = lambda t: [(k, t[s:e]) for s, e, k, _, _ in syntax.read_inline(t)]
    assert kinds("a *b **c*** `*d*` \\*e\\*") == [("emphasis", "*b **c***"), ("strong", "**c**"), ("code", "`*d*`"), ("escape", "\\*"), ("escape", "\\*")]
    assert kinds("snake_case_x __y__ ~~z~~ ==m== $1+1$ $5") == [("strong", "__y__"), ("strike", "~~z~~"), ("highlight", "==m=="), ("math", "$1+1$")]
    assert kinds("![i](a.png) [*x* y](u \"t\") <b>q</b>\n```\n*no*\n```\n*open") == [("image", "![i](a.png)"), ("link", '[*x* y](u "t")'), ("emphasis", "*x*"), ("html", "<b>"), ("html", "</b>")]
    protected = lambda t: [t[s:e] for s, e in syntax.read_protected(t)]
    assert protected("- a\n## H ##\n> 1. b\nPassport:\n46. 18 7\n+ 7 900") == ["- ", "##", " ##", "1. "]
    assert protected('<a href="x">t</a>') == ["<a", "href", ">", "</a>"] and protected("[t](u)") == ["[", "](", ")"]


def test_structure_kept():
    keeps = lambda t, part: syntax.keeps_structure(t, t.index(part), t.index(part) + len(part))
    assert keeps("see Ann Lee now", "Ann Lee") and keeps("a \\_b\\_ c", "\\_b\\_") and keeps("LC#71", "LC#71") and keeps("2 * 3 is", "2 * 3")
    assert not keeps("**Ann** Lee", "**Ann") and not keeps("- Ann", "- Ann") and not keeps("# Ann", "# Ann")


def test_markup():
    from spanloom.sources.imports import to_markdown

    assert to_markdown("<p>a <b> bold </b>b<i></i> <a href='javascript:x'>l</a> <a href='/u'><b>m</b></a></p>") == "a **bold** b [l] [**m**](/u)"
    assert to_markdown("<ol start=3><li>x<li>y<ul><li>z</li></ul></li></ol>t") == "3. x\n4. y\n   - z\n\nt"
    assert to_markdown("<table><tr><th>A<th>B|C</tr><tr><td>1<br>2</td></tr></table><p>n</p>") == "| A | B\\|C |\n| --- | --- |\n| 1<br>2 | |\n\nn"
    assert to_markdown("<b>open <table><tr><td>x") and to_markdown("") == "" and to_markdown(None) is None
