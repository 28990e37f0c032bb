"""Operators that SQL can't express, and edges of those that it can."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import history, recognizers, rewrite, structure
from spanloom.operators.evaluation import annotate, strip_gold
from spanloom.operators.lists import always_mentions
from spanloom.operators.mapping import one_edit, spelling_key
from spanloom.operators.search import find
from spanloom.sources import imports
from spanloom.streaming import events


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab-&amp;#97;\n ́é​Ａ[^1]　x", max_size=40))
def test_view_offsets(text):
    seen, edits = structure.read_view(text)
    at = 0
    for s, e, a, b in edits:
        assert text[at:s] == seen[len(seen[: a - (s - at)]) : a]
        at = e
    for k in range(len(seen)):
        s, e = structure.source_range(k, k + 1, edits)
        assert 0 <= s < e <= len(text) and (e - s > 1 or text[s:e] == seen[k] or any(x[0] <= s < x[1] for x in edits))


def test_view_rewrites():
    assert structure.read_view("a&amp;b ＡＢ１ ex-\nample soft­hyphen note[^1].")[0] == "a&b AB1 example softhyphen note."


def test_labelled_numbers(spark):
    text = "ИНН 7707083893, инн: 500100732259. 7707083893\nогрн 1027700132195; СНИЛС 112-233-445 95 и ИНН 7707083894"
    found = recognizers.detections(spark.createDataFrame([(1, text)], "doc_id long, text string"), extensions=False).collect()
    assert sorted((r.category, r.text) for r in found) == [("IDENTITY", "112-233-445 95"), ("TAX", "1027700132195"), ("TAX", "500100732259"), ("TAX", "7707083893"), ("TAX", "7707083893")]


def test_email_edges(spark):
    text = "a.b+c@x.example.com, <q@y.org>. no@host and @z.com x@y.com@ ok_1@d.e-f.io"
    assert [r.text for r in recognizers.detections(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == ["a.b+c@x.example.com", "q@y.org", "ok_1@d.e-f.io"]


def test_restore(spark):
    docs = spark.createDataFrame([(1, "person-1 met ORG_2. And PERSON_3, PERSON_12х, xPERSON_1.")], "doc_id long, text string")
    mapping = spark.createDataFrame([(1, "PERSON_1", "Ann"), (1, "ORG_2", "Acme Inc.")], "doc_id long, key string, value string")
    r = rewrite.restore(docs, mapping).first()
    assert r.restored == "Ann met Acme Inc. And PERSON_3, PERSON_12х, xPERSON_1."
    assert r.unresolved == ["PERSON_3", "PERSON_12"] and [r.restored[x.start : x.end] for x in r.landed] == ["Ann", "Acme Inc"]


def test_gold_marks(spark):
    df = spark.createDataFrame([("Ann of é Acme", [(0, 3, "Ann", "PERSON"), (9, 13, "Acme", "ORG")])], "t string, s array<struct<start:int,end:int,text:string,category:string>>")
    marked = df.select("t", "s", annotate(F.col("t"), F.col("s")).alias("m")).withColumn("b", strip_gold(F.col("m"))).first()
    assert marked.m == "⟦PERSON|Ann⟧ of é ⟦ORG|Acme⟧" and marked.b.text == marked.t and marked.b.spans == marked.s


def test_one_edit(spark):
    names = ["Smithson", "Smitson", "Smithsons", "Jones Bell", "Jones Ball", "short", "shorts"]
    got = {(r.name, r.other) for r in one_edit(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert got == {("Smithson", "Smitson"), ("Smithson", "Smithsons"), ("Jones Ball", "Jones Bell")}


def test_spelling_key(spark):
    df = spark.createDataFrame([("O'Neil-Smith",), ("12-34 ab",), ("12 34",)], "v string")
    assert [r[0] for r in df.select(spelling_key(F.col("v"))).collect()] == ["oneilsmith", "12 34ab", "12 34"]


def test_undo_against_stack(spark):
    random.seed(4)
    rows = [(u, k, random.choice(["keep", "add", "undo"])) for u in range(20) for k in range(random.randint(0, 15))]
    held = {(r.u, r.k) for r in history.apply_undo(spark.createDataFrame(rows, "u int, k int, kind string"), ["u"], ["k"]).collect()}
    expected = set()
    for u in range(20):
        stack = []
        for _, k, kind in sorted(r for r in rows if r[0] == u):
            if kind == "undo":
                stack = stack[:-1]
            else:
                stack.append((u, k))
        expected |= set(stack)
    assert held == expected


def test_always_and_find(spark):
    docs = spark.createDataFrame([(1, "The Cat sat. the cat's mat, CAT"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.word_no, r.key) for r in always_mentions(docs, spark.createDataFrame([("the cat",), ("mat",)], "key string")).collect()) == [(1, 0, "the cat"), (1, 3, "the cat"), (1, 6, "mat")]
    assert [(x.start, x.text) for x in docs.select(find(F.col("text"), "cat", True).alias("s")).first().s] == [(4, "Cat"), (17, "cat"), (28, "CAT")]


def test_markdown():
    markup = "<html><head><title>x</title></head><body><h2>Head</h2><p>One <b>two</b>\n three<br>four</p><ul><li><a href='javascript:x'>bad</a></li><li><a href='/ok'>good</a></li></ul><script>no()</script></body></html>"
    assert imports.to_markdown(markup) == "## Head\n\nOne **two** three\nfour\n\n- [bad]\n- [good](/ok)"
    assert imports.to_markdown(None) is None and imports.to_markdown("") == ""


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.bin").write_bytes(b"PK\x03\x04zip")
    (tmp_path / "c.bin").write_bytes(b"nothing")
    (tmp_path / "d.md").write_text("# T\n\nx")
    (tmp_path / "e.csv").write_text("name;n\nA|b;1\n")
    got = {r.path.rsplit("/", 1)[-1]: r.format for r in imports.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "pdf", "b.bin": "zip", "d.md": None, "e.csv": None}
    assert imports.read_markdown(spark, str(tmp_path)).first().text == "# T\n\nx"
    assert imports.read_csv(spark, str(tmp_path / "e.csv")).first().line == r"| A\|b | 1 |"


def test_streams(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).drop("batch").exceptAll(recognizers.detections(docs)).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == recognizers.detections(docs).count()


def test_stream_aliases(spark, tmp_path):
    rows = [("s", "EMAIL", k, d, 0) for d, k in enumerate(["a", "b", "a", "c", "b"])]
    df = spark.createDataFrame(rows, "scope string, category string, key string, doc_id long, start_cp int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = events.allocate_aliases(stream).writeStream.format("memory").queryName("aliases").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.key, r.alias) for r in spark.sql("SELECT key, alias FROM aliases").collect()) == [("a", "EMAIL_1"), ("b", "EMAIL_2"), ("c", "EMAIL_3")]


def test_join_case(spark):
    """Aliases never meet: matched identities take the case's, others keep theirs only if nobody has or had it."""
    from spanloom.operators.cases import join_case

    document = "case_id int, doc_id int, position int, alias string, previous array<string>, category string, originals array<string>"
    case = "case_id int, pos int, alias string, previous array<string>, category string, originals array<string>"

    def joined(own, theirs):
        rows = join_case(spark.createDataFrame([(1, *x) for x in own], document), spark.createDataFrame([(1, *x) for x in theirs], case)).collect()
        return {(r.doc_id, r.position): (r.joined_alias, r.outcome) for r in rows}

    e = "EMAIL"
    assert joined([(5, 1, "EMAIL_1", [], e, ["a"]), (5, 2, "EMAIL_2", None, e, ["b"])], [(1, "EMAIL_1", [], e, ["b"])]) == {(5, 1): ("EMAIL_3", "numbered"), (5, 2): ("EMAIL_1", "matched")}
    # forgotten and earlier names are taken; two identities can't be one; each document is by itself
    got = joined(
        [(5, 1, "EMAIL_7", [], e, ["x"]), (5, 2, "EMAIL_8", ["EMAIL_4"], e, ["y"]), (5, 3, "EMAIL_9", [], e, ["z", "w"]), (5, 4, "Boss", [], e, ["w"]), (6, 1, "EMAIL_20", [], e, ["w"]), (6, 2, "EMAIL_20", [], e, ["q"]), (6, 3, "EMAIL_20", [], e, ["r"])],
        [(1, "EMAIL_2", ["EMAIL_7"], e, []), (2, "EMAIL_3", ["EMAIL_4"], e, ["k"]), (3, "EMAIL_5", [], e, ["w", "z"])],
    )
    assert got == {(5, 1): ("EMAIL_10", "numbered"), (5, 2): ("EMAIL_11", "numbered"), (5, 3): ("EMAIL_5", "matched"), (5, 4): ("Boss", "kept"), (6, 1): ("EMAIL_5", "matched"), (6, 2): ("EMAIL_20", "kept"), (6, 3): ("EMAIL_21", "numbered")}
    assert joined([], [(1, "EMAIL_1", [], e, ["b"])]) == {} and joined([(5, 1, "EMAIL_1", [], e, ["a"])], []) == {(5, 1): ("EMAIL_1", "kept")}


def test_upsert_case(spark):
    from spanloom.operators.cases import upsert_case

    kind = "case_id int, pos int, alias string, previous array<string>, originals array<string>"

    def merged(case, members):
        rows = upsert_case(spark.createDataFrame([(1, *x) for x in case], kind), spark.createDataFrame([(1, *x) for x in members], kind)).collect()
        return {r.alias: (r.previous, r.originals) for r in rows}

    case = [(1, "P_1", ["OLD_1"], ["ann"]), (2, "P_2", [], ["bob"]), (3, "P_3", [], ["cy"]), (4, "P_4", ["P_40"], [])]
    assert merged(case, [(1, "OLD_1", [], ["Ann"])])["OLD_1"] == (["P_1"], ["Ann", "ann"])  # the earlier alias is the same identity
    assert merged(case, [(1, "X_9", [], ["bob", "Bob"])])["X_9"] == (["P_2"], ["Bob", "bob"])  # by wording
    assert merged(case, [(1, "P_1", ["P_3"], ["ann"])]) == {"P_1": (["OLD_1", "P_3"], ["ann", "cy"]), "P_2": ([], ["bob"]), "P_4": (["P_40"], [])}  # absorbed
    assert merged(case, [(1, "N_1", ["P_40"], ["dan"])]) == {"P_1": (["OLD_1"], ["ann"]), "P_2": ([], ["bob"]), "P_3": ([], ["cy"]), "P_4": (["P_40"], [])}  # forgotten stays forgotten
    assert merged(case, [(1, "Z_1", [], ["zoe"])])["Z_1"] == ([], ["zoe"]) and len(merged([], [(1, "Z_1", [], ["zoe"])])) == 1
    assert merged(case, [])["P_1"] == (["OLD_1"], ["ann"])


def test_mappings_with_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(1, "to a@x.org and b@x.org"), (1, "b@x.org."), (None, "a@x.org"), (2, None)], "doc_id int, text string")
    mapping = spark.createDataFrame([(1, "a@x.org", "EMAIL_2"), (1, "a@x.org", "EMAIL_1"), (1, None, "EMAIL_3"), (1, "b@x.org", None), (2, "a@x.org", "EMAIL_9")], "doc_id int, key string, value string")
    got = rewrite.pseudonymize(docs, mapping, recognizers.EMAIL, F.lower).collect()
    assert sorted((r.pseudonymized or "", r.n_replaced) for r in got) == [("", 0), ("a@x.org", 0), ("b@x.org.", 0), ("to EMAIL_1 and b@x.org", 1)]


def test_long_wordings_on_the_list(spark):
    docs = spark.createDataFrame([(1, "Then Mary  Ann\nLewis, and mary ann."), (2, None), (3, "")], "doc_id int, text string")
    listed = spark.createDataFrame([("Mary Ann Lewis",), ("mary ann",), ("--",), ("then mary ann lewis and mary",)], "key string")
    assert sorted((r.doc_id, r.word_no, r.key) for r in always_mentions(docs, listed).collect()) == [(1, 0, "then mary ann lewis and mary"), (1, 1, "Mary Ann Lewis"), (1, 1, "mary ann"), (1, 5, "mary ann")]


def test_view_of_marks_and_tables():
    seen = lambda t: structure.read_view(t)[0]
    assert seen("D E L V A   R O S K") == "DELVA ROSK" and seen("И Н Н: 77") == "ИНН: 77" and seen("**J R R** Tolkien") == "**J R R** Tolkien" and seen("A B") == "A B"
    assert seen("**An**na and *Lee* 2 * 3") == "Anna and *Lee* 2 * 3" and seen("snake_case") == "snake_case"
    assert seen("[a](x%20y_z) [b](mailto:a_b@c.d) [c](%FF)") == "[a](x y z) [b](mailto:a_b@c.d) [c](%FF)"
    table = "| Name | **Phone No.** |\n|:--|--:|\n| Ann | 12 |\n| Bob | - |\n\n| 13 | 14 |"
    text, edits = structure.read_view(table)
    assert text == table.replace("| 12", "| Phone No.: 12") and structure.source_range(text.index("12"), text.index("12") + 2, edits) == (table.index("12"), table.index("12") + 2)
    assert structure.view_range(table.index("12"), table.index("12") + 2, edits) in ((text.index("12"), text.index("12") + 2), (text.index("Phone No.:"), text.index("12") + 2))
    assert structure.decoded("a&amp;b") == "a&b" and structure.wording(" a  &amp;\n b ") == "a & b" and structure.discovery_view("**An**na &amp;")[0] == "Anna &amp;"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab&amp;#97;\n*_ [](%20)|-¹ÂИН", max_size=50), st.integers(0, 50), st.integers(0, 8))
def test_view_ranges_go_there_and_back(text, start, size):
    seen, edits = structure.read_view(text)
    start, end = min(start, len(text)), min(start + size, len(text))
    a, b = structure.view_range(start, end, edits)
    assert 0 <= a <= b <= len(seen)
    s, e = structure.source_range(a, b, edits) if a < b else (start, end)
    gone = {k for x in edits if x[2] == x[3] for k in range(x[0], x[1])}  # what the view drops may be left out at the ends
    assert set(range(start, end)) - gone <= set(range(s, e))
