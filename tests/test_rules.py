from pyspark.sql import functions as F

from spanloom.functions.spans import chunks
from spanloom.operators import names, rules, windows

SPANS = "array<struct<start:int,end:int,text:string,category:string>>"


def test_labels(spark):
    text = "Passport no. AB 1234567; Date of birth: 01.02.1990\nSurname: Müller-Lee\nIBAN DE44 5001 0517 5407 3249 31 tel 12\n03.04.1980 г.р."
    df = spark.createDataFrame([(text,)], "t string")
    got = {(x.category, x.text) for x in df.select(rules.labelled_values(F.col("t")).alias("s")).first().s}
    assert ("DATE", "01.02.1990") in got and ("DATE", "03.04.1980") in got and ("PERSON", "Müller-Lee") in got and ("BANK", "DE44 5001 0517 5407 3249 31") in got
    assert not any(c == "PHONE" for c, _ in got)
    for x in df.select(rules.labelled_values(F.col("t")).alias("s")).first().s:
        assert text[x.start : x.end] == x.text


def test_span_filters(spark):
    text = "He met Ann. Bob left_x and Cy."
    df = spark.createDataFrame([(text, [(7, 10, "Ann", "PERSON"), (12, 15, "Bob", "PERSON"), (16, 20, "left", "ORG"), (0, 2, "He", "PERSON")])], f"t string, s {SPANS}")
    row = df.select(F.transform("s", lambda s: rules.mid_sentence(chunks(F.col("t")), s)).alias("m"), F.transform("s", lambda s: rules.whole_word(chunks(F.col("t")), s)).alias("w")).first()
    assert row.m == [True, False, True, False] and row.w == [True, True, False, True]
    words = spark.createDataFrame([("MOCKBA",), ("МОСКВА",), ("Boston",)], "w string")
    assert [r[0] for r in words.select(rules.lookalike_key(F.col("w")) == "москва").collect()] == [True, True, False]
    aliases = spark.createDataFrame([([(0, 8, "PERSON_1", "PERSON"), (0, 3, "Org", "ORG"), (0, 4, "Acme", "ORG")],)], f"s {SPANS}")
    assert aliases.select(F.transform("s", rules.generated_alias)).first()[0] == [True, True, False]


def test_boundaries(spark):
    df = spark.createDataFrame([("- Ann Lee Roy", [(0, 9, "- Ann Lee", "PERSON"), (10, 13, "Roy", "PERSON")])], f"t string, s {SPANS}")
    stripped = df.select("t", rules.strip_list_marker(F.col("s")).alias("s"))
    assert [tuple(x) for x in stripped.first().s] == [(2, 9, "Ann Lee", "PERSON"), (10, 13, "Roy", "PERSON")]
    assert [tuple(x) for x in stripped.select(rules.join_names(F.col("t"), F.col("s")).alias("j")).first().j] == [(2, 13, "Ann Lee Roy", "PERSON")]
    cut = spark.createDataFrame([([(0, 20, "Ann a@b.com Lee Roys", "PERSON"), (30, 33, "Bob", "PERSON")], [(4, 11, "a@b.com", "EMAIL")])], f"s {SPANS}, r {SPANS}")
    assert [tuple(x) for x in cut.select(rules.beside_rules(F.col("s"), F.col("r")).alias("c")).first().c] == [(0, 3, "Ann", "PERSON"), (12, 20, "Lee Roys", "PERSON"), (30, 33, "Bob", "PERSON")]


def test_ranked_union(spark):
    df = spark.createDataFrame([([(2, 0, 9, "ORG", "x"), (1, 3, 5, "PERSON", "y"), (2, 9, 12, "ORG", "z")],)], "s array<struct<rank:int,start:int,end:int,category:string,text:string>>")
    assert [(x.rank, x.start) for x in df.select(rules.ranked_union(F.col("s")).alias("u")).first().u] == [(1, 3), (2, 9)]


def test_machine_zone(spark):
    df = spark.createDataFrame([("L898902C36UTO7408122F1204159ZE184226B<<<<<10",), ("L898902C35UTO7408122F1204159ZE184226B<<<<<10",), ("short",)], "l string")
    a, b, c = [r[0] for r in df.select(rules.machine_zone(F.col("l"))).collect()]
    assert (a.number, a.number_holds, a.birth_holds, a.expiry_holds) == ("L898902C3", True, True, True) and not b.number_holds and c is None


def test_names(spark):
    df = spark.createDataFrame([("Ludwig van der Berg",), ("Ann",), ("Anna Maria Lee",)], "n string")
    rows = [{f.kind: f.form for f in r[0]} for r in df.select(names.forms(F.col("n"))).collect()]
    assert rows[0]["surname"] == "van der Berg" and rows[0]["initials"] == "L. van der Berg" and rows[1] == {"whole": "Ann"}
    assert rows[2]["initials"] == "A. M. Lee" and rows[2]["reversed"] == "Lee Anna Maria" and rows[2]["bare initials"] == "AML"
    people = spark.createDataFrame([("s", "Ann Lee"), ("s", "Bob Lee"), ("s", "Cy Roy"), ("t", "Ann Lee")], "scope string, person string")
    said = spark.createDataFrame([("s", "Lee"), ("s", "roy"), ("s", "B. Lee"), ("t", "Lee")], "scope string, mention string")
    assert {(r.scope, r.mention): r.person for r in names.link_forms(said, people).collect()} == {("s", "Lee"): None, ("s", "roy"): "Cy Roy", ("s", "B. Lee"): "Bob Lee", ("t", "Lee"): "Ann Lee"}
    assert spark.createDataFrame([("Иванович",), ("Петровной",), ("Smith",)], "w string").select(names.is_patronymic(F.col("w"))).collect() == [(True,), (True,), (False,)]


def test_windows():
    text = "# Head\none two\n" + "w " * 300 + "\nlast line\n# Next\nx"
    found = windows.plan_windows(text)
    assert [text[s : s + len(t)] for s, t in found] == [t for _, t in found]
    assert all(len(t.split()) <= 128 for _, t in found)
    covered = {k for s, t in found for k in range(s, s + len(t))}
    assert all(k in covered for k, c in enumerate(text) if not c.isspace())
    assert windows.plan_windows(None) == windows.plan_windows("") == []


def test_model_runs_once_per_text(spark):
    docs = spark.createDataFrame([(k, "same text Abc") for k in range(5)] + [(9, None)], "doc_id long, text string")
    got = windows.run_model(windows.windows(docs), lambda texts: [[(10, 13, "person", 0.9), (0, 99, "person", 1.0), (0, 4, "unknown", 1.0)] for _ in texts]).collect()
    assert sorted((r.doc_id, r.start_cp, r.value, r.category) for r in got) == [(k, 10, "Abc", "PERSON") for k in range(5)]
