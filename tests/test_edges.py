"""Nulls, empty tables, repeated rows and clashing columns, as the docstrings define them."""

from pyspark.sql import functions as F

from spanloom.operators import cases, filters, fixes, mapping, review, search, shapes, structure, tables
from spanloom.operators.recognizers import detections

SPAN = "doc_id long, start_cp int, end_cp int, value string, category string, recognizer string"


def test_nulls_everywhere(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "to a@b.org", 6), (None, "to a@b.org", 6), (2, "", 7)], "doc_id long, text string, start int")
    assert [(r.doc_id, r.start, r.text) for r in detections(docs).collect()] == [(None, 3, "a@b.org")] * 2
    assert filters.context_spans(docs, "a@").count() == 2 and tables.table_rows(docs).count() == 0
    assert structure.lines(docs).count() == 3 and docs.select(structure.view("text").alias("v")).where("v.text = ''").count() == 2
    assert search.word_counts(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang = ''").count() == 4
    assert review.known_mentions(docs, spark.createDataFrame([(None, "P_1"), ("", "P_2"), ("b", "P_3")], "wording string, alias string")).count() == 0  # a null id meets nothing
    assert review.find_visible(docs, "to").count() == 2


def test_empty_tables(spark):
    spans = spark.createDataFrame([], SPAN)
    for fix in (fixes.spans_that_stand, fixes.urls_outside, fixes.trim_at_dates, fixes.names_before_cities, fixes.yield_to_whole_values, fixes.rest_beside_rules, fixes.trim_fixed, fixes.relabel_by_document, fixes.relabel_dockets):
        assert fix(spans).count() == 0 and fix(spans).columns == spans.columns
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert filters.without_cited(filters.context_spans(docs, "x"), docs).count() == 0 and tables.cells(tables.table_rows(docs)).count() == 0
    assert shapes.proposals(filters.context_spans(docs, "x").withColumn("category", F.lit("PERSON"))).count() == 0
    case = spark.createDataFrame([], "case_id int, pos int, alias string, previous array<string>, category string, originals array<string>")
    merges = spark.createDataFrame([], "case_id int, alias string, into string")
    assert cases.upsert_case(case, case).count() == 0 and cases.merge_identities(case, merges).count() == 0 and cases.reserved_aliases(case).count() == 0
    assert mapping.number_aliases(spark.createDataFrame([], "s int, category string, key string, at int"), ["s"], ["at"], wide=True).count() == 0


def test_spans_with_nulls_stay(spark):
    rows = [(1, 0, 5, None, None, "model"), (None, 0, 5, "Ann", "PERSON", None), (1, 2, 4, "x", "PERSON", "model"), (1, 2, 4, "x", "PERSON", "model")]
    spans = spark.createDataFrame(rows, SPAN)
    for fix in (fixes.trim_fixed, fixes.relabel_by_document, fixes.relabel_dockets):
        assert sorted(map(repr, fix(spans).collect())) == sorted(map(repr, spans.collect()))
    assert filters.never_words(spans, spark.createDataFrame([("x", "whole", 0), (None, "whole", 0)], "word string, form string, ending int")).count() == 2
    assert spans.where(shapes.shaped(F.col("value"), F.col("category"), F.lit(None).cast("string"))).count() == 2  # no category, no shape asked for


def test_merges_follow_chains(spark):
    case = spark.createDataFrame([(1, a, [], [a.lower()]) for a in "ABCDE"] + [(2, "A", [], ["z"])], "case_id int, alias string, previous array<string>, originals array<string>")
    merges = spark.createDataFrame([(1, "A", "B"), (1, "B", "C"), (1, "D", "D"), (1, "E", "X"), (2, "A", "B")], "case_id int, alias string, into string")
    got = {(r.case_id, r.alias): (sorted(r.previous), sorted(r.originals)) for r in cases.merge_identities(case, merges).collect()}
    assert got == {(1, "C"): (["A", "B"], ["a", "b", "c"]), (1, "D"): ([], ["d"]), (1, "E"): ([], ["e"]), (2, "A"): ([], ["z"])}
