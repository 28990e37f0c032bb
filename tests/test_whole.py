"""Queries that once read or matched a part only, against the whole."""

from spanloom.operators import language, search


def test_closest_languages_reads_every_document(spark, small, same):
    same(language.closest_languages(spark, small), language.CLOSEST_SQL.replace(" WHERE doc_id % 10 < 6", ""))


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggest_finds_edits_anywhere(spark):
    words = ["hte", "old anvill", "cold anvil", "xanvil", "a", "", "é", "béta", "teh"]
    known = ["the", "old anvil", "cold anvil", "anvil", "ab", "abc", "e", "beta", "tea", "a", ""]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    got = sorted(tuple(r) for r in search.suggest(frame(words), frame(known)).collect())
    assert ("hte", "the", 2) in got
    assert got == sorted((w, k, brute_distance(w, k)) for w in words for k in known if w != k and brute_distance(w, k) <= 2)
