"""Near-duplicates by shingle sets against brute-force Jaccard."""

import random

import numpy as np
import pytest
from test_duplicates import smallest

from spanloom.llm import near_copies, simhash

pipeline = pytest.importorskip("corpus_pipeline")


def brute_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(docs):
    """The ids that stay, all pairs compared."""
    sets, holders = {k: brute_shingles(t) for k, t in docs}, {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    links = set()
    for k, s in sets.items():
        for o in {o for x in s for o in holders[x] if o < k}:
            both = len(s & sets[o])
            if 10 * both >= 8 * (len(s) + len(sets[o]) - both):
                links.add((o, k))
    return sorted(set(smallest(links, sets).values()))


def edited(words, n):
    out = list(words)
    for k in random.sample(range(len(out)), n):
        out[k] = f"new{random.random()}"
    return " ".join(out)


def corpus():
    """Texts of 60 to 300 words, each with copies of 0 to 6 changed words per 100; many lie close to 0.8."""
    random.seed(11)
    docs = []
    for _ in range(60):
        words = [f"w{random.randrange(4000)}" for _ in range(random.randint(60, 300))]
        docs += [edited(words, round(len(words) * x / 100)) for x in (0, 0, 1, 2, 2, 3, 4, 6)]
    docs += ["one two", "ONE\ttwo ", "", None, "\n", "a b c d e", "a b c d e f"]
    ids = random.sample(range(10_000), len(docs))
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("block", [near_copies.BLOCK, 400])
def test_survivors(spark, block):
    docs = corpus()
    found = near_copies.survivors(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block=block)
    assert sorted(r.id for r in found.collect()) == brute_kept(docs)


def test_pipeline_stage_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_similar_is_exact():
    random.seed(12)
    sets = [np.array(sorted(random.sample(range(60), random.randint(1, 50))), np.uint64) for _ in range(150)]
    sets += [np.delete(s, random.randrange(len(s))) for s in sets if len(s) > 1]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))]
    assert smallest(near_copies.similar(sets), range(len(sets))) == smallest(links, range(len(sets)))


def test_empty(spark):
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("keep_one", [near_copies.keep_one, simhash.keep_one])
def test_null_and_repeated_ids(spark, keep_one):
    random.seed(13)
    a, b, c, d, e = (" ".join(f"w{random.randrange(4000)}" for _ in range(80)) for _ in range(5))
    rows = [(None, a, 1), (None, b, 2), (None, a, 3), (7, c, 4), (7, d, 5), (7, d, 6), (8, d, 7), (9, e, 8), (3, e, 9), (None, None, 10)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, _uid int"))
    assert kept.columns == ["doc_id", "text", "_uid"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=key) == sorted([(None, a), (None, b), (None, None), (7, c), (7, d), (3, e)], key=key)
