"""SimHash components and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from spanloom.llm import simhash, suffix_dedup
from spanloom.llm.components import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(links, vertices):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def test_components(spark):
    random.seed(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(random.randint(0, 90), random.randint(0, 90)) for _ in range(60)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = smallest([e for e in edges if e[0] != e[1]], {v for e in edges for v in e})
    assert got == {v: c for v, c in expected.items() if v in got} and all(v in got or expected[v] == v for v in expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    random.seed(2)
    words = ["alpha", "Beta", "gamma", "É", "x1", "the", "of", "zeta"]
    base = [" ".join(random.choice(words) for _ in range(random.randint(0, 60))) for _ in range(40)]
    texts = base + [b.upper() for b in base[:10]] + [b + " more" for b in base[10:30]] + base[:5] + ["", None, " \n", "one", "one two"]
    rows = [(7 * k % 1000, t, "x") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = {k: brute_fingerprint(t) for k, t, _ in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    expected = smallest(links, fps)
    assert {k: r.fp % 2**64 for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == expected
    kept = simhash.keep_one(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, fp string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values())) and kept.columns == ["doc_id", "text", "fp"]


@pytest.mark.parametrize("hot", [8192, 20])
def test_links_of_dense_groups(spark, hot):
    random.seed(3)
    fps = set()
    for b in [random.getrandbits(64) for _ in range(4)]:
        for _ in range(120):
            x = b
            for _ in range(random.randint(0, 4)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    array = np.array(sorted(fps), np.uint64)
    signed = array.view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()
    links = [(signed[i], signed[int(j)]) for i in range(len(array)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3) if i < j]
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 3 for r in found)
    assert smallest([(r.a, r.b) for r in found], signed) == smallest(links, signed)


def test_op8(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fps = {k: brute_fingerprint(t) for k, t in docs.items()}
    expected = smallest([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash_near_dedup(spark, small).collect()}
    assert got == {k: (f"{fps[k]:016x}", expected[k]) for k in docs}


def test_plans_cover_every_link(spark):
    """Whatever parts and thresholds a plan has: fingerprints within the distance agree on some probed part to within its threshold."""
    random.seed(6)
    fps = [random.getrandbits(64) for _ in range(300)]
    near = [(x, x ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 3)))) for x in fps]
    rows = [(int(np.array(x, np.uint64).view(np.int64)),) for pair in near for x in pair]
    parts = simhash.plan(spark.createDataFrame(rows, "fp long").distinct())
    assert all(any(sum((a ^ b) >> k & 1 for k in bits) <= t for bits, t in parts) for a, b in near)


def test_allocate():
    assert simhash.allocate([[0, 1, 9], [0, 5, 9], [0, 1, 2]], 1) == [0, 0, 1]
    assert sum(simhash.allocate([[0, 3, 4]] * 4, 0)) == 0


def brute_dedup(docs):
    seen, out = set(), {}
    for key, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[key] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_order():
    for seed in range(300):
        random.seed(seed)
        text = [random.randint(1, random.choice([1, 2, 4])) for _ in range(random.randint(0, 60))]
        assert suffix_dedup.suffix_order(np.array(text, np.int64), 1, 10**9).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def passages(n, seed):
    random.seed(seed)
    parts = ["".join(random.choice("abcdé ") for _ in range(random.randint(90, 260))) for _ in range(6)]
    fresh = lambda: "".join(random.choice("abxyz") for _ in range(random.randint(0, 90)))
    return [(3 * k, "".join(random.choice([random.choice(parts), fresh(), "a" * random.randint(0, 150)]) for _ in range(random.randint(0, 9)))) for k in range(n)] + [(3 * n, None)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup(spark, hot):
    docs = passages(80, 5)
    df = spark.createDataFrame([(k, t, "r", 1) for k, t in docs], "doc_id long, text string, row string, uid int")
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, hot=hot, least_bytes=2000).collect()}
    assert got == brute_dedup(docs)


def test_long_texts_are_cut_anywhere(spark, monkeypatch):
    docs = passages(30, 6)
    docs[4] = (docs[4][0], "".join(t or "" for _, t in docs) * 2)
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), least_bytes=1000).collect()}
    assert got == brute_dedup(docs)
    whole = np.frombuffer(("xyz" * 500).encode(), np.uint8)
    start, count, _ = suffix_dedup.runs(whole, len(whole) - np.arange(len(whole)), suffix_dedup.Powers(4096))
    assert start[0] == 0 and count.sum() == len(whole) - 99


def test_runs_stay_inside_texts():
    random.seed(9)
    texts = ["".join(random.choice("abc") for _ in range(random.choice([0, 50, 99, 100, 101, 700]))).encode() for _ in range(60)]
    pack = suffix_dedup.zstandard.ZstdCompressor().compress
    table = suffix_dedup.pa.table({"uid": list(range(60)), "data": [pack(t) for t in texts]})
    block = suffix_dedup.Block(table)
    at, m, h, _ = block.runs(suffix_dedup._powers())
    doc, offset = block.places(at)
    starts = {(int(d), int(o) + k) for d, o, n in zip(doc, offset, m) for k in range(n)}  # noqa: B905
    assert starts == {(d, o) for d, t in enumerate(texts) for o in range(len(t) - 99)} and len(starts) == m.sum()
    anchor_of = {}
    for d, o, n, x in zip(doc.tolist(), offset.tolist(), m.tolist(), h.tolist()):  # noqa: B905
        for k in range(n):
            assert anchor_of.setdefault(texts[d][o + k : o + k + 100], x) == x
    some = np.unique(h)[::2]
    part = block.runs(suffix_dedup._powers(), some)
    assert (part[0] == at[np.isin(h, some)]).all()


def test_digests_decide_nothing():
    """Two runs whose digests agree are told apart by their bytes."""
    data = np.frombuffer(b"a" * 150 + b"a" * 149 + b"b" + b"a" * 150, np.uint8)
    same = np.zeros(3, np.uint64)
    at = np.array([0, 150, 300])
    order, again = suffix_dedup.equal_runs(suffix_dedup._words(data), same, np.array([51] * 3), same, at, at)
    assert order.tolist() == [0, 1, 2] and again.tolist() == [False, False, False]
    order, again = suffix_dedup.equal_runs(suffix_dedup._words(data), same, np.array([50] * 3), same, at, at)
    assert again.tolist() == [False, True, True]


def test_op2(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op2_suffix_dedup(spark, small).collect()}
    assert got == brute_dedup(docs)


def test_shared_lead_in(spark):
    """Strings that begin with the same passage meet in groups of bounded size, wherever they differ."""
    random.seed(10)
    lead = "licensed under the terms that follow below: "
    tails = ["".join(random.choice("abcdefgh ") for _ in range(90)) for _ in range(60)]
    docs = [(k, "".join(random.choice("uvwxyz") for _ in range(30)) + lead + random.choice(tails)) for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, hot=5, least_bytes=500).collect()}
    assert got == brute_dedup(docs)


def test_repeated_ids_and_kept_text(spark):
    random.seed(8)
    text = "".join(random.choice("éabcdefgh") for _ in range(280))
    size = len(text.encode())
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (None, text, "c"), (2, "short", "d")], "doc_id long, text string, lang string")
    rows = [r.asDict(True) for r in suffix_dedup.dedup(df, keep_text=True).select("row.*", "n_removed").collect()]
    assert sorted(r["n_removed"] for r in rows) == [0, 0, size, size] and {r["lang"] for r in rows} == set("abcd")
    assert sorted(len(r["text"]) for r in rows) == [0, 0, 5, 280]
    assert next(r for r in rows if r["doc_id"] is None)["n_removed"] == 0


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(none).count() == 0 and simhash.near_duplicates(none).count() == 0
