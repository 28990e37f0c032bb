import random
import re

from pyspark.sql import functions as F

from spanloom.functions.spans import find_spans, greedy_select, merge_ranges, replace_spans, running_sums

PIECES = ["ab", "a", "b", "é", "😀", "", " ", "aab", "\n"]


def test_find_spans(spark):
    random.seed(1)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 20))) for _ in range(200)] + ["", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", find_spans(F.col("t"), "a+b?").alias("s")).collect()
    for r in rows:
        assert [(x.start, x.end, x.text) for x in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer("a+b?", texts[r.k] or "")]


def test_merge_ranges(spark):
    random.seed(2)
    data = [(k, [(s := random.randint(0, 30), s + random.randint(1, 6)) for _ in range(random.randint(0, 8))]) for k in range(60)]
    rows = spark.createDataFrame(data, "k int, r array<struct<start:int,end:int>>").select("k", merge_ranges(F.col("r")).alias("m")).collect()
    for r in rows:
        out = []
        for s, e in sorted(data[r.k][1]):
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
        assert [tuple(x) for x in r.m] == out


def test_greedy_select(spark):
    random.seed(3)
    data = [(k, [(s := random.randint(0, 40), s + random.randint(1, 9), "t", random.choice("AB"), random.choice([0.5, 0.9]), "r", random.random() < 0.5) for _ in range(random.randint(0, 9))]) for k in range(80)]
    kind = "array<struct<start:int,end:int,text:string,category:string,score:double,recognizer:string,is_rule:boolean>>"
    rows = spark.createDataFrame(data, f"k int, s {kind}").select("k", greedy_select(F.col("s")).alias("g")).collect()
    for r in rows:
        out = []
        for x in sorted(data[r.k][1], key=lambda x: (not x[6], -x[4], x[1] - x[0], x[0], x[1], x[3])):
            if not any(x[0] < y[1] and y[0] < x[1] for y in out):
                out.append(x)
        assert [(x.start, x.end, x.category) for x in r.g] == sorted((x[0], x[1], x[3]) for x in out)


def test_replace_spans(spark):
    df = spark.createDataFrame([("ab😀cd", [(0, 1, "X"), (2, 3, "YY"), (4, 5, "")])], "t string, s array<struct<start:int,end:int,alias:string>>")
    assert df.select(replace_spans(F.col("t"), F.col("s"))).first()[0] == "XbYYc"
    assert df.select(replace_spans(F.col("t"), F.slice("s", 1, 0))).first()[0] == "ab😀cd"


def test_running_sums(spark):
    data = [(list(range(n)),) for n in (0, 1, 2, 3, 7, 16, 17, 40)]
    for (r,) in spark.createDataFrame(data, "x array<int>").select(F.struct("x", running_sums(F.col("x")).alias("s"))).collect():
        assert r.s == [sum(r.x[:k]) for k in range(len(r.x))]


def test_parts_of_long_texts(spark):
    random.seed(4)
    text = "".join(random.choice("abé😀 ") for _ in range(13_000))
    cuts = sorted(random.sample(range(len(text)), 60))
    spans = [(s, e, random.choice(["", "X", "EMAIL_12"])) for s, e in zip(cuts[::2], cuts[1::2], strict=True)]
    out, at = [], 0
    for s, e, x in spans:
        out += [text[at:s], x]
        at = e
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int,alias:string>>")
    assert df.select(replace_spans(F.col("t"), F.col("s"))).first()[0] == "".join(out) + text[at:]


def test_twenty_thousand_spans_in_two_megabytes(spark):
    """The time grows with the text: a quadratic fold took minutes."""
    import time

    text = ("x" * 90 + " ann@ex.org, ") * 20_000
    df = spark.createDataFrame([(text,)], "t string").cache()
    df.count()
    spans = F.transform(find_spans(F.col("t"), "[a-z]+@[a-z.]+"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("EMAIL_1").alias("alias")))
    began = time.time()
    found = df.select(spans.alias("s"), "t").select(F.size("s").alias("n"), replace_spans(F.col("t"), F.col("s")).alias("t")).first()
    assert found.n == 20_000 and found.t == ("x" * 90 + " EMAIL_1, ") * 20_000 and time.time() - began < 60
