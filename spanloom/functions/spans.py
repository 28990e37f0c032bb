"""Spans as arrays of structs (start, end, text), in code points, half-open; all with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A mark that is put around matches, and what stands in for it where a text holds it (of the same length).
MARK, SWAP = "\ue000", "\ue001"
SPAN = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column) -> Column:
    """Per number of an array the sum of those before it: sums of stretches first, so that no step copies what came before."""
    kind = "array<int>"

    def plus(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda s, y: (s + y).cast("int"))

    def stretches(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x).cast("double"))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), width), lambda k: F.slice(x, k, width))

    def flat(parts: Column) -> Column:
        def within(sums: Column) -> Column:
            return F.flatten(F.transform(parts, lambda part, k: let(plus(F.slice(sums, F.lit(1), k)), lambda start: F.transform(part, lambda _, i: (start + plus(F.slice(part, F.lit(1), i))).cast("int")))))

        return let(F.transform(parts, plus), within)

    return F.when(F.size(numbers) <= 0, F.array().cast(kind)).otherwise(let(numbers.cast(kind), lambda x: let(stretches(x), flat)))


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern without groups that matter; null text: no spans."""
    none = F.array().cast(SPAN)
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, SWAP), f"({pattern})", f"{MARK}$1{MARK}"), MARK)

    def placed(p: Column) -> Column:
        # odd pieces, counted from 0, are the matches
        at = running_sums(F.transform(p, lambda x: F.length(x)))
        return let(at, lambda a: F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda k: F.struct(F.get(a, k).alias("start"), (F.get(a, k) + F.length(F.get(p, k))).cast("int").alias("end"), F.get(p, k).alias("text"))))

    return F.when(text.rlike(pattern), let(pieces, placed)).otherwise(none)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def merge_ranges(ranges: Column) -> Column:
    """Ranges (start, end) coalesced where they overlap or touch."""
    kind = "array<struct<start:int,end:int>>"

    plain = F.transform(ranges, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end")))
    return F.aggregate(F.sort_array(plain), F.array().cast(kind), _widen)


def _widen(out: Column, r: Column) -> Column:
    last = F.try_element_at(out, F.lit(-1))
    wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
    rest = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
    return F.when((F.size(out) > 0) & (r["start"] <= last["end"]), F.concat(rest, F.array(wider))).otherwise(F.concat(out, F.array(r)))


def greedy_select(spans: Column) -> Column:
    """Of spans (is_rule, score, start, end, category, text) those that stand: rules first, then the higher score, the
    shorter, the earlier; each is taken if it overlaps nothing taken before. Ties fall to category and text."""
    ranked = F.transform(
        spans,
        lambda s: F.struct(
            (F.when(s["is_rule"], 0).otherwise(1)).alias("r"), (-s["score"]).alias("n"), (s["end"] - s["start"]).alias("l"), s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), s["text"].alias("text"), s["is_rule"].alias("is_rule"), s["score"].alias("score")
        ),
    )
    kind = "array<struct<start:int,end:int,category:string,text:string,is_rule:boolean,score:double>>"

    def step(out: Column, s: Column) -> Column:
        one = F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["category"].alias("category"), s["text"].alias("text"), s["is_rule"].alias("is_rule"), s["score"].cast("double").alias("score"))
        return F.when(F.exists(out, lambda o: overlaps(o, s)), out).otherwise(F.concat(out, F.array(one)))

    return F.array_sort(F.aggregate(F.array_sort(ranked), F.array().cast(kind), step))


#: Code points of the chunks that a text is cut into, so that reading a part doesn't walk the whole text.
CHUNK = 4096


def chunks(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(CHUNK)), lambda k: F.substring(text, k, F.lit(CHUNK)))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Of a text in chunks, what lies from start to end."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * CHUNK + 1, end - start)


def replace_spans(text: Column, spans: Column) -> Column:
    """text with each of the sorted, disjoint spans (start, end, alias) replaced by its alias."""

    def written(pieces: Column) -> Column:
        before = lambda s, k: F.coalesce(F.get(spans, k - 1)["end"].cast("int"), F.lit(0))
        body = F.transform(spans, lambda s, k: F.concat(part(pieces, before(s, k), s["start"].cast("int")), s["alias"]))
        tail = part(pieces, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"].cast("int"), F.lit(0)), F.length(text))
        return F.concat(F.array_join(body, ""), tail)

    return F.when(F.size(spans) <= 0, text).otherwise(let(chunks(text), written))
