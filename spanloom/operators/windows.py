"""Model input: windows of texts, each distinct one once, and spans of a model brought back to the documents.

Defined cases: a null or empty text has no windows; equal windows are run once; labels that stand for no category and entities outside their window
are dropped; a word that is too long is an error, never cut; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import MARK, SWAP, find_spans
from spanloom.sources.tables import table

MOST_WORDS, STRIDE = 128, 96
WINDOW = "doc_id bigint, start_cp int, text string"
ENTITY = "start int, end int, label string, score double, text string"
#: The label groups that a model is asked for, and the categories that labels stand for.
FAMILIES = (
    (("person", "PERSON"), ("full_name", "PERSON")),
    (("organization", "ORG"),),
    (("email", "EMAIL"), ("phone_number", "PHONE"), ("address", "ADDRESS")),
    (("passport_number", "IDENTITY"), ("national_id_number", "IDENTITY"), ("tax_id", "TAX")),
    (("bank_account", "BANK"), ("iban", "BANK"), ("routing_number", "BANK")),
)
LABELS = {label: category for family in FAMILIES for label, category in family}
#: Tokens of a model's input at most.
MOST_TOKENS = 512
#: Legal forms whose periods cost a model words: they are read as spaces, at the same offsets.
DOTTED = r"(?i)(?<![\p{L}\p{N}.])(?:P\.)?L\.L\.C(?:\.|(?![\p{L}\p{N}]))"


def model_text(text: Column) -> Column:
    """A text as a model reads it: of the same length, the periods of dotted legal forms as spaces."""
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, SWAP), f"({DOTTED})", f"{MARK}$1{MARK}"), MARK)
    return F.array_join(F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.translate(p, ".", " ")).otherwise(p)), "")


def whole_forms(spans: Column, text: Column) -> Column:
    """Spans (start, end) that begin or end inside a dotted legal form take all of it, but for its last period."""
    forms = F.transform(find_spans(text, DOTTED), lambda f: F.struct(f["start"].alias("start"), (f["end"] - f["text"].endswith(".").cast("int")).alias("end")))
    lead = lambda s: F.get(F.filter(forms, lambda f: (f["start"] < s["start"]) & (s["start"] < f["end"])), F.lit(0))["start"]
    tail = lambda s: F.get(F.filter(forms, lambda f: (f["start"] < s["end"]) & (s["end"] < f["end"])), F.lit(0))["end"]
    return F.transform(spans, lambda s: F.struct(F.coalesce(lead(s), s["start"]).cast("int").alias("start"), F.coalesce(tail(s), s["end"]).cast("int").alias("end")))


class WordTooLong(ValueError):
    """One word alone is beyond a model's input; nothing is cut or left unread in silence."""


def bounded_windows(text: str, count: Callable[[str], int], most: int = MOST_TOKENS) -> list[tuple[int, str]]:
    """plan_windows(text), with windows of more than most tokens halved at words, a quarter of a half shared, until all fit."""
    import re

    pending, out, fits = plan_windows(text)[::-1], [], {}
    while pending:
        start, part = pending.pop()
        if part not in fits:
            fits[part] = count(part)
        if fits[part] <= most:
            out.append((start, part))
            continue
        words = [m.span() for m in re.finditer(r"\w+|[^\w\s]", part)]
        if len(words) < 2:
            raise WordTooLong(f"at {start}: one word has {fits[part]} tokens")
        size = -(-len(words) // 2)
        step = size - min(size // 4, size - 1)
        cuts = [(words[k][0], words[min(k + size, len(words)) - 1][1]) for k in range(0, max(len(words) - size + step, 1), step)]
        pending += [(start + a, part[a:b]) for a, b in dict.fromkeys(cuts)][::-1]
    return sorted(out)


def plan_windows(text: str | None, most: int = MOST_WORDS, stride: int = STRIDE) -> list[tuple[int, str]]:
    """(start, text) of a text's windows: whole paragraphs packed up to so many words, a heading opens one and stays with the paragraph
    after it; a longer paragraph packs its lines the same way, and a line that is too long gets overlapping windows."""
    t = text or ""
    blocks = paragraphs(t)
    if not any(len(t[s:e].split()) > most for s, e, _ in blocks):
        return _packed(t, blocks, most)
    out, small = [], []
    for s, e, head in blocks:
        if len(t[s:e].split()) <= most:
            small.append((s, e, head))
            continue
        # a heading waits for its paragraph, so it goes with the long one's first lines
        lead = [small.pop()] if small and small[-1][2] else []
        out += _packed(t, small, most)
        small = []
        begin = lead[0][0] if lead else s
        out += [(begin + a, x) for a, x in plan_lines(t[begin:e], most, stride)]
    return out + _packed(t, small, most)


def paragraphs(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is a heading) of a text's blocks: runs of lines between blank ones, each heading by itself."""
    out, at, open_ = [], 0, None
    for line in text.split("\n"):
        bare = line.strip()
        head = bare.startswith("#") and bare.lstrip("#")[:1] in ("", " ", "\t") and len(bare) - len(bare.lstrip("#")) <= 6
        if (not bare or head) and open_ is not None:
            out.append((open_, at - 1, False))
            open_ = None
        if head:
            out.append((at, at + len(line), True))
        elif bare and open_ is None:
            open_ = at
        at += len(line) + 1
    return out + ([(open_, at - 1, False)] if open_ is not None else [])


def _packed(text: str, blocks: list[tuple[int, int, bool]], most: int) -> list[tuple[int, str]]:
    """Blocks one after the other in windows of so many words; a heading begins a window."""
    out, begin, end, size = [], 0, 0, 0
    for s, e, head in blocks:
        n = len(text[s:e].split())
        if size and (head or size + n > most):
            out.append((begin, text[begin:end]))
            size = 0
        begin, end, size = (begin if size else s), e, size + n
    return [*out, (begin, text[begin:end])] if size else out


def plan_lines(text: str | None, most: int = MOST_WORDS, stride: int = STRIDE) -> list[tuple[int, str]]:
    """(start, text) of whole lines packed up to so many words; a heading opens a window, a line that is too long gets overlapping ones."""
    out: list[tuple[int, str]] = []
    at, start, size, end = 0, 0, 0, 0
    for line in (text or "").split("\n"):
        words = line.split()
        if words:
            if size and (size + len(words) > most or line.startswith("#")):
                out.append((start, (text or "")[start:end]))
                size = 0
            if len(words) > most:
                places, k = [], 0
                for w in words:
                    k = line.index(w, k)
                    places.append((k, k + len(w)))
                    k += len(w)
                for s in range(0, max(len(words) - (most - stride), 1), stride):
                    a, b = places[s][0], places[min(s + most, len(words)) - 1][1]
                    out.append((at + a, line[a:b]))
            else:
                start = start if size else at
                size += len(words)
                end = at + len(line)
        at += len(line) + 1
        if words and len(words) > most:
            size = 0
    if size:
        out.append((start, (text or "")[start:end]))
    return out


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, start_cp, text of every window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(k, s, t) for k, text in zip(frame["doc_id"], frame["text"], strict=True) for s, t in plan_windows(text)], columns=["doc_id", "start_cp", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, WINDOW)


def run_model(found: DataFrame, model: Callable[[pd.Series], list[list[tuple]]]) -> DataFrame:
    """Entities (doc_id, start_cp, end_cp, category, score, value) of windows; model takes a batch of texts and gives per text
    (start, end, label, score). Each distinct text is run once; its places come from a join with the windows, so a window that
    a third of all documents share costs one run. Labels that stand for no category, and entities outside the text, are dropped."""
    distinct = found.select("text").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, entities in zip(frame["text"], model(frame["text"]), strict=True):
                rows += [(text, s, e, LABELS[label], float(score), text[s:e]) for s, e, label, score in entities if label in LABELS and 0 <= s < e <= len(text)]
            yield pd.DataFrame(rows, columns=["text", "s", "e", "category", "score", "value"])

    entities = distinct.mapInPandas(run, "text string, s int, e int, category string, score double, value string")
    placed = found.join(entities, "text")
    return placed.select("doc_id", (F.col("start_cp") + F.col("s")).alias("start_cp"), (F.col("start_cp") + F.col("e")).alias("end_cp"), "category", "score", "value").distinct()


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows per document, and the words in them."""
    return windows(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n_words"))


def stub_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model, which finds words of 16 letters or more: entities of all documents."""
    import re

    long_words = re.compile(r"[^\W\d_]{16,}")

    def model(texts: pd.Series) -> list[list[tuple]]:
        return [[(m.start(), m.end(), "person", 0.5) for m in long_words.finditer(t)] for t in texts]

    return run_model(windows(table(spark, sf_dir, "documents")), model)


STUB_SQL = r"""
SELECT doc_id, (e - length(piece))::INTEGER AS start_cp, e::INTEGER AS end_cp, 'PERSON' AS category, 0.5::DOUBLE AS score, piece AS value FROM (
  SELECT doc_id, piece, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([\p{L}]{16,})', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)) AS p FROM documents))) WHERE i % 2 = 0
"""

def legal_form_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with dotted legal forms, as a model reads them, and spans that a model cut inside them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Cy"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, " P.L.L.C. of").otherwise(" L.L.C and N.L.L.C. of")).alias("t"))
    cut = F.array(F.struct(F.lit(0).alias("start"), (F.locate("L.C", F.col("t")) - 2).alias("end")))
    return c.select("c_custkey", model_text(F.col("t")).alias("text"), F.get(whole_forms(cut, F.col("t")), F.lit(0))["end"].alias("end"))


LEGAL_FORM_SQL = """
SELECT c_custkey, 'Cy' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' P L L C  of' ELSE ' L L C and N.L.L.C. of' END AS text, (length('Cy' || c_custkey) + CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 6 END)::INTEGER AS end FROM customer
"""


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations assembled as texts, cut into paragraphs at blank lines again, a heading apart: digest of each block, and where it lies."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.functions import pandas_udf

    turns = table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.trim(F.regexp_replace(x["text"], r"\s*\n\s*", "\n"))), "\n \n")
    docs = turns.groupBy("conv_id").agg(F.concat(F.lit("# Conv\n"), joined).alias("text"))

    @pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("block", T.StringType())])))
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [{"start": s, "block": t[s:e]} for s, e, _ in paragraphs(t)])

    return docs.select("conv_id", F.inline(cut("text"))).select("conv_id", F.col("start").alias("start_cp"), F.md5("block").alias("block_md5"))


PARAGRAPH_BLOCKS_SQL = r"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s*\n\s*', chr(10), 'g')) AS x FROM conversations WHERE trim(text) <> ''), k AS (SELECT conv_id, x, sum(length(x) + 3) OVER (PARTITION BY conv_id ORDER BY turn, x) - length(x) - 3 AS pos FROM t)
SELECT conv_id, 0 AS start_cp, md5('# Conv') AS block_md5 FROM k GROUP BY 1 UNION ALL SELECT conv_id, (pos + 7)::INTEGER, md5(x) FROM k
"""

QUERIES = [("legal_form_input", legal_form_input, LEGAL_FORM_SQL), ("paragraph_blocks", paragraph_blocks, PARAGRAPH_BLOCKS_SQL), ("window_counts", window_counts, None), ("stub_entities", stub_entities, STUB_SQL)]
