"""Personal data: fixed patterns, and names found by a linear-chain conditional random field over word shapes.

The field has the labels O, B, I and features of a word, its neighbours and its place in a line: shape, punctuation and
a short list of titles. It is trained by maximum likelihood (forward-backward, gradient steps) from a small labelled
table and decoded by Viterbi in numpy, all lines of a block at once. Whole texts are decoded; a line of any length is one
sequence.

Defined cases: a null text is empty and has no spans (redact keeps it null); repeated rows are scanned each; a text of any length is
scanned whole, in a block of its own; spans that start together come in the order of KINDS, and redact names an overlap after the
first; columns beside the id and the text are ignored by find and kept by redact, whatever their names; an empty table gives no rows.
Names that overlap a pattern's span are left out; pattern spans are never changed.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import documents, release, texts, typed

KINDS = ("email", "ip", "card", "phone", "name")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, and takes each run whole
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain; looks left from each @, so long runs of letters cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGITS.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


# --- the conditional random field ---------------------------------------------------------------------------------

#: Words that stand before a name, in the four languages of the corpus.
TITLES = "mr mrs ms miss dr prof sir madam dear name attn herr frau señor señora sr sra don doña monsieur madame mme m mlle nombre nom signed sincerely regards author patient".split()
TITLE_OF = {w: k + 1 for k, w in enumerate(TITLES)}
SHAPES = ["x", "Xx", "X", "XX", "xX", "0", "x0", "other"]
ENDS = ["", ".", ",", ":", "other"]
WIDTHS = (len(SHAPES), len(ENDS), len(TITLES) + 1)
EDGE = WIDTHS[0] * WIDTHS[1] * WIDTHS[2]
LABELS = 3  # O, B, I

#: The labelled table: names, and lines in which {} stands for one. Everything else in a line is O.
NAMES = (
    "John Smith|Maria Garcia|Anna Schmidt|Peter Brown|Jean Dupont|Lucía Fernández|Hans Müller|Claire Martin|David Jones|Sofia Rossi|"
    "Karl Weber|Emma Wilson|José Álvarez|Élodie Petit|Robert Taylor|Ingrid Bauer|Thomas Moreau|Laura Sánchez|Paul Walker|Nina Hoffmann|Mary Ann Lewis|O. Keller|J. R. Stone|Robinson|Keller|García|Dubois|Lehmann"
).split("|")
LINES = (
    "Please write to Mr. {} about the order.|Dr. {} will see you on Monday.|Name: {}|Dear Mrs. {},|Prof. {} gave the talk in Berlin.|It was signed by Ms. {} last week.|"
    "Nombre: {}|Herr {} kommt morgen.|Frau {} hat angerufen.|Madame {} est arrivée.|Señora {} vive en Madrid.|Patient: {}, seen today.|Author: {}|Attn: {}|Sincerely, {}|we met Mr. {} and Mrs. {} there"
).split("|")
PLAIN = (
    "The report of the meeting was sent on Monday.|In Paris the company announced results.|Dear customer, your order has left.|the name of the file is not known.|"
    "Ertion the in of and thane.|HE WAS NOT THERE.|La casa de la ciudad es grande.|Der Bericht ist fertig. Die Stadt schläft.|Le chat est sur la table. Il dort.|"
    "This is it. And The Other Thing Too.|See Table 4 for 12 items.|Dr. of the house|signed the paper at noon|de la que el en los|Unter den Linden steht ein Haus.|Name of the product and price|"
    "Es. Do the on. Tionti, An the Er.|M.|Mr. and Mrs.|the author of the book|regards the matter as closed|Anthe | ouring | Theand | item|Of. A ershha, then it|Os. Í. Y armente a la|La ouç. È. È. Ouonen anai|É. Ñ. Ö. Or is it|Y. A. The end|A man and A plan|On. E the. Í. Y so"
).split("|")


def labelled_table() -> list[tuple[list[str], list[int]]]:
    """(words, labels) per line."""
    rows = []
    for k, name in enumerate(NAMES):
        for j, line in enumerate(LINES):
            if (j + k) % 2 == 0:
                words, labels = [], []
                for part in line.split(" "):
                    if "{}" in part:
                        mine = part.replace("{}", NAMES[(k + len(words)) % len(NAMES)]).split(" ")
                        words += mine
                        labels += [1, *[2] * (len(mine) - 1)]
                    else:
                        words.append(part)
                        labels.append(0)
                rows.append((words, labels))
        rows += [(line.split(" "), [0] * len(line.split(" "))) for line in PLAIN]
    return rows


def word_class(word: str) -> int:
    """A word's features, packed: shape, last punctuation, title."""
    core = word.strip("\"'()[]{}<>.,:;!?*")
    tail = word[len(word.rstrip("\"'()[]{}<>.,:;!?*")) :]
    bare = core.replace("-", "").replace("'", "")
    if bare.isalpha():
        if len(bare) == 1:
            shape = 2 if bare.isupper() else 0
        elif bare.islower():
            shape = 0
        elif bare.istitle():
            shape = 1
        else:
            shape = 3 if bare.isupper() else 4
    else:
        shape = 5 if bare.isdigit() else 6 if bare.isalnum() else 7
    end = 0 if not tail else ENDS.index(tail) if tail in ENDS else 4
    return (shape * WIDTHS[1] + end) * WIDTHS[2] + TITLE_OF.get(core.lower(), 0)


def _parts(cls: int) -> tuple[int, ...]:
    """The features of a class as columns of the weights (two columns more: a line's edge, and any title, which titles that the
    table lacks share with the others)."""
    if cls == EDGE:
        return (sum(WIDTHS),)
    rest, title = divmod(cls, WIDTHS[2])
    shape, end = divmod(rest, WIDTHS[1])
    return (shape, WIDTHS[0] + end, WIDTHS[0] + WIDTHS[1] + title, *[sum(WIDTHS) + 1] * (title > 0))


class Field:
    """weights[place, feature, label] for the word itself, the one before and the one after; moves[label, label]."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        self.moves[0, 2] = -1e4  # I follows B or I
        self.scores = np.stack([[weights[place, list(_parts(c))].sum(axis=0) for c in range(EDGE + 1)] for place in range(3)]).astype(np.float32)

    def emissions(self, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores per word and label; own: classes of words, first: where lines begin."""
        before, after = np.roll(own, 1), np.roll(own, -1)
        before[first] = EDGE
        after[np.append(first[1:], len(own)) - 1] = EDGE
        out = self.scores[0][own] + self.scores[1][before] + self.scores[2][after]
        out[first, 2] -= 1e4
        return out

    def viterbi(self, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of all lines, a step for the words at each place of their line."""
        n = len(own)
        e = self.emissions(own, first)
        size = np.diff(np.append(first, n))
        order = np.argsort(-size, kind="stable")
        begin, size = first[order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size.max(initial=0)) + 1))
        back = np.zeros((n, LABELS), np.int8)
        score = e[begin].copy()
        moves = self.moves.astype(np.float32)
        for t in range(1, len(active)):
            k = int(active[t])
            at = begin[:k] + t
            paths = score[:k, :, None] + moves[None]
            best = paths.argmax(axis=1)
            back[at] = best
            score[:k] = np.take_along_axis(paths, best[:, None, :], axis=1)[:, 0, :] + e[at]
        labels = np.zeros(n, np.int8)
        now = score.argmax(axis=1)
        labels[begin + size - 1] = now
        for t in range(len(active) - 1, 0, -1):
            k = int(active[t])
            now[:k] = back[begin[:k] + t, labels[begin[:k] + t]]
            labels[begin[:k] + t - 1] = now[:k]
        return labels


@functools.cache
def train(epochs: int = 40, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood over labelled_table(): expected against observed features, adaptive gradient steps."""
    lines: dict[tuple, int] = {}
    for words, labels in labelled_table():
        key = (tuple(word_class(w) for w in words), tuple(labels))
        lines[key] = lines.get(key, 0) + 1
    weights, moves = np.zeros((3, sum(WIDTHS) + 2, LABELS)), np.zeros((LABELS, LABELS))
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    total = sum(lines.values())
    for _ in range(epochs):
        grad_w, grad_m = -decay * total * weights, -decay * total * moves
        for (classes, labels), times in lines.items():
            n = len(classes)
            around = [[_parts(c) for c in (classes[i], classes[i - 1] if i else EDGE, classes[i + 1] if i + 1 < n else EDGE)] for i in range(n)]
            e = np.array([sum(weights[place, list(f)].sum(axis=0) for place, f in enumerate(a)) for a in around])
            forward, backward = np.zeros((n, LABELS)), np.zeros((n, LABELS))
            forward[0] = e[0]
            for i in range(1, n):
                forward[i] = e[i] + np.logaddexp.reduce(forward[i - 1][:, None] + moves, axis=0)
            for i in range(n - 2, -1, -1):
                backward[i] = np.logaddexp.reduce(moves + (e[i + 1] + backward[i + 1])[None], axis=1)
            whole = np.logaddexp.reduce(forward[-1])
            wrong = -np.exp(forward + backward - whole)
            wrong[np.arange(n), labels] += 1
            for i in range(n):
                for place, f in enumerate(around[i]):
                    grad_w[place, list(f)] += times * wrong[i]
                if i:
                    grad_m -= times * np.exp(forward[i - 1][:, None] + moves + (e[i] + backward[i])[None] - whole)
                    grad_m[labels[i - 1], labels[i]] += times
        seen_w += grad_w**2
        seen_m += grad_m**2
        weights += rate * grad_w / np.sqrt(seen_w)
        moves += rate * grad_m / np.sqrt(seen_m)
    return Field(weights, moves)


REMEMBERED = 400_000
BLOCK_CHARS = 1_500_000
IS_SPACE = np.zeros(0x110000, bool)
IS_SPACE[[32, *range(9, 14)]] = True


class Names:
    """Finds names in blocks of texts; remembers the classes of distinct words between blocks."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.field, self.known = Field(weights, moves), {}

    def _classes(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for w in distinct:
            row = self.known.get(w)
            if row is None:
                word = w.decode()
                marks = "\"'()[]{}<>.,:;!?*"
                row = self.known[w] = (word_class(word), len(word) - len(word.lstrip(marks)), len(word) - len(word.rstrip(marks)))
            out.append(row)
        table = np.array(out, np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]

    def block(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = "\n".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return spans
        space = IS_SPACE[cp]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            return spans
        data = joined.encode()
        if len(data) == len(cp):
            at = np.arange(len(cp) + 1)
        else:
            width = np.ones(len(cp), np.uint8)
            for limit in (0x80, 0x800, 0x10000):
                width += cp >= limit
            at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        # each word with the white space after it, as Arrow wants values end to end; cut off again per distinct value
        bounds = np.append(at[start], len(data))
        array = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        codes = coded.indices.to_numpy()
        cls, lead, trail = self._classes([w.rstrip(b" \t\n\x0b\x0c\r") for w in coded.dictionary.to_pylist()])
        breaks = np.flatnonzero(cp == 10)
        first = np.unique(np.concatenate([[0], np.searchsorted(start, breaks)]))
        first = first[first < len(start)]
        labels = self.field.viterbi(cls[codes], first)
        begins = np.flatnonzero(labels == 1)
        if not len(begins):
            return spans
        inside = np.append(labels, 0) == 2
        sizes = np.cumsum([0] + [len(t) + 1 for t in texts])
        for k in begins.tolist():
            last = k
            while inside[last + 1]:
                last += 1
            s, e = int(start[k] + lead[codes[k]]), int(end[last] - trail[codes[last]])
            doc = int(np.searchsorted(sizes, s, side="right")) - 1
            if s < e:
                spans[doc].append((s - int(sizes[doc]), 4, e - int(sizes[doc])))
        return spans


def _found(names: Names, texts: list[str | None]):
    """(from, base spans per text, all spans per text), block by block."""
    begin, size = 0, 0
    for k in range(len(texts) + 1):
        if k == len(texts) or size and size + len(texts[k] or "") > BLOCK_CHARS:
            mine = [t or "" for t in texts[begin:k]]
            base = [patterns(t) for t in mine]
            both = [b + [x for x in n if not any(y[0] < x[2] and x[0] < y[2] for y in b)] if n else b for b, n in zip(base, names.block(mine), strict=True)]
            yield begin, base, [sorted(x) for x in both]
            begin, size = k, 0
        if k < len(texts):
            size += len(texts[k] or "")


def joined(spans) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def _model() -> tuple[np.ndarray, np.ndarray]:
    field = train()
    return field.weights, field.moves


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (an array of start, kind, end in code points): base spans and names."""
    weights, moves = _model()

    def run(batches):
        names = Names(weights, moves)
        for batch in batches:
            for a, _, spans in _found(names, batch.column("text").to_pylist()):
                rows = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x] for x in spans]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(spans)), pa.array(rows, kind)], ["doc_id", "spans"])

    plain = texts(docs, doc_id, text)
    return plain.mapInArrow(run, typed("doc_id bigint, spans array<struct<start:int,kind:string,end:int>>", plain))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    weights, moves = _model()
    names_of = docs.columns
    place = names_of.index(text)
    flat = docs.toDF(*[f"c{k}" for k in range(len(names_of))])
    schema = T.StructType([T.StructField(f.name, T.StringType() if k == place else f.dataType) for k, f in enumerate(flat.schema)])

    def masked(t: str, spans) -> str:
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [t[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def run(batches):
        names = Names(weights, moves)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = list(texts)
            for a, _, spans in _found(names, texts):
                for k, x in enumerate(spans):
                    if x:
                        new[a + k] = masked(texts[a + k], x)
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(new, pa.string()))
        del names
        release()

    return flat.mapInArrow(run, schema).toDF(*names_of)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, moves = _model()

    def run(batches):
        names = Names(weights, moves)
        for batch in batches:
            for a, base, spans in _found(names, batch.column("text").to_pylist()):
                counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(4)]
                sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(base)), *counts, sha, pa.array([joined(x) for x in spans], pa.string())], [c.split(" ")[0] for c in SCHEMA.split(", ")])

    plain = texts(documents(spark, sf_dir))
    return plain.mapInArrow(run, typed(SCHEMA, plain))
