"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on each text. Expectation-maximisation estimates the share
of good texts and, for either class, how often each labeller says what (its accuracies) from the patterns of votes of the whole
corpus (a row per pattern, at most 3 ** len(LABELLERS), reaches the driver); no human label is read. The posteriors of SAMPLE
documents, those with the least hashes, then train a linear scorer over hashed word features, which scores every text.

Parameters that bound the fit: SAMPLE documents (equal rows count once), the HEAVIEST features of each, 2 ** BITS features in
all. Votes are counted over all documents, and the sample is drawn in the same pass.

Defined cases: a null or empty text has no words, so only the first labeller votes, and its score is the bias; texts of fewer
than eight words are judged by no labeller and their posterior is the share of good texts; an empty table gives no rows;
repeated rows are scored each (ids play no part but to tell rows of the sample apart); null ids are kept; a text of any length
is read whole; columns beside the id and the text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, documents, texts, typed

#: Documents whose posteriors train the scorer, and the features of each that take part.
SAMPLE, HEAVIEST = 3000, 2048
BITS = 16
REMEMBERED = 400_000
BLOCK_CHARS = 2_000_000

#: Frequent short words of English, French, German and Spanish.
FREQUENT = frozenset(
    "the of and to in is that it for on with as was are be this at by not or from "
    "le la les de des du et un une en que qui dans pour sur par au avec "
    "der die das und den von zu mit ist ein eine im dem nicht auch "
    "el los las y del que se una por con para su al lo como".split()
)
LABELLERS = ("no words", "symbols", "upper case", "exclamations", "sentences", "frequent words", "lines", "repeated words")
#: Where the labellers' rates of bad, nothing and good start for bad and for good texts, the share of good texts, and how much
#: all that counts against the votes (as a share of all documents).
START, PRIOR, STRENGTH = ((0.3, 0.6, 0.1), (0.02, 0.68, 0.3)), 0.8, 0.01
#: Texts of fewer words can't be judged.
FEW = 8
SYMBOLS = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-Z]+")
SENTENCE = re.compile(r"[.!?](?=\s|$)")


def votes(text: str | None) -> tuple[int, ...]:
    """One vote per labeller."""
    t = text or ""
    words = t.split()
    n = len(words)
    if n < FEW:
        return (0 if n else -1, *[0] * (len(LABELLERS) - 1))
    above = lambda x, bad: -1 if x > bad else 0
    again = sum(a == b for a, b in zip(words, words[1:])) / n  # noqa: B905
    ends = len(SENTENCE.findall(t)) / n
    common = sum(w in FREQUENT for w in t.lower().split()) / n
    lines = [x for x in t.split("\n") if x.strip()]
    stutters = again > 0.2  # then words and sentences say nothing
    return (
        0,
        above(len(SYMBOLS.findall(t)) / n, 0.1),
        above(sum(map(len, UPPER.findall(t))) / sum(map(len, words)), 0.3),
        above(t.count("!") / n, 0.2),
        0 if stutters else 1 if 0.03 <= ends <= 0.35 else -1 if ends < 0.01 or ends > 0.6 else 0,
        0 if stutters else 1 if common >= 0.1 else -1 if common < 0.02 else 0,
        above(1 - len(set(lines)) / len(lines), 0.3),
        -1 if stutters else 1 if again < 0.05 else 0,
    )


def coded(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**k for k, x in enumerate(v))


def _votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


class LabelModel:
    """prior of good, and rates[class, labeller, vote + 1]: how often a labeller casts a vote on bad (0) and good (1) texts."""

    def __init__(self, prior: float, rates: np.ndarray) -> None:
        self.prior, self.rates = prior, rates

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of good per pattern; where nobody votes, the prior."""
        cast = _cast(patterns)
        odds = np.einsum("pkv,kv->p", cast, np.log(self.rates[1] / self.rates[0])) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracy(self) -> np.ndarray:
        """Per labeller how often a vote is right."""
        right = self.prior * self.rates[1][:, 2] + (1 - self.prior) * self.rates[0][:, 0]
        wrong = self.prior * self.rates[1][:, 0] + (1 - self.prior) * self.rates[0][:, 2]
        return right / (right + wrong)


def _cast(patterns: np.ndarray) -> np.ndarray:
    found = _votes_of(patterns)
    return (found[:, :, None] == np.array([-1, 0, 1])) * (found != 0).any(axis=1)[:, None, None].astype(float)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> LabelModel:
    """Expectation-maximisation: posteriors from the prior and the rates, and those again from the posteriors."""
    start = np.repeat(np.array(START)[:, None, :], len(LABELLERS), axis=1)
    model = LabelModel(PRIOR, start)
    if not counts.sum():
        return model
    cast, extra = _cast(patterns), STRENGTH * counts.sum()
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * counts, good * counts])
        rates = np.einsum("cp,pkv->ckv", weight, cast) + start * extra
        new = LabelModel((weight[1].sum() + PRIOR * extra) / (counts.sum() + extra), rates / rates.sum(axis=2, keepdims=True))
        done = np.abs(new.rates - model.rates).max() < 1e-7
        model = new
        if done:
            break
    return model


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The feature of a word that repeats the one before.
AGAIN = xxhash.xxh32_intdigest(b"again") & ((1 << BITS) - 1)


def features(word: bytes) -> tuple[int, ...]:
    """The hashed features of a word: itself, its shape, its last characters."""
    text = word.decode("utf-8", "replace")
    shape = "".join(dict.fromkeys("X" if c.isupper() else "x" if c.islower() else "0" if c.isdigit() else c for c in text[:64]))
    mask = (1 << BITS) - 1
    return tuple(xxhash.xxh32_intdigest(f) & mask for f in (b"w" + word.lower(), ("s" + shape).encode(), b"e" + word[-3:]))


def _words(values: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, codes, and where each text's words begin."""
    data = "\n".join(values).encode()
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    bounds = np.append(start, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    encoded = array.dictionary_encode()
    size = np.cumsum([0] + [len(v.encode()) + 1 for v in values])
    place: dict[bytes, int] = {}  # a word has different entries by the white space after it
    known = [place.setdefault(w.rstrip(b" \t\n\x0b\x0c\r"), len(place)) for w in encoded.dictionary.to_pylist()]
    return list(place), np.array(known, np.int64)[encoded.indices.to_numpy()], np.searchsorted(start, size)


def _blocks(values: list[str]):
    begin, size = 0, 0
    for k, v in enumerate(values):
        if size and size + len(v) > BLOCK_CHARS:
            yield begin, k
            begin, size = k, 0
        size += len(v)
    if begin < len(values):
        yield begin, len(values)


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features: the means over its words, and the share of words that repeat the one before."""
    distinct, codes, _ = _words([text])
    n = np.bincount(codes, minlength=len(distinct))
    flat = np.array([features(w) for w in distinct], np.int64).reshape(-1, 3)
    sums = np.bincount(flat.ravel(), weights=np.repeat(n, 3), minlength=1 << BITS)
    sums[AGAIN] += (codes[1:] == codes[:-1]).sum()
    places = np.flatnonzero(sums)
    if len(places) > HEAVIEST:
        places = np.sort(places[np.argsort(-sums[places], kind="stable")[:HEAVIEST]])
    return places.astype(np.int32), (sums[places] / max(len(codes), 1)).astype(np.float32)


def survey(docs: DataFrame, sample: int) -> DataFrame:
    """One pass over docs (doc_id, text): per task a row of each pattern with its number of rows n, and rows with n = 0 that hold
    the hash h, the pattern and the features of candidates for the sample.

    Candidates are rows whose hash is low enough for twice the sample to be expected (all rows of a small table); equal rows have
    equal hashes and count once in a task.
    """
    total = docs.count()
    share = min(1.0, 2 * (sample + 50) / max(total, 1))
    limit = int(share * 2**64) - 2**63
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))

    def run(batches):
        seen: dict[int, int] = {}
        taken: set[int] = set()
        names = ["pattern", "n", "h", "at", "value"]

        def table(rows):
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True):
                pattern = coded(votes(t))
                seen[pattern] = seen.get(pattern, 0) + 1
                if h < limit and h not in taken and len(taken) < sample:  # more of one task than the whole sample are never needed
                    taken.add(h)
                    rows.append((pattern, 0, h, *text_features(t)))
            if rows:
                yield table(rows)
        if seen:
            yield table([(p, n, None, None, None) for p, n in seen.items()])

    return hashed.mapInArrow(run, "pattern int, n bigint, h bigint, at array<int>, value array<float>")


def fit(rows: list, target: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors (soft labels), adaptive gradient steps over all rows."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return weights, bias
    at = np.concatenate([np.asarray(r["at"], np.int64) for r in rows])
    value = np.concatenate([np.asarray(r["value"], np.float64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    seen, seen_bias = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(epochs):
        score = np.bincount(row, weights=value * weights[at], minlength=len(rows)) + bias
        wrong = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - target) / len(rows)
        step = np.bincount(at, weights=value * wrong[row], minlength=1 << BITS) + decay * weights
        seen += step**2
        seen_bias += wrong.sum() ** 2
        weights -= rate * step / np.sqrt(seen)
        bias -= rate * wrong.sum() / np.sqrt(seen_bias)
    return weights, bias


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray, float]:
    """The label model from all of docs (doc_id, text), and the scorer from the posteriors of a sample."""
    found = checkpoint(survey(docs, sample))
    counted = found.where("n > 0").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    model = estimate(np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], float))
    rows = found.where("n = 0").dropDuplicates(["h"]).orderBy("h").limit(sample).collect()  # bounded by sample and HEAVIEST
    weights, bias = fit(rows, model.posterior(np.array([r["pattern"] for r in rows], np.int64).reshape(-1)))
    return model, weights, bias


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score, the probability of good, of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2 ** BITS numbers

    def run(batches):
        w, known = shared.value, {}
        for batch in batches:
            values = batch.column("text").to_pylist()
            for a, b in _blocks(values):
                distinct, codes, first = _words(values[a:b])
                if len(known) > REMEMBERED:
                    known.clear()
                own = np.empty(len(distinct))
                for k, word in enumerate(distinct):
                    x = known.get(word)
                    if x is None:
                        x = known[word] = float(w[list(features(word))].sum())
                    own[k] = x
                again = np.zeros(len(codes), bool)
                again[1:] = codes[1:] == codes[:-1]
                again[first[:-1][first[:-1] < len(codes)]] = False
                total = np.concatenate([[0], np.cumsum(own[codes] + float(w[AGAIN]) * again)])
                n = np.diff(first)
                mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.round(1 / (1 + np.exp(-(mean + bias))), 6))], ["doc_id", "score"])

    return docs.mapInArrow(run, typed("doc_id bigint, score double", docs))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and kept of each row, by a classifier trained on docs themselves."""
    plain = texts(docs, doc_id, text)
    _, weights, bias = train(plain, sample)
    return score(plain, weights, bias).withColumn("kept", F.col("score") >= 0.5)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))
