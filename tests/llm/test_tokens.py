"""Token counts, the automaton and packing against the tokenizers library."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanloom.llm import bpe, packing, pretokens, token_counts

PIECES = ["a", "b", "'", "s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "23", "!", "...", "é", "É", "İ", "ΣΣ", "中", "🙂", " ", "\x1c", "\x85", "ß", "<|endoftext|>", "<|startoftext|>", "<|", "½", "_", "A", "LL", "x" * 40, "\x00", " The"]
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def texts():
    random.seed(7)
    made = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 30))) for _ in range(400)]
    return [*made, "u" * 61, "ab" * 3000, "", None]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, t, "clash", k) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n_tokens string, _row long")


def test_counts(frame):
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    rows = token_counts.token_counts(frame, public_tokenizers.path(WORDS)).collect()
    assert len(rows) == len(texts()) + 1
    for r in rows:
        t = texts()[r.doc_id] or ""
        assert r.n_tokens == len(library.encode(t, add_special_tokens=False).ids) and r.n_bytes == len(t.encode())


def test_automaton(frame):
    library, automaton = Tokenizer.from_file(public_tokenizers.path(BYTES)), bpe.compile_merges(public_tokenizers.path(BYTES))
    for r in bpe.round_trip(frame, public_tokenizers.path(BYTES)).collect():
        t = texts()[r.doc_id] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t, automaton) == ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(frame):
    path = public_tokenizers.path(BYTES)
    for r in bpe.decoded(bpe.encoded(frame.limit(50), path), path).collect():
        assert r.text == (texts()[r.doc_id] or "")


def test_arcs_accept_one_tokenization():
    automaton = bpe.compile_merges(public_tokenizers.path(BYTES))
    the, t, he = (automaton.id_of[x] for x in (b"the", b"t", b"he"))
    assert automaton.step(t, he) == bpe.NONE and automaton.step(bpe.START, the) == the and automaton.encode_word(b"the") == (the,)


def test_pieces(frame):
    library = Tokenizer.from_file(public_tokenizers.path(BYTES))
    rows = packing.pack(frame.dropDuplicates(["doc_id"]), public_tokenizers.path(BYTES)).collect()
    sequences, docs = {}, {}
    for r in rows:
        ids = library.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids + [1]
        piece = ids[r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, len(ids)))
    assert len(docs) == len(texts())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    for pieces in docs.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]


def test_fill_is_closest():
    random.seed(3)
    for _ in range(200):
        counts = {random.randint(1, 40): random.randint(1, 3) for _ in range(random.randint(0, 6))}
        target = random.randint(0, 120)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.fill(dict(counts), target)
        assert all(n <= counts[x] for x, n in used.items())
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= target)


def test_windows_cover_everything():
    for seed in range(30):
        random.seed(seed)
        lengths = [random.choice([1, random.randint(1, 300), random.randint(1, 7000), 2048, 777]) for _ in range(random.choice([0, 1, 2, 50, 300]))]
        seen = {}
        for row in packing.windows(lengths):
            total = sum(x[2] for x in row)
            assert total == 2048 or total < 2048 and total & (total - 1) == 0
            for k, start, length in row:
                seen.setdefault(k, []).append((start, length))
        for k, n in enumerate(lengths):
            at = 0
            for start, length in sorted(seen[k]):
                assert start == at
                at += length
            assert at == n


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, public_tokenizers.path(WORDS)).count() == 0
    assert packing.pack(none, public_tokenizers.path(BYTES)).count() == 0
    assert bpe.round_trip(none, public_tokenizers.path(BYTES)).count() == 0


def test_block_of_nothing():
    assert list(pretokens.blocks([], True, ())) == []
    (_, _, block), *_ = pretokens.blocks(["", None], True, ())
    assert block.distinct == [] and block.first.tolist() == [0, 0, 0]


def test_every_code_point():
    """A text for each code point that Python's tables don't know, and for a share of the others, counts as the library counts it."""
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    counter = token_counts.PieceCounter(public_tokenizers.path(WORDS), token_counts.WORD_SPECIAL)
    odd = [c for c in range(0x110000) if pretokens.unassigned()[c]]
    points = [*odd[::97], 0xA7CB, 0xA7DC, 0x105D2, *[c for c in range(0, 0x110000, 41) if not 0xD800 <= c < 0xE000]]
    values = [f"a{chr(c)}B {chr(c)}{chr(c)} x" for c in points]
    expected = [len(e.ids) for e in library.encode_batch(values, add_special_tokens=False)]
    found = []
    for _, _, block in pretokens.blocks(values, spaced=False, special=token_counts.WORD_SPECIAL, library=counter.normalizer):
        found += pretokens.sums(counter.counts(block.distinct)[block.codes], block.first).tolist()
    assert [hex(c) for c, a, b in zip(points, found, expected, strict=True) if a != b] == []
    byte, automaton, ids = Tokenizer.from_file(public_tokenizers.path(BYTES)), bpe.compile_merges(public_tokenizers.path(BYTES)), packing.Ids(public_tokenizers.path(BYTES))
    expected = [e.ids for e in byte.encode_batch(values, add_special_tokens=False)]
    (_, _, block), *_ = pretokens.blocks(values, spaced=True, special=())
    packed = [x.tolist()[:-1] for x in ids.of_block(block, 1)]
    run = [[i for c in block.codes[a:b] for i in automaton.encode_word(block.distinct[c])] for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
    assert packed == expected and run == expected


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_ids(spark, kind):
    """Ids of other types come back as they are."""
    rows = [(5 if kind == "int" else "five", "some words here", "x"), (None, None, "y")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, _row string")
    path = public_tokenizers.path(BYTES)
    for out in (token_counts.token_counts(df, public_tokenizers.path(WORDS)), bpe.round_trip(df, path), bpe.encoded(df, path), packing.pack(df, path)):
        assert {r.doc_id for r in out.collect()} == {rows[0][0], None} and out.schema["doc_id"].dataType == df.schema["doc_id"].dataType


def test_entry_queries(spark, small):
    """op4, op6 and op9 over the whole small table against the library."""
    words, byte = Tokenizer.from_file(public_tokenizers.path(WORDS)), Tokenizer.from_file(public_tokenizers.path(BYTES))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in token_counts.op4_token_counts(spark, small).collect():
        n = len(words.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)
    for r in bpe.op9_bpe_automaton(spark, small).collect():
        ids = byte.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    pieces = packing.op6_packing(spark, small).collect()
    for r in pieces:
        ids = byte.encode(docs[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length]))
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values()) and {r.doc_id for r in pieces} == set(docs)
