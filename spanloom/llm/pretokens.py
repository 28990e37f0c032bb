"""Pre-tokens of whole texts, found with numpy over blocks of documents.

A block's texts are laid end to end as code points; a table gives each its class (letter, number, white space,
other) and the split patterns of the public tokenizers become comparisons of neighbouring classes. Arrow's
dictionary encoding then names the distinct pre-tokens, so that whatever is done with one is done once a block.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from tokenizers import pre_tokenizers

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points of a block; bounds a task's memory, whatever the partition's size. A longer text is a block alone.
BLOCK_CHARS = 2_000_000


@functools.cache
def unassigned() -> np.ndarray:
    """Code points that this Python's tables don't know; a library with newer ones may."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


@functools.cache
def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, chars):
                table[low + m.start() : low + m.end()] = kind
    # where the pattern module knows characters that Python's tables don't, its Unicode version may be ahead of the tokenizers'
    # library too, so that library is asked: does the character go with a letter, or with a digit?
    new = np.flatnonzero(unassigned() & (table != OTHER))
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for part in np.array_split(new, max(len(new) // 1000, 1)):
        starts = {s for _, (s, _) in split("".join(f"a{chr(c)}\n1{chr(c)}\n" for c in part))}
        for k, c in enumerate(part.tolist()):
            table[c] = LETTER if 6 * k + 1 not in starts else NUMBER if 6 * k + 4 not in starts else OTHER
    return table


@dataclass
class Block:
    """Pre-tokens of some documents: word i of the block is distinct[codes[i]]; document k has words first[k]:first[k + 1]."""

    distinct: list[bytes]
    codes: np.ndarray
    first: np.ndarray


def _contractions(cp: np.ndarray, start: np.ndarray, ends: np.ndarray) -> None:
    """Moves the starts after 's 't 're 've 'm 'll 'd where a pre-token begins with the apostrophe."""
    at = np.flatnonzero((cp == 39) & start)
    if not len(at):
        return
    padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
    room = ends[np.searchsorted(ends, at, side="right")] - at
    a, b = padded[at + 1], padded[at + 2]
    is_ = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    one = is_(a, "stmd") & (room >= 2)
    two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (room >= 3)
    for which, n in ((at[one], 2), (at[two], 3)):
        for k in range(1, n):
            start[which + k] = False
        after = which + n
        start[after[after < len(cp)]] = True


def _starts(cp: np.ndarray, segment: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Marks where pre-tokens start, and the class of each code point. segment: where texts start.

    spaced: a single U+0020 belongs to what follows, white space is kept and numbers run on; else white space is
    dropped by the caller and each number stands alone.
    """
    cls = classes()[cp]
    start = np.empty(len(cp), bool)
    start[:1] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start[segment] = True
    if spaced:
        follows = np.flatnonzero(start[1:] & (cls[:-1] == SPACE) & (cls[1:] != SPACE)) + 1
        inside = np.zeros(len(cp), bool)
        inside[segment] = True
        follows = follows[~inside[follows]]
        start[follows - 1] = True
        start[follows] = cp[follows - 1] != 32
    else:
        start |= cls == NUMBER
    _contractions(cp, start, np.append(segment[1:], len(cp)))
    return start, cls


def lowered(piece: str, library=None) -> str:
    """piece as the lower-casing vocabulary's normalizer has it, white space apart; library (of the tokenizers file) does it where
    Python's tables are too old."""
    if piece.isascii():
        return piece.lower()
    if library is not None and unassigned()[np.frombuffer(piece.encode("utf-32-le"), np.uint32)].any():
        return library.normalize_str(piece)
    return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()


def _block(texts: list[str], spaced: bool, special: tuple[str, ...], library=None) -> Block:
    pieces, owner, marked = [], [], []
    for k, t in enumerate(texts):
        if any(s in t for s in special):
            for piece in regex.split("(" + "|".join(map(regex.escape, special)) + ")", t):
                if piece:
                    marked += [len(pieces)] * (piece in special)
                    pieces.append(piece)
                    owner.append(k)
        elif t:
            pieces.append(t)
            owner.append(k)
    if not spaced:
        kept = set(marked)
        pieces = [p if k in kept else lowered(p, library) for k, p in enumerate(pieces)]
    if not pieces:
        return Block([], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    joined = "".join(pieces)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    segment = np.cumsum(sizes) - sizes
    start, cls = _starts(cp, segment, spaced)
    for k in marked:
        start[segment[k] : segment[k] + sizes[k]] = False
        start[segment[k]] = True
        cls[segment[k]] = OTHER
        if k + 1 < len(pieces):
            start[segment[k + 1]] = True
    words = np.flatnonzero(start)
    data = joined.encode()
    if len(data) == len(cp):
        bounds = np.append(words, len(cp))
    else:
        width = np.ones(len(cp), np.uint8)
        for limit in (0x80, 0x800, 0x10000):
            width += cp >= limit
        at = np.cumsum(width, dtype=np.int64)
        bounds = np.append(np.where(words > 0, at[words - 1], 0), len(data))
    array = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    document = np.asarray(owner, np.int64)[np.searchsorted(segment, words, side="right") - 1]
    if not spaced:
        full = cls[words] != SPACE
        array, document = array.filter(pa.array(full)), document[full]
    coded = array.dictionary_encode()
    return Block(coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(document, np.arange(len(texts) + 1)))


def blocks(texts: list[str | None], spaced: bool, special: tuple[str, ...], library=None) -> Iterator[tuple[int, int, Block]]:
    """(from, to, block) over the texts in order; a null text is empty. library: a normalizer, for pieces beyond Python's tables."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > BLOCK_CHARS:
            yield begin, k, _block([x or "" for x in texts[begin:k]], spaced, special, library)
            begin, size = k, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts), _block([x or "" for x in texts[begin:]], spaced, special, library)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive entries of first; 0 where there is nothing between."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
