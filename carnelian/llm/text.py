"""Array kernels over the Arrow buffers of a text column.

An Arrow batch keeps its texts as one byte buffer and offsets.  The kernels
here find the words of every text in a slice of that buffer, and hash words and
word n-grams, without a Python object per word.  A null text has no bytes, so
it behaves as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Bytes of a folded word: digits, a-z and everything beyond ASCII.
_FOLDED = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in LOWER], dtype=bool)
#: Bytes of a plain word: everything but space and the controls 9 to 13.
_PLAIN = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)], dtype=bool)

#: For bytes.translate: case folded, and a space for whatever is not in a word.
FOLD = bytes(LOWER[b] if _FOLDED[b] else 32 for b in range(256))


def _byte_values(folded: bool) -> np.ndarray:
    values = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(np.uint64) | np.uint64(1)
    return values[np.frombuffer(LOWER, dtype=np.uint8)] if folded else values


_VALUES = {True: _byte_values(True), False: _byte_values(False)}
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.ones(size, dtype=np.uint64)
            out[1:] = np.uint64(base)
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit values; different salts give unrelated values."""
    h = h ^ np.uint64((salt * _BASE) & _MASK)
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Slice(NamedTuple):
    """Rows [at, at + len(offsets) - 1) of a batch; buf holds their bytes and nothing else."""

    at: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:  # rows
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.buf[self.offsets[row] : self.offsets[row + 1]].tobytes()


class Words(NamedTuple):
    """Words of a slice: byte range, row, hash; first[r] is the first word of row r."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column (string or binary, nulls allowed) in slices of whole rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, index, data = column.buffers()
    offsets = np.frombuffer(index, dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(end, n)
        yield Slice(at, whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def words(part: Slice, folded: bool = True, hashed: bool = True) -> Words:
    """folded: ASCII case is folded and words are runs of digits, letters and
    bytes beyond ASCII; else words are runs of anything but white space."""
    buf, offsets = part.buf, part.offsets
    n = len(buf)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = (_FOLDED if folded else _PLAIN)[buf]
    edges = offsets[1:-1]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cut = edges[(edges > 0) & (edges < n)]
    begins[cut] = inside[cut + 1]
    stops[cut - 1] = inside[cut]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(part)), np.diff(first))
    if not hashed or not len(starts):
        return Words(starts, ends, rows, first, np.zeros(len(starts), dtype=np.uint64))
    up, down = powers(n)
    terms = _VALUES[folded][buf] * up[:n]
    sums = np.cumsum(terms)
    h = (sums[ends - 1] - sums[starts] + terms[starts]) * down[starts]
    return Words(starts, ends, rows, first, mix(h))


def prefixes(part: Slice, found: Words, sizes: range, folded: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first bytes of words that go on after them, and the rows they are in.

    A prefix of n bytes is told apart from a word of those bytes."""
    if not len(found.starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    up, down = powers(len(part.buf))
    terms = _VALUES[folded][part.buf] * up[: len(part.buf)]
    sums = np.cumsum(terms)
    before, lengths = sums[found.starts] - terms[found.starts], found.ends - found.starts
    hashes, rows = [], []
    for n in sizes:
        long = np.flatnonzero(lengths > n)
        starts = found.starts[long]
        hashes.append(mix((sums[starts + n - 1] - before[long]) * down[starts], n))
        rows.append(found.rows[long])
    return np.concatenate(hashes), np.concatenate(rows)


def hash_words(tokens: list[bytes], folded: bool = True) -> np.ndarray:
    """The hashes that words() gives these words."""
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    lengths = np.array([0, *map(len, tokens)], dtype=np.int64)
    part = Slice(0, np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths))
    found = words(part, folded)
    if len(found.hashes) != len(tokens):
        raise ValueError("a token is not one word")
    return found.hashes


def ngrams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the number of the first of them."""
    m = len(found.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(found.rows[:m] == found.rows[n - 1 :])
    up, _ = powers(n)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h += found.hashes[k : k + m] * up[k]
    return mix(h[at], n), at


def sequence_hashes(found: Words, salt: int) -> np.ndarray:
    """One hash of the word sequence of every row; 0 where there is no word."""
    counts = found.counts()
    out = np.zeros(len(counts), dtype=np.uint64)
    if len(found.hashes):
        up, _ = powers(int(counts.max()) + 1)
        place = np.arange(len(found.hashes)) - found.first[found.rows]
        terms = mix(found.hashes, salt) * up[place]
        full = np.flatnonzero(counts)
        out[full] = mix(np.add.reduceat(terms, found.first[full]) + counts[full].astype(np.uint64), salt + 1)
    return out


def row_sums(values: np.ndarray, at_rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Sums of values by row, for rows in any order."""
    return np.bincount(at_rows, weights=values, minlength=n_rows)


def member(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted set."""
    if not len(sorted_set) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


class HashSet:
    """A sorted set of 64-bit hashes behind a bit table that turns most others away."""

    def __init__(self, values: np.ndarray, bits: int = 20):
        self.values = np.unique(values)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.values >> self.shift).astype(np.int64)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        out = self.table[(values >> self.shift).astype(np.int64)]
        maybe = np.flatnonzero(out)
        out[maybe] = member(self.values, values[maybe])
        return out


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte:
    itself where Latin-1 prints it, else the next free one from U+0100."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printed)]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _grow(key: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The keys of strings that are longer by one character each."""
    key = (key ^ codes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def codes_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


class PieceTable:
    """The beginnings of all pieces by key, with the number of the piece where one ends."""

    def __init__(self, known: list[str]):
        self.n, self.longest = len(known), max(map(len, known), default=1)
        lengths = np.array([len(p) for p in known], dtype=np.int64)
        codes, first = codes_of(known), np.concatenate([[0], np.cumsum(lengths)])[:-1]
        key, alive = np.zeros(self.n, dtype=np.uint64), np.arange(self.n)
        keys, pieces = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for size in range(1, self.longest + 1):
            alive = alive[lengths[alive] >= size]
            key[alive] = _grow(key[alive], codes[first[alive] + size - 1])
            keys.append(key[alive])
            pieces.append(np.where(lengths[alive] == size, alive, -1))
        # of equal keys the piece, if there is one
        all_keys, all_pieces = np.concatenate(keys), np.concatenate(pieces)
        order = np.lexsort((-all_pieces, all_keys))
        new = np.concatenate([[True], all_keys[order][1:] != all_keys[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
        self.keys, self.pieces = all_keys[order][new], all_pieces[order][new]

    def matches(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, piece) of every piece in the codes; room: how many characters a place may use.

        A character that is no piece counts as the piece after the last."""
        begins, sizes, pieces = [], [], []
        alive = np.flatnonzero(room > 0)
        key = np.zeros(len(alive), dtype=np.uint64)
        for size in range(1, self.longest + 1):
            if size > 1:
                fits = room[alive] >= size
                alive, key = alive[fits], key[fits]
            if not len(alive):
                break
            key = _grow(key, codes[alive + size - 1])
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            known = self.keys[at] == key if len(self.keys) else np.zeros(len(at), dtype=bool)
            piece = np.where(known, self.pieces[at] if len(self.keys) else -1, -1)
            if size == 1:
                piece = np.where(piece < 0, self.n, piece)
            found = piece >= 0
            begins.append(alive[found])
            sizes.append(np.full(int(found.sum()), size))
            pieces.append(piece[found])
            alive, key = alive[known], key[known]
        if not begins:
            return (np.zeros(0, dtype=np.int64),) * 3
        return np.concatenate(begins), np.concatenate(sizes), np.concatenate(pieces)


def to_signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)
