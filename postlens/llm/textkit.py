"""Vectorised helpers over Arrow string columns, shared by the text operators.

Everything works on slices of a batch of about ``SLICE_BYTES`` of text, so the
working memory of a task follows the slice (or its longest document), never
the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_U = np.uint64

_BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry boolean table that is true for the given inclusive byte ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Letters, digits and every byte of a non-ASCII character.
WORD = byte_class((48, 57), (65, 90), (97, 122), (128, 255))
#: Everything but blank and the five control characters that count as white space.
NON_SPACE = ~byte_class((32, 32), (9, 13))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = (n + (1 << 18) - 1) >> 18 << 18  # no more than asked for: workers keep them
            for name, base in (("up", _MULT), ("down", _INV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; ``span_hash`` turns them into hashes of any span."""
    up, _ = _POWERS.get(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every window of ``width`` codes (none if there are fewer)."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _POWERS.get(len(sums))
    return mix((sums[width:] - sums[:n]) * down[:n])


@dataclass
class Slice:
    """Consecutive rows of a batch: UTF-8 bytes of all rows, and each row's offsets in them."""

    first: int
    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def raw(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (null counts as empty) into slices of about ``limit`` bytes, whole rows each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Slice(i, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a row: starts, ends, and each row's first run."""
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    finish = mask.copy()
    finish[:-1] &= ~mask[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    begin[full] = mask[full]
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    finish[last] = mask[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offs)


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and each row's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offs: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))


def words(s: Slice, table: np.ndarray = WORD, fold: bool = True) -> Words:
    """Words are maximal runs of ``table`` bytes; with ``fold``, A-Z hash as a-z."""
    start, end, offs = runs(table[s.buf], s.offs)
    codes = (_BYTE_CODE[_FOLD] if fold else _BYTE_CODE)[s.buf]
    return Words(start, end, span_hash(prefix_sums(codes), start, end), offs)


def lower(buf: np.ndarray) -> np.ndarray:
    return _FOLD.astype(np.uint8)[buf]


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE_CODE[buf])


def hash_words(text: str, table: np.ndarray = WORD, fold: bool = True) -> np.ndarray:
    """Word hashes of one text."""
    return words(next(slices(pa.array([text]))), table, fold).hash


def within(n_words: np.ndarray, width: int) -> np.ndarray:
    """For rows of so many words laid end to end: which word positions start a window of ``width`` words in their row."""
    total = int(n_words.sum())
    ends = np.repeat(np.cumsum(n_words), n_words)
    return np.arange(total) + width <= ends


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start .. start+length-1``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n) - n
    out[at[0]] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
