"""Whole-batch text work in numpy, on the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15) | U(1)

#: Bytes up to the blank separate raw words.
BLANK = np.arange(256) <= 32
#: Plain words: ASCII letters and digits and all non-ASCII bytes; upper case becomes lower (ASCII and Latin-1).
_ALNUM = np.array([(48 <= b <= 57) or (97 <= b <= 122) or (65 <= b <= 90) or b >= 128 for b in range(256)])
NOT_WORD = ~_ALNUM
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch with about `most` bytes of text each (one row at least) and at most `rows` rows, with their bytes and row offsets.

    A null text counts as empty.
    """
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if not len(arr):
        return
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        to = min(to, at + rows, len(arr))
        yield batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in UTF-8 to lower case, byte by byte."""
    out = _LOWER[data]
    if len(out) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[up] += 32
    return out


def spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the row offsets in words; a word never crosses rows."""
    word = ~sep[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_POWERS = np.cumprod(np.full(4096, _BASE, dtype=U))


def powers(n: int) -> np.ndarray:
    return _POWERS[:n] if n <= len(_POWERS) else np.cumprod(np.full(n, _BASE, dtype=U))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    cum = np.cumsum(lens) - lens
    total = int(cum[-1] + lens[-1])
    pos = np.arange(total, dtype=np.int64) - np.repeat(cum, lens)
    value = BYTE[data[pos + np.repeat(starts, lens)]]
    value *= powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(value, cum))


def hash_word(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0])


def ngrams(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they lie in one row. Both as long as h."""
    size = len(h)
    out = np.zeros(size, U)
    ok = np.zeros(size, bool)
    if size >= n:
        p = powers(n)
        acc = np.zeros(size - n + 1, U)
        for j in range(n):
            acc += h[j : size - n + 1 + j] * p[j]
        out[: size - n + 1] = mix(acc)
        left = np.repeat(rows[1:], np.diff(rows)) - np.arange(size)
        ok[: size - n + 1] = left[: size - n + 1] >= n
    return out, ok


def rows_of(rows: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's plain words in lower case with one blank between them; bytes and row offsets."""
    low = lower(data)
    starts, ends, rows = spans(low, off, NOT_WORD)
    lens = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    out_lens = lens + 1
    cum = np.cumsum(out_lens) - out_lens
    out = np.full(int(cum[-1] + out_lens[-1]), 32, np.uint8)
    inside = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(inside, lens)
    out[pos + np.repeat(cum, lens)] = low[pos + np.repeat(starts, lens)]
    ends_at = np.append(cum, len(out))
    return out, ends_at[rows]


def plain_text(text: str) -> str:
    """plain() of one text, as a str with one character a byte."""
    b = np.frombuffer(text.encode(), np.uint8)
    return plain(b, np.array([0, len(b)]))[0].tobytes().decode("latin-1").rstrip(" ")
