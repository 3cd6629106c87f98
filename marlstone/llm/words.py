"""Vectorised words and word shingles of UTF-8 text.

A word is a maximal run of ASCII digits, letters (A-Z count as a-z) and non-ASCII characters,
the pattern [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ on text with A-Z lower-cased. In UTF-8 every
byte of a non-ASCII character is above 0x7F, so the pattern can be matched on bytes. Texts are
taken in pieces of about a quarter megabyte, cut between words, so that working memory beyond the
words themselves does not grow with a text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_STEP = 0x9E3779B97F4A7C15 | 1  # odd, so that its powers have inverses modulo 2**64


def _fold() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[lo : hi + 1] = np.arange(lo, hi + 1)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


FOLD = _fold()  # byte to lower-cased word byte, 0 between words
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        up = np.full(n, _STEP, np.uint64)
        down = np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and where each begins (one more than texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0 or pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:  # a null may cover bytes
        size = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if size.sum() != at[-1] - at[0]:
            return utf8(column.fill_null(""))
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def groups(at: np.ndarray, limit: int = PIECE) -> list[tuple[int, int]]:
    """Ranges of consecutive texts with about limit bytes each."""
    out, lo = [], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of every word of the texts, and where each text's words begin."""
    hashes, firsts, ends = [], [], []
    lo, n, base = int(at[0]), int(at[-1]), int(at[0])
    up, down = _powers(min(max(n - lo, 1), PIECE) + 1)
    while lo < n:
        hi = min(n, lo + PIECE)
        if hi < n:  # back to a byte between words, or on to one
            tail = np.flatnonzero(FOLD[data[max(lo, hi - 4096) : hi]] == 0)
            if len(tail):
                hi = max(lo, hi - 4096) + int(tail[-1]) + 1
            else:
                hi = next((x + int(np.argmax(FOLD[data[x : x + 65536]] == 0)) + 1 for x in range(hi, n, 65536) if (FOLD[data[x : x + 65536]] == 0).any()), n)
                up, down = _powers(hi - lo + 1)
        t = FOLD[data[lo:hi]]
        word = t != 0
        new = word.copy()
        new[1:] &= ~word[:-1]
        cuts = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
        cuts = cuts[(cuts >= 0) & (cuts < hi - lo)]
        new[cuts] = word[cuts]
        last = word.copy()
        last[:-1] &= ~word[1:] | new[1:]
        s, e = np.flatnonzero(new), np.flatnonzero(last) + 1
        h = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(t.astype(np.uint64) * up[: hi - lo], out=h[1:])
        hashes.append(mix((h[e] - h[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        firsts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(ends), np.searchsorted(first, at)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive words, at the run's first word (len(h) - size + 1 of them)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x100000001B3) + h[j : j + n]
    return mix(out + np.uint64(size))


def plain(data: np.ndarray, s: int, e: int) -> bytes:
    """The lower-cased bytes of one word."""
    return FOLD[data[s:e]].tobytes()


def forget() -> None:
    """Drop the tables kept for speed, so that they don't travel with functions sent to executors."""
    _POWERS.clear()
