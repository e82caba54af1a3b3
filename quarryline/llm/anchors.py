"""Anchored contexts: which windows of a text are chosen by which anchor.

Both substring operators look for equal windows of a fixed number of units (words or bytes). Every window is assigned
to one anchor inside it, the k-gram of least hash, so equal windows have equal anchors; the run of consecutive windows
that one anchor occurrence is assigned is its context. Only anchors that occur more than once need a closer look.
All work is done by numpy on an Arrow batch's buffers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_R, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; what is kept for later is no longer than a piece of CUT bytes needs."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b & _MASK, np.uint64)]) for b in (base, inverse))
        if size <= 2 * CUT:
            _POWERS[base] = have
    return have


class Sums:
    """Prefix sums of a sequence, for hashes of any of its ranges."""

    def __init__(self, values: np.ndarray, base: int = _R):
        self.inverse = powers(base, len(values) + 1)[1]
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values + np.uint64(1)) * powers(base, len(values) + 1)[0][: len(values)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    if len(x) < w:
        return x[:0]
    size, m = 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size : w - size + len(x) - w + 1])


#: Places that 16 bits tell apart.
SPAN = 1 << 16


def contexts(grams: np.ndarray, block: np.ndarray, windows: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of every context.

    grams: the hash of the k-gram at each place; windows: whether a whole window starts there; w: k-grams in a window;
    block: the text a place belongs to. An anchor is the gram's hash without its low 16 bits, which hold the gram's
    place in a run of SPAN places; runs overlap by a window, so of equal grams the leftmost one wins in every window.
    Two equal windows of one text therefore never share a context.
    """
    none = np.zeros(0, np.int64)
    places, step = np.arange(SPAN, dtype=np.uint64), SPAN - w + 1
    low = np.concatenate([sliding_min(x & ~np.uint64(0xFFFF) | places[: len(x)], w) for x in (grams[a : a + SPAN] for a in range(0, max(1, len(grams) - w + 1), step))])
    at = np.flatnonzero(windows[: len(low)])
    if not len(at):
        return none.astype(np.uint64), none, none
    low = low[at]
    place = at // step * step + (low & np.uint64(0xFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (block[at[1:]] != block[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    return low[first] >> np.uint64(16), at[first], np.diff(np.r_[first, len(at)])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, null as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text that are worked on at a time; the arrays made of them take some hundred bytes for each.
CUT = 1 << 19


def cut(batch: pa.RecordBatch, column: str, most: int = CUT):
    """Slices of a batch with about `most` bytes of text each (one text at least)."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch[column])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word of the texts: runs of bytes other than ASCII white space."""
    solid = np.ones(256, bool)
    solid[[32, 9, 10, 11, 12, 13]] = False
    on = solid[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, on[:-1]] if len(on) else on
    start = np.flatnonzero(on & (~before | edge[:-1]))
    after = np.r_[on[1:], False] if len(on) else on
    end = np.flatnonzero(on & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
