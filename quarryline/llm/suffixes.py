"""External induced sorting of a shard's suffixes with their common prefixes.

The text is induced in two sweeps over one queue a symbol, as in external SA-IS: a queue holds tuples (position, common
prefix with the tuple before) in order and is kept on disk once the shard passes MEMORY bytes; scanning a queue appends
the preceding suffixes to later queues. Common-prefix values travel along: that of two suffixes induced one after the
other into a queue is one more than the least value between their sources. The sorted seeds (leftmost S suffixes) come
from the recursion: their substrings are sorted by the same two sweeps and named, and the string of names, a third of
the text, is sorted in turn (here by doubling ranks, which stays a few array passes whatever the number of names).
Values are cut off at `most`, which is all that a search for strings of that length needs.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

MEMORY = 64 << 20


class Queues:
    """A first-in first-out queue of (position, value) for each symbol, in memory or in a folder."""

    def __init__(self, folder: str | None):
        self.folder = folder and Path(folder)
        self.held: dict[int, list[np.ndarray]] = {}
        self.read: dict[int, int] = {}

    def put(self, symbol: int, position: np.ndarray, value: np.ndarray) -> None:
        rows = np.empty((len(position), 2), np.int64)
        rows[:, 0], rows[:, 1] = position, value
        if self.folder:
            with (self.folder / str(symbol)).open("ab") as f:
                f.write(rows.tobytes())
        self.held.setdefault(symbol, []).append(rows if not self.folder else np.array([len(rows)]))

    def take(self, symbol: int) -> np.ndarray | None:
        """What was put for the symbol since the last call, else None."""
        new = self.held.pop(symbol, None)
        if not new:
            return None
        if not self.folder:
            return np.concatenate(new) if len(new) > 1 else new[0]
        n, at = sum(int(x[0]) for x in new), self.read.get(symbol, 0)
        self.read[symbol] = at + n
        with (self.folder / str(symbol)).open("rb") as f:
            f.seek(at * 16)
            return np.frombuffer(f.read(n * 16), np.int64).reshape(-1, 2)


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a:b]) for ranges with a < b, from a table of powers of two."""
    if not len(a):
        return a
    length = b - a
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(a), values.dtype)
    table, k = values, 0
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    while True:
        mine = order[cuts[k] : cuts[k + 1]]
        if len(mine):
            out[mine] = np.minimum(table[a[mine]], table[b[mine] - (1 << k)])
        if k + 2 >= len(cuts):
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


class _Sweep:
    """Pushes induced suffixes into queues and carries the common prefixes."""

    def __init__(self, text: np.ndarray, queues: Queues, most: int):
        self.text, self.queues, self.most = text, queues, most
        self.since = np.full(256, -1, np.int64)  # least value since a symbol's last push; -1: none yet

    def scan(self, position: np.ndarray, value: np.ndarray, pushes: np.ndarray) -> None:
        """Suffixes in order with the common prefix with the one scanned before; pushes: whether each induces."""
        at = np.flatnonzero(pushes)
        if not len(at):
            low = value.min()
            np.minimum(self.since, low, out=self.since, where=self.since >= 0)
            return
        symbols = self.text[position[at] - 1]
        order = np.argsort(symbols, kind="stable")
        symbols, at = symbols[order], at[order]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        got = np.empty(len(at), np.int64)
        rest = np.ones(len(at), bool)
        rest[first] = False
        rest = np.flatnonzero(rest)
        got[rest] = 1 + _least(value, at[rest - 1] + 1, at[rest] + 1)
        prefix = np.minimum.accumulate(value)
        before = self.since[symbols[first]]
        got[first] = np.where(before < 0, 0, 1 + np.minimum(before, prefix[at[first]]))
        np.minimum(got, self.most, out=got)
        np.minimum(self.since, prefix[-1], out=self.since, where=self.since >= 0)
        suffix = np.r_[np.minimum.accumulate(value[::-1])[::-1], self.most]
        last = np.r_[first[1:], len(at)] - 1
        self.since[symbols[last]] = suffix[at[last] + 1]
        for k, (a, b) in enumerate(zip(first, last + 1, strict=True)):
            self.queues.put(int(symbols[first[k]]), position[at[a:b]] - 1, got[a:b])


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S type); the last one is."""
    n = len(text)
    sign = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    where = np.where(sign != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1] if n > 1 else where
    out = np.ones(n, bool)
    inside = nearest < n
    out[:-1][inside] = sign[nearest[inside]] > 0
    return out


def _prefix(words: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of suffix pairs, up to `most`; words: the text's eight-byte windows."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    done = 0
    while len(live) and done < most:
        x, y = np.minimum(a[live] + done, len(words) - 1), np.minimum(b[live] + done, len(words) - 1)
        differ = words[x] ^ words[y]
        same = differ == 0
        low = differ[~same]
        bits = low & (~low + np.uint64(1))
        out[live[~same]] = done + (np.frexp(bits.astype(np.float64))[1] - 1) // 8
        live = live[same]
        done += 8
    out[live] = most
    return np.minimum(out, most)


def _induce(text, small, seeds, seed_value, words, most, folder, emit):
    """Both sweeps. emit(positions, values) gets each symbol's suffixes in rising order, the last symbol first."""
    symbols = np.flatnonzero(np.bincount(text, minlength=256))
    by_seed = np.searchsorted(text[seeds], np.arange(257)) if len(seeds) else np.zeros(257, np.int64)
    larger: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def dirs(name):
        if not folder:
            return None
        path = Path(folder) / name
        path.mkdir()
        return str(path)

    queues = Queues(dirs("l"))
    sweep = _Sweep(text, queues, most)
    for c in symbols.tolist():
        parts = []
        while (got := queues.take(c)) is not None:
            pos, val = got[:, 0], got[:, 1]
            sweep.scan(pos, val, (pos > 0) & ~small[pos - 1])
            parts.append(got)
        both = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        larger[c] = both
        mine = seeds[by_seed[c] : by_seed[c + 1]]
        if len(mine):
            val = seed_value[by_seed[c] : by_seed[c + 1]].copy()
            val[0] = _prefix(words, text, both[-1:, 0], mine[:1], most)[0] if len(both) else 0
            sweep.scan(mine, val, mine > 0)
    queues = Queues(dirs("s"))
    sweep = _Sweep(text, queues, most)
    for c in symbols[::-1].tolist():
        parts = []
        while (got := queues.take(c)) is not None:
            pos, val = got[:, 0], got[:, 1]
            sweep.scan(pos, val, (pos > 0) & small[pos - 1])
            parts.append(got)
        if c == symbols[0] and not parts:
            parts = [np.array([[len(text) - 1, 0]], np.int64)]  # the end of the text
        s = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        both = larger.pop(c)
        join = _prefix(words, text, both[-1:, 0], s[-1:, 0], most)[0] if len(both) and len(s) else 0
        if len(both):
            back = both[::-1, 0]
            val = np.r_[join, both[:0:-1, 1]]
            sweep.scan(back, val, (back > 0) & small[back - 1])
        if c == symbols[0] and not len(both):
            end = np.array([len(text) - 1])
            sweep.scan(end, np.zeros(1, np.int64), small[end - 1] & (end > 0))
        up = s[::-1, 0]
        val = np.r_[both[:, 1], np.r_[join, s[:0:-1, 1]] if len(s) else np.zeros(0, np.int64)]
        emit(np.r_[both[:, 0], up], val)


def _rank_suffixes(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names, by doubling."""
    n = len(names)
    rank = names.astype(np.int64)
    k = 1
    while True:
        follow = np.full(n, -1, np.int64)
        if k < n:
            follow[:-k] = rank[k:]
        key = rank * (n + 2) + follow + 1
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def sorted_suffixes(text: np.ndarray, most: int, emit, folder: str | None = None) -> None:
    """Call emit(positions, values) for the suffixes of each symbol in rising order, the last symbol first.

    text: symbols 1 to 255 and a single 0 at its end. values: common prefix with the suffix before, at most `most`, and
    0 for the first of a symbol.
    """
    n = len(text)
    small = _types(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    words = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        lms = np.array([n - 1])
    size = np.r_[np.diff(lms) + 1, 1]
    order: list[np.ndarray] = []
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    first = np.argsort(text[lms], kind="stable")

    def gather(pos, _):
        order.append(pos[is_lms[pos]])

    def sub(name):
        if not folder:
            return None
        path = Path(folder) / name
        path.mkdir()
        return str(path)

    _induce(text, small, lms[first], np.zeros(len(lms), np.int64), words, 1, sub("names"), gather)
    ranked = np.concatenate(order[::-1])
    place = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    place[lms] = np.arange(len(lms))
    by = place[ranked]
    longest = int(size.max())
    same = size[by[1:]] == size[by[:-1]]
    pairs = np.flatnonzero(same)
    equal = np.zeros(len(by), bool)
    limit = size[by[pairs]]
    got = _prefix(words, text, ranked[pairs], ranked[pairs + 1], longest)
    equal[pairs + 1] = got >= limit
    names = np.empty(len(lms), np.int64)
    names[by] = np.cumsum(~equal) - 1
    if names.max() < len(lms) - 1:
        seeds = lms[_rank_suffixes(names)]
    else:
        seeds = ranked
    value = np.r_[0, _prefix(words, text, seeds[:-1], seeds[1:], most)]
    value[np.flatnonzero(np.r_[True, text[seeds[1:]] != text[seeds[:-1]]])] = 0
    _induce(text, small, seeds, value, words, most, sub("all"), emit)


def repeated(parts: list[bytes], length: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each part a mask of the places where a string of `length` bytes starts that starts at another place too.

    Strings do not cross parts. Bytes 0xFE and 0xFF do not occur in UTF-8 and are taken as 0xFD.
    """
    sizes = np.array([len(p) for p in parts])
    joined = b"\0".join(parts) + b"\0"
    text = np.minimum(np.frombuffer(joined, np.uint8), 0xFD) + np.uint8(2)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    text = np.r_[text, np.uint8(0)]
    text[starts[1:] - 1] = 1
    room = np.repeat(starts[1:] - 1, sizes + 1) - np.arange(len(text) - 1)
    room = np.r_[room, 0]
    found = np.zeros(len(text), bool)

    def emit(pos, val):
        hit = np.flatnonzero(val >= length)
        if len(hit):
            found[pos[hit]] = True
            found[pos[hit - 1]] = True

    if len(text) > memory:
        with tempfile.TemporaryDirectory() as folder:  # this task's own scratch, gone when it ends
            sorted_suffixes(text, length, emit, folder)
    else:
        sorted_suffixes(text, length, emit)
    found &= room >= length
    return [found[a : a + n] for a, n in zip(starts[:-1].tolist(), sizes.tolist(), strict=True)]
