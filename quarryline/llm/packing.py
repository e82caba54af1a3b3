"""Best-two-fit packing of tokenized documents into fixed-length sequences.

Documents become pieces of at most `limit` tokens. Fill greedily, then replace a bin's smallest piece by two unpacked
pieces that fit the enlarged gap more tightly. The plan is made on the histogram of piece lengths (at most `limit`
counts, whatever the input), bins of equal make-up being planned together; pieces then take the slots of their length
by their rank. Null text is empty; an empty document is one piece holding the end id alone; repeated rows are packed
each on its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LIMIT, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Parts whose ids one Python worker remembers; beyond it the memory starts afresh.
CACHE_PARTS = 600_000
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Text of these code points (white space, and printable ones up to U+024F) needs no normalisation but lower case.
_PLAIN = re.compile("[\t-\r -~\xa1-ɏ]*")
_NUMBER = "\xb2\xb3\xb9\xbc-\xbe"
_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{_NUMBER}]+|[\d{_NUMBER}]|(?:[^\s\w]|_)+")


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts, part by part: this vocabulary drops white space and never joins across the parts of its split.

    The ids of a part are found once and kept. A plain text is lower-cased and split here and only its parts go to the
    model; words with other characters, and those that might hold a special token, are encoded by the tokenizer as they
    stand. The result equals encoding the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, parts: list[str]) -> None:
        if self.known and len(self.known) + len(parts) > CACHE_PARTS:
            self._clear()
        tokenize, symbols, lists = self.model.tokenize, self.symbols, []
        for part in parts:
            lists.append([t.id for t in tokenize(part if part.isascii() else "".join(map(symbols.__getitem__, part.encode())))])
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
        n, new = len(self.known), len(parts)
        while n + new > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + new] = size
        self.start[n : n + new] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.known.update(zip(parts, range(n, n + new), strict=True))

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        out, run = [], []
        for word in _SPACES.split(text):
            if _PLAIN.fullmatch(word) and "<|" not in word:
                run.append(word)
                continue
            out += [self._plain(" ".join(run)), np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)]
            run = []
        return np.concatenate([*out, self._plain(" ".join(run))])

    def _plain(self, text: str) -> np.ndarray:
        parts = _TOKENS.findall(text.lower())
        if not parts:
            return np.zeros(0, np.uint32)
        known = self.known
        missing = [w for w in set(parts) if w not in known]
        if missing:
            before = len(known)
            self._learn(missing)
            if len(self.known) < before + len(missing):
                self._learn([w for w in set(parts) if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        tok = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(tok.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k in range(0, len(ids), limit):
                    part = ids[k : k + limit]
                    rows.append((doc.as_py(), k // limit, k, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Bins for `counts[length]` pieces: (lengths in the bin, number of such bins).

    Greedy best fit from the longest piece down; then best-two-fit: if swapping the bin's smallest piece for two
    unpacked ones leaves less gap, swap. Each step plans as many equal bins as the counts allow.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan: list[tuple[tuple[int, ...], int]] = []

    def largest(most: int, taken: dict[int, int], pool: list[int]) -> int | None:
        k = bisect_right(pool, most) - 1
        while k >= 0 and left[pool[k]] <= taken.get(pool[k], 0):
            k -= 1
        return pool[k] if k >= 0 else None

    while lengths:
        bin_, room, taken = [], limit, {}
        while (n := largest(room, taken, lengths)) is not None:
            bin_.append(n)
            taken[n] = taken.get(n, 0) + 1
            room -= n
        if room and len(bin_) > 1:
            small = bin_[-1]
            taken[small] -= 1
            gap, best = room + small, (room, None)
            lo, hi = 0, bisect_right(lengths, gap) - 1
            while lo <= hi:
                a, b = lengths[lo], lengths[hi]
                if a + b > gap:
                    hi -= 1
                    continue
                free = left[a] - taken.get(a, 0) >= (2 if a == b else 1) and left[b] - taken.get(b, 0) >= 1
                if free and gap - a - b < best[0]:
                    best = (gap - a - b, (b, a))
                    if best[0] == 0:
                        break
                lo += 1
            if best[1]:
                bin_[-1:] = best[1]
                for n in best[1]:
                    taken[n] = taken.get(n, 0) + 1
            else:
                taken[small] += 1
        times = min(left[n] // c for n, c in taken.items() if c)
        plan.append((tuple(bin_), times))
        for n, c in taken.items():
            if c:
                left[n] -= c * times
                if not left[n]:
                    del left[n]
                    lengths.pop(bisect_left(lengths, n))
    return plan


def pack(parts: DataFrame, limit: int = LIMIT, salts: int = 64) -> DataFrame:
    """parts plus (sequence_id, offset). Ranks within a length are taken within `salts` sub-groups, so a length that a
    third of all pieces share is not sorted in one task."""
    spark = parts.sparkSession
    parts = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts: dict[int, list[int]] = {}
    for r in parts.groupBy("length", "_salt").count().collect():  # at most limit * salts rows, whatever the input
        counts.setdefault(r["length"], [0] * salts)[r["_salt"]] = r["count"]
    plan = plan_bins({n: sum(c) for n, c in counts.items()}, limit)
    slots: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}  # by length: first rank, first sequence, copies in a bin, first offset
    given = dict.fromkeys(counts, 0)
    sequence = 0
    for bin_, times in plan:
        offset, at = 0, 0
        while at < len(bin_):
            n, c = bin_[at], 1
            while at + c < len(bin_) and bin_[at + c] == n:
                c += 1
            slots[n].append((given[n], sequence, c, offset))
            given[n] += c * times
            offset, at = offset + n * c, at + c
        sequence += times
    bases = {n: np.cumsum([0, *c[:-1]]) for n, c in counts.items()}
    arrays = {n: np.array(s, np.int64) for n, s in slots.items()}
    shared = spark.sparkContext.broadcast((bases, arrays))  # bounded by limit * salts and the number of bin kinds

    def place(batches):
        bases, arrays = shared.value
        for batch in batches:
            n, salt, rank = (batch[c].to_numpy() for c in ("length", "_salt", "_rank"))
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n):
                mine = n == length
                r = rank[mine] - 1 + bases[length][salt[mine]]
                slot = arrays[length][np.searchsorted(arrays[length][:, 0], r, "right") - 1]
                k = r - slot[:, 0]
                seq[mine], off[mine] = slot[:, 1] + k // slot[:, 2], slot[:, 3] + (k % slot[:, 2]) * length
            keep = [x for x in batch.schema.names if x not in ("_salt", "_rank")]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    ranked = parts.withColumn("_rank", F.expr("row_number() over (partition by length, _salt order by doc_id, piece, start)").cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name != "_salt")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    return pack(written(pieces(docs, tokenizer_path, limit, end_id)), limit)
