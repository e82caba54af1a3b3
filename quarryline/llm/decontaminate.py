"""Benchmark decontamination by spaced seeds.

Words are runs of word characters, lower-cased. A seed is a fixed mask over consecutive words; its hash takes only the
words at the mask's ones, so a changed word elsewhere does not matter. Hashes of benchmark items and of documents are
joined; around each hit the document is laid over the item on that diagonal. A run of at least `min_words` words (or all
of a shorter item) of which at least `identity` match is an overlap; that is the run that scores best (a match +1, a
substitution -2) where it is one, or else the one with most matches. A document with an overlap is contaminated.

At the default settings every overlap holds a seed: MASKS hit any 13 words with two substitutions, 15 with three, 20 with
four and 25 with five, and every longer overlap has such a part. Items of 5 to 12 words have the masks in SHORT, which hit
the item with the one or two substitutions that it may have; shorter items have a dense mask of their own length.
The benchmark's hashes are broadcast up to BROADCAST_WORDS benchmark words; beyond that both sides' hashes are joined by
shuffle. Null texts have no words; repeated rows are judged each; extra columns are ignored; empty tables are fine.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MASKS = ("1111011", "1011111", "1110100011", "11000011011")
SHORT = {
    5: ("1111", "10111", "11011", "11101"),
    6: ("1111", "11011"),
    7: ("11111", "110111", "111011"),
    8: ("111111", "1101111", "1111011"),
    9: ("1111111", "11011111", "11110111", "11111011"),
    10: ("110111", "11001011", "11111"),
    11: ("1110111", "110100111", "1111101", "111111"),
    12: ("11010111", "111001101", "111111"),
}
MIN_WORDS, IDENTITY, MISMATCH = 13, 0.8, -2
BROADCAST_WORDS = 2_000_000
_WORD = re.compile(r"\w+")
_OUT = "doc_id long, contaminated boolean, item_id long, matched long, overlap_start long, overlap_words long"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the masked words at every start where the mask fits; ids are 64-bit word hashes."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[at : at + n]
    return _mix(out)


def word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in words], np.uint64)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> tuple[int, int, int]:
    """(matched, start in the document, words) of an overlap with doc[shift + i] laid over item[i]; (0, 0, 0) if there is none."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    least = min(min_words, len(item))
    if hi - lo < least:
        return 0, 0, 0
    hit = doc[lo + shift : hi + shift] == item[lo:hi]
    total = np.r_[0, np.cumsum(np.where(hit, 1, MISMATCH))]
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(total[: end + 1].argmin()) if end else 0
    matched = int(hit[start:end].sum())
    if end - start >= least and matched >= identity * (end - start):
        return matched, lo + shift + start, end - start
    count = np.r_[0, np.cumsum(hit)]
    over = count - identity * np.arange(len(count))  # a run reaches the identity if this does not fall over it
    starts = np.searchsorted(-np.minimum.accumulate(over), -over - 1e-9)  # for each end the first start of such a run
    gain = np.where(np.arange(len(count)) - starts >= least, count - count[starts], 0)
    end = int(gain.argmax())
    start = int(starts[end])
    return (int(gain[end]), lo + shift + start, end - start) if gain[end] else (0, 0, 0)


def short_masks(n: int) -> tuple[str, ...]:
    """Masks of an item of n words, fewer than `min_words`."""
    return SHORT.get(n, ("1" * n,))


class Seeds:
    """The benchmark's words, seeds and positions as sorted arrays."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, identity: float = IDENTITY):
        self.min_words, self.identity = min_words, identity
        self.vocab: dict[str, int] = {}
        self.items = []
        for item, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
            if words := words_of(text):
                self.items.append((item, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64)))
        sizes = {len(w) for _, w in self.items}
        of = {mask: {n for n in sizes if n >= min_words} for mask in masks}
        for n in sorted(n for n in sizes if n < min_words):
            for mask in short_masks(n):
                of.setdefault(mask, set()).add(n)
        self.masks = list(of)
        self.index = []
        for mask in self.masks:
            rows = [(seed_hashes(w, mask), k) for k, (_, w) in enumerate(self.items) if len(w) in of[mask]]
            h = np.concatenate([r for r, _ in rows]) if rows else np.zeros(0, np.uint64)
            owner = np.concatenate([np.full(len(r), k, np.int64) for r, k in rows]) if rows else np.zeros(0, np.int64)
            at = np.concatenate([np.arange(len(r)) for r, _ in rows]) if rows else np.zeros(0, np.int64)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            self.index.append((h[order], owner[order], at[order], seen))

    def best(self, text: str | None) -> tuple[int, int, int, int] | None:
        """(item, matched, start, words) of the text's largest overlap, the smallest item first among equals."""
        get = self.vocab.get
        words = words_of(text)
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        found: set[tuple[int, int]] = set()
        for mask, (h, owner, at, seen) in zip(self.masks, self.index, strict=True):
            mine = seed_hashes(ids, mask)
            for p in np.flatnonzero(seen[mine >> np.uint64(44)]).tolist():
                lo, hi = np.searchsorted(h, mine[p], "left"), np.searchsorted(h, mine[p], "right")
                found.update((int(owner[k]), p - int(at[k])) for k in range(lo, hi))
        return best_of(found, ids, self.items, self.min_words, self.identity)


def best_of(found, ids, items, min_words, identity):
    best = None
    for k, shift in found:
        item, words = items[k]
        matched, start, n = overlap(ids, words, shift, min_words, identity)
        if n:
            key = (-matched, item, start, n)
            best = key if best is None else min(best, key)
    return best and (best[1], -best[0], best[2], best[3])


def _rows(docs, results):
    cols = [[r is not None for r in results], *[[r and r[k] for r in results] for k in range(4)]]
    return pa.RecordBatch.from_arrays([docs.cast(pa.int64()), pa.array(cols[0], pa.bool_()), *(pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in cols[1:])], names=["doc_id", "contaminated", "item_id", "matched", "overlap_start", "overlap_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, identity: float = IDENTITY, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, contaminated, item_id, matched, overlap_start, overlap_words) of every document."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    if size[0] / 4 + size[1] > broadcast_words:
        return _by_shuffle(docs, items, masks, min_words, identity)
    shared = docs.sparkSession.sparkContext.broadcast(Seeds([tuple(r) for r in items.collect()], masks, min_words, identity))

    def run(batches):
        for batch in batches:
            yield _rows(batch["doc_id"], [shared.value.best(t.as_py()) for t in batch["text"]])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated documents; with a benchmark that may be broadcast, judged where the text is."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    if size[0] / 4 + size[1] > BROADCAST_WORDS:
        bad = decontaminate(docs, benchmark, **options).where("contaminated").select("doc_id").distinct()
        return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(Seeds([tuple(r) for r in items.collect()], **options))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([shared.value.best(t.as_py()) is None for t in batch["text"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _by_shuffle(docs: DataFrame, items: DataFrame, masks, min_words, identity) -> DataFrame:
    """The same for a benchmark of any size: hashes are joined by shuffle; short items by their own masks."""

    def emit(own):
        def run(batches):
            for batch in batches:
                out = []
                for k, t in zip(batch["id"], batch["text"], strict=True):
                    ids = word_hashes(words_of(t.as_py()))
                    for mask in own(len(ids)):
                        h = seed_hashes(ids, mask)
                        out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k.as_py(), np.int64)), pa.array(h.view(np.int64)), pa.array(np.arange(len(h)))], names=["id", "h", "at"]))
                yield from out

        return run

    rid = F.monotonically_increasing_id()
    docs = written(docs.select(rid.alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    items = written(items.select(rid.alias("id"), "item_id", "text"))
    short = [r[0] for r in items.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit("(?U)\\w+"), 0)).alias("n")).where(f"n between 1 and {min_words - 1}").distinct().collect()]  # under `min_words` values
    every = list(dict.fromkeys([*masks, *(m for n in sorted(short) for m in short_masks(n))]))
    left = docs.select("id", "text").mapInArrow(emit(lambda n: every), "id long, h long, at long")
    right = items.select("id", "text").mapInArrow(emit(lambda n: short_masks(n) if n < min_words else masks), "id long, h long, at long")
    hits = left.select(F.col("id").alias("d"), "h", F.col("at").alias("p")).join(right.select(F.col("id").alias("k"), "h", "at"), "h").select("d", "k", (F.col("p") - F.col("at")).alias("shift")).distinct()

    def check(batches):
        for batch in batches:
            rows = []
            for d, item, shift, text, other in zip(*(batch[c].to_pylist() for c in ("d", "item_id", "shift", "text", "other")), strict=True):
                if r := best_of([(0, shift)], word_hashes(words_of(text)), [(item, word_hashes(words_of(other)))], min_words, identity):
                    rows.append((d, *r))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "item_id", "matched", "overlap_start", "overlap_words"])

    full = hits.join(docs.select(F.col("id").alias("d"), "text"), "d").join(items.select(F.col("id").alias("k"), "item_id", F.col("text").alias("other")), "k")
    good = full.select("d", "item_id", "shift", "text", "other").mapInArrow(check, "id long, item_id long, matched long, overlap_start long, overlap_words long")
    best = good.groupBy("id").agg(F.min(F.struct((-F.col("matched")).alias("m"), "item_id", "overlap_start", "overlap_words", "matched")).alias("b"))
    return docs.join(best, "id", "left").select("doc_id", F.col("b").isNotNull().alias("contaminated"), *[F.col(f"b.{c}") for c in ("item_id", "matched", "overlap_start", "overlap_words")])
