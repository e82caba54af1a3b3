"""Suffix-array deduplication of byte strings.

Each byte covered by a 400-byte string that also starts anywhere else is removed. Every such window is assigned the
least-hashed 128-gram inside it (anchors.py), so equal windows meet under one anchor. Contexts (an anchor's run of
windows) that are equal as a whole collapse to one; the distinct contexts of an anchor that has several go to a shard,
and each shard's suffixes are sorted with their common prefixes by external induced sorting (suffixes.py), which finds
the windows that are repeated. Shards hold whole anchors and close at SHARD bytes. An anchor with more distinct contexts
than that is hot: its windows are dealt anew by a longer string around its gram (the gram with half of the rest of the
window after it, or else before it), equal pieces collapse again, and only these smaller groups are sorted.

Texts are UTF-8; null is empty; rows that share a doc_id count as different documents unless they are equal in text
too, when they are repeats of each other like any other copies; a null doc_id is an id like others; extra columns are
ignored; an empty table gives no rows. A long text is scanned in pieces of CUT bytes that overlap by a window; only the
cutting of bodies and the last step hold it whole, a few times its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _Q, _R, CUT, Sums, buffers, contexts, cut
from .common import drop, release, two_hashes, written
from .suffixes import repeated

LENGTH, GRAM, SHARD = 400, 128, 1 << 19
KEYS = ["anchor", "c1", "c2"]
_KEY = "anchor long, c1 long, c2 long"


def _gram(length: int) -> int:
    return min(GRAM, max(1, length // 4))


def occurrences(docs: DataFrame, length: int = LENGTH, most: int = CUT) -> DataFrame:
    """(anchor, c1, c2, u1, u2, first, count): the contexts of every document; c1, c2 hash the whole context."""
    k = _gram(length)

    def run(batches):
        for batch in batches:
            for part in cut(batch, "text", most):
                every, every_offsets = buffers(part["text"])
                alone = part.num_rows == 1
                for base in range(0, max(1, len(every) - length + 1), most) if alone else (0,):
                    data, offsets = every, every_offsets
                    if alone:
                        data = every[base : base + most + length - 1]
                        offsets = np.array([0, len(data)])
                    block = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                    one, two = Sums(data, _R), Sums(data, _Q)
                    at = np.arange(max(0, len(data) - k + 1))
                    whole = np.zeros(len(at), bool)
                    if len(data) >= length:
                        whole[: len(data) - length + 1] = block[length - 1 :] == block[: len(data) - length + 1]
                    anchor, first, count = contexts(one.of(at, at + k), block, whole, length - k + 1)
                    end, mine = first + count + length - 1, block[first] if len(first) else first
                    of = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(one.of(first, end).view(np.int64)), pa.array(two.of(first, end).view(np.int64)), part["u1"].take(of), part["u2"].take(of), pa.array(first - offsets[mine] + base), pa.array(count.astype(np.int32))], names=[*KEYS, "u1", "u2", "first", "count"])

    return docs.select("u1", "u2", "text").mapInArrow(run, f"{_KEY}, u1 long, u2 long, first long, count int")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


_LONG, _MANY = pa.int64(), pa.list_(pa.int64())


def _slices(length: int):
    """The bodies of the wanted contexts."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = buffers(batch["text"].slice(k, 1))[0].tobytes()
                rows = [(x["anchor"], x["c1"], x["c2"], x["hot"], raw[x["first"] : x["first"] + x["count"] + length - 1]) for x in batch["wanted"][k].as_py()]
                yield _batch(rows, [*KEYS, "hot", "body"], [_LONG, _LONG, _LONG, pa.bool_(), pa.binary()])

    return run


def finer(body: np.ndarray, anchor: int, length: int) -> list[tuple[int, int, int]]:
    """(key, first window, number of windows) of the parts of a context: runs of windows with the same longer string.

    A window that holds the anchor's gram once, with half of the window's other bytes after it, goes by the gram and
    that half; one with more of them before it by that half and the gram; one that holds the gram several times by the
    anchor alone. That depends on the window's bytes only, so equal windows still get equal keys.
    """
    k = _gram(length)
    half = (length - k) // 2
    sums = Sums(body, _R)
    at = np.arange(len(body) - k + 1)
    grams = np.flatnonzero((sums.of(at, at + k) >> np.uint64(16)).astype(np.int64) == anchor)
    window = np.arange(len(body) - length + 1)
    lo, hi = np.searchsorted(grams, window), np.searchsorted(grams, window + length - k, "right")
    once = hi - lo == 1
    place = np.where(once, grams[np.minimum(lo, len(grams) - 1)], -1)
    after = once & (place + k + half <= window + length)
    before = once & ~after
    key = np.full(len(window), np.uint64(anchor), np.uint64)
    key[after] = sums.of(place[after], place[after] + k + half)
    key[before] = ~sums.of(place[before] - half, place[before] + k)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return list(zip((key[edge] >> np.uint64(1)).astype(np.int64).tolist(), edge.tolist(), np.diff(np.r_[edge, len(window)]).tolist(), strict=True))


def _finer(length: int):
    """The parts of hot contexts: (anchor, c1, c2, p_anchor, p_c1, p_c2, lo, count, body)."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for cells in zip(*(batch[c] for c in (*KEYS, "body")), strict=True):
                *of, raw = (x.as_py() for x in cells)
                data = np.frombuffer(raw, np.uint8)
                one, two = Sums(data, _R), Sums(data, _Q)
                for key, lo, n in finer(data, of[0], length):
                    a, b = np.array([lo]), np.array([lo + n + length - 1])
                    rows.append((key, int(one.of(a, b).view(np.int64)[0]), int(two.of(a, b).view(np.int64)[0]), *of, lo, n, raw[lo : lo + n + length - 1]))
            yield _batch(rows, [*KEYS, "p_anchor", "p_c1", "p_c2", "lo", "count", "body"], [_LONG] * 6 + [_LONG, pa.int32(), pa.binary()])

    return run


def _sorted_shards(length: int, most: int):
    """Rows sorted by anchor: sort shards of whole anchors; give each context the starts that are repeated."""

    def work(rows):
        masks = repeated([r[3] for r in rows], length)
        out = []
        for (anchor, c1, c2, _), mask in zip(rows, masks, strict=True):
            if mask.any():
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                out.append((anchor, c1, c2, edge[0::2].tolist(), edge[1::2].tolist()))
        return _batch(out, [*KEYS, "from", "to"], [_LONG, _LONG, _LONG, _MANY, _MANY])

    def run(batches):
        rows, size, last, seen = [], 0, None, set()
        for batch in batches:
            for cells in zip(*(batch[c] for c in (*KEYS, "body")), strict=True):
                row = tuple(x.as_py() for x in cells)
                if row[0] != last:
                    seen.clear()
                    if size >= most:
                        yield work(rows)
                        rows, size = [], 0
                last = row[0]
                if row[1:3] in seen:  # rows equal in doc_id and text bring the same context again
                    continue
                seen.add(row[1:3])
                rows.append(row)
                size += len(row[3])
        if rows:
            yield work(rows)

    return run


def _shards(bodies: DataFrame, length: int, shard: int) -> DataFrame:
    """(anchor, c1, c2, spans): the repeated windows of contexts, by sorting the shards of their bodies."""
    got = bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_shards(length, shard), f"{_KEY}, from array<long>, to array<long>")
    return got.select(*KEYS, F.arrays_zip(F.col("from").alias("lo"), F.col("to").alias("hi")).alias("spans"))


def _whole(n) -> F.Column:
    """One span over all n windows of a context."""
    return F.array(F.struct(F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi")))


def _moved(spans: str, by: str) -> F.Column:
    return F.transform(spans, lambda x: F.struct((x["lo"] + F.col(by)).alias("lo"), (x["hi"] + F.col(by)).alias("hi")))


def _hot(bodies: DataFrame, length: int, shard: int) -> DataFrame:
    """(anchor, c1, c2, spans) of the contexts of hot anchors, which are dealt anew in parts."""
    parents = ["p_anchor", "p_c1", "p_c2"]
    parts = written(bodies.dropDuplicates(KEYS).mapInArrow(_finer(length), f"{_KEY}, p_anchor long, p_c1 long, p_c2 long, lo long, count int, body binary"))
    one = written(parts.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first("count").alias("count"), F.first("body").alias("body")))
    several = one.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    partly = _shards(one.where("n = 1").select(*KEYS, "body").unionAll(one.where("n > 1").select(*KEYS, "body")).join(several, "anchor"), length, shard)
    wholly = one.where("n > 1").select(*KEYS, _whole(F.col("count")).alias("spans"))
    found = partly.join(wholly.select(*KEYS), KEYS, "left_anti").unionByName(wholly)
    out = written(parts.select(*KEYS, *parents, "lo").join(found, KEYS).select(*[F.col(p).alias(k) for p, k in zip(parents, KEYS, strict=True)], _moved("spans", "lo").alias("spans")))
    drop(parts)
    drop(one)
    return out


def _cut_out(length: int):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                data, _ = buffers(batch["text"].slice(k, 1))
                raw, digest, at, lost, runs = memoryview(data), hashlib.sha256(), 0, 0, 0
                if batch["spans"][k].is_valid:
                    spans = batch["spans"][k].values
                    lo, hi = spans.field("lo").to_numpy(), spans.field("hi").to_numpy() + length - 1
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    fresh = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                    ends = hi[np.r_[fresh[1:] - 1, len(hi) - 1]]
                    runs, lost = len(fresh), int((ends - lo[fresh]).sum())
                    for a, b in zip(lo[fresh].tolist(), ends.tolist(), strict=True):
                        digest.update(raw[at:a])
                        at = b
                digest.update(raw[at:])
                out.append((batch["doc_id"][k].as_py(), len(data), lost, runs, digest.hexdigest()))
            yield _batch(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [_LONG, _LONG, _LONG, _LONG, pa.string()])

    return run


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    u1, u2 = two_hashes("doc_id", F.coalesce("text", F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", u1.alias("u1"), u2.alias("u2"))
    occ = written(occurrences(docs, length))
    # Rows equal in doc_id and text have one (u1, u2); each still counts. All first() values are of one row.
    ctx = written(occ.groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("u1", "u2", "first", "count")]))
    release(spark)
    several = ctx.groupBy("anchor").agg(F.count("*").alias("k"), (F.sum(F.col("count") + length - 1) > shard).alias("hot")).where("k > 1").select("anchor", "hot")
    wanted = ctx.join(several, "anchor").groupBy("u1", "u2").agg(F.collect_list(F.struct(*KEYS, "first", "count", "hot")).alias("wanted"))
    bodies = written(docs.select("u1", "u2", "text").join(wanted, ["u1", "u2"]).select("text", "wanted").mapInArrow(_slices(length), f"{_KEY}, hot boolean, body binary"))
    release(spark)
    partly = written(_shards(bodies.where("not hot").select(*KEYS, "body"), length, shard))
    if bodies.where("hot").limit(1).count():
        partly = partly.unionByName(_hot(bodies.where("hot").select(*KEYS, "body"), length, shard))
    release(spark)
    wholly = ctx.where("n > 1").select(*KEYS, _whole(F.col("count")).alias("spans"))
    found = written(partly.join(wholly.select(*KEYS), KEYS, "left_anti").unionByName(wholly))
    drop(ctx)
    drop(bodies)
    release(spark)
    spans = written(occ.select(*KEYS, "u1", "u2", "first").join(found, KEYS).select("u1", "u2", _moved("spans", "first").alias("s")).groupBy("u1", "u2").agg(F.flatten(F.collect_set("s")).alias("spans")))
    drop(occ)
    drop(found)
    release(spark)
    return docs.join(spans, ["u1", "u2"], "left").select("doc_id", "text", "spans").mapInArrow(_cut_out(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
