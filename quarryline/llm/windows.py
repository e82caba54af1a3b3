"""Substring deduplication over a log-structured index of word fingerprints.

A window is 13 consecutive words of a document; words covered by a window that also starts in a document of smaller
doc_id are removed. Every window is assigned the least-hashed 4-gram inside it as its anchor (see anchors.py).

Index: documents come in batches of rising doc_id. A batch's anchors are counted, merge-joined with the sorted, bucketed,
immutable runs of all earlier batches, and those not there yet become a new run; when runs of a level pile up they are
compacted into one. An anchor seen before, or in two documents of the batch, is shared. Verification: documents with a
shared anchor give its contexts; equal contexts collapse to the smallest document, and the windows of the distinct
contexts are compared by hashes (48 bits of anchor and 64 of window), so copies are never expanded into pairs.

Null text has no words; rows without doc_id lose and cause nothing; rows that share a doc_id are judged each and do not
count as each other's predecessor; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import _Q, Sums, buffers, contexts, cut, mix, words
from .common import bounds, drop, release, written

WINDOW, GRAM, BATCHES, FANOUT = 13, 4, 3, 2


def _scan(texts: pa.Array, window: int):
    """(bytes, word starts, ends, text of word, anchors, first windows, window counts, sums of word hashes)."""
    data, offsets = buffers(texts)
    start, end, block = words(data, offsets)
    hashes = Sums(data).of(start, end)
    n = len(start)
    sums = Sums(hashes, _Q)
    k = min(GRAM, window)
    at = np.arange(max(0, n - k + 1))
    grams = sums.of(at, at + k)
    whole = np.zeros(len(grams), bool)
    if n >= window:
        whole[: n - window + 1] = block[window - 1 :] == block[: n - window + 1]
    anchor, first, count = contexts(grams, block, whole, window - k + 1)
    return data, start, end, block, anchor, first, count, sums


class FingerprintIndex:
    """Levels of immutable runs of anchors, each a bucketed table sorted by anchor."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _run(self, anchors: DataFrame) -> str:
        name = f"quarryline_run_{uuid.uuid4().hex}"
        anchors.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(name)
        return name

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add the rows (anchor, doc_id) of a batch; returns its shared anchors."""
        seen = batch.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).withColumn("old", F.lit(False))
        for name in self.names():
            run = self.spark.table(name).select(F.col("anchor").alias("_a"))
            seen = seen.join(run.hint("merge"), seen["anchor"] == run["_a"], "left").withColumn("old", F.col("old") | F.col("_a").isNotNull()).drop("_a")
        staged = self._run(seen.select("anchor", "old", (F.col("old") | (F.col("lo") < F.col("hi"))).alias("shared")))
        rows = self.spark.table(staged)
        shared = written(rows.where("shared").select("anchor"))
        self.levels[0].append(self._run(rows.where("not old").select("anchor")))
        self.spark.sql(f"drop table {staged}")
        self._compact()
        release(self.spark)
        return shared

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) > self.fanout:
                merged = self._run(reduce(DataFrame.unionAll, [self.spark.table(n) for n in level]).repartition("anchor"))
                for name in level:
                    self.spark.sql(f"drop table {name}")
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def close(self) -> None:
        for name in self.names():
            self.spark.sql(f"drop table {name}")
        self.levels = [[]]


def anchor_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, doc_id), one row for each distinct anchor of a document."""

    def run(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                _, _, _, block, anchor, first, _, _ = _scan(part["text"], window)
                both = np.unique(np.stack([block[first].astype(np.uint64), anchor], 1), axis=0) if len(anchor) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 1].astype(np.int64)), part["doc_id"].cast(pa.int64()).take(pa.array(both[:, 0].astype(np.int64)))], names=["anchor", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def _digest(kept) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _touched(batches):
    """Rows with their shared anchors: those without any are final, the others keep their text."""
    for batch in batches:
        for part in cut(batch, "text"):
            text, shared = part["text"], part["shared"]
            more, counts, digests = shared.is_valid(), [], []
            for raw, open_ in zip(text.cast(pa.binary()), more.to_pylist(), strict=True):
                split = None if open_ else (raw.as_py() or b"").split()
                counts.append(None if open_ else len(split))
                digests.append(None if open_ else _digest(split))
            text = text.fill_null("").take(pc.if_else(more, pa.array(np.arange(len(text))), None))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["rid"], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), text, shared], names=["doc_id", "rid", "n_words", "kept_sha256", "text", "shared"])


def _occurrences(window: int, hashed: bool):
    """Contexts of the shared anchors, with the hashes of their windows or only with their number."""

    def run(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                _, _, _, block, anchor, first, count, sums = _scan(part["text"], window)
                lists = part["shared"]
                flat = lists.flatten().to_numpy().astype(np.uint64)
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) if len(lists) else np.zeros(0, np.int64)
                mine = block[first]
                keep = np.isin(mix(anchor) ^ mine.astype(np.uint64), mix(flat) ^ owner.astype(np.uint64))
                anchor, first, count, mine = anchor[keep], first[keep], count[keep], mine[keep]
                ctx = sums.of(first, first + count + window - 1)
                wins = pa.array(count.astype(np.int32))
                if hashed:
                    ends = np.cumsum(count)
                    start = np.repeat(first, count) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
                    wins = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(sums.of(start, start + window).view(np.int64)))
                base = np.searchsorted(block, np.arange(part.num_rows), "left")
                take = pa.array(mine)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(ctx.view(np.int64)), part["doc_id"].take(take), part["rid"].take(take), pa.array((first - base[mine]).astype(np.int32)), wins], names=["anchor", "ctx", "doc_id", "rid", "first", "wins" if hashed else "n"])

    return run


def _removed(window: int):
    def run(batches):
        for batch in batches:
            for part in cut(batch, "text"):
                at, starts, counts = (x.to_numpy() for x in (part["starts"].offsets, part["starts"].values, part["counts"].values))
                n_words, n_removed, digests = [], [], []
                for k, raw in enumerate(part["text"].cast(pa.binary())):
                    split = raw.as_py().split()
                    n, s, c = len(split), starts[at[k] : at[k + 1]], counts[at[k] : at[k + 1]]
                    kept = split
                    if len(s):
                        open_ = np.bincount(s, minlength=n + 1) - np.bincount(np.minimum(s + c + window - 1, n), minlength=n + 1)
                        kept = list(compress(split, (np.cumsum(open_)[:n] == 0).tolist()))
                    n_words.append(n)
                    n_removed.append(n - len(kept))
                    digests.append(_digest(kept))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = bounds(docs, "doc_id", batches)
    index, shared = FingerprintIndex(spark), []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") > int(lo))
        if hi is not None:
            part = part.where(F.col("doc_id") <= int(hi))
        shared.append(index.add(anchor_rows(part, window)))
    index.close()
    shared_anchors = written(reduce(DataFrame.unionAll, shared).distinct())
    for s in shared:
        drop(s)
    by_doc = anchor_rows(docs, window).join(shared_anchors, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))
    rid = F.xxhash64(F.coalesce("text", F.lit("")))
    looked = docs.withColumn("rid", rid).join(by_doc, "doc_id", "left").select("doc_id", "rid", "text", "shared")
    looked = written(looked.mapInArrow(_touched, "doc_id long, rid long, n_words long, kept_sha256 string, text string, shared array<long>"))
    release(spark)
    open_ = looked.where("text is not null")
    shape = "anchor long, ctx long, doc_id long, rid long, first int, "
    chosen = open_.select("doc_id", "rid", "text", "shared")
    occ = chosen.mapInArrow(_occurrences(window, True), shape + "wins array<long>")
    ctx = written(occ.groupBy("anchor", "ctx").agg(F.min("doc_id").alias("lo"), F.first("wins").alias("wins")))
    release(spark)
    several = ctx.groupBy("anchor").agg(F.count("*").alias("k"))
    counted = written(ctx.join(several, "anchor").select("anchor", "ctx", "lo", F.when(F.col("k") > 1, F.col("wins")).alias("wins")))
    drop(ctx)
    release(spark)
    # A context's windows are as old as its first document, unless another context of the anchor had one of them earlier.
    each = counted.where("wins is not null").select("anchor", "ctx", "lo", F.posexplode("wins").alias("off", "h"))
    low = written(each.groupBy("anchor", "h").agg(F.min("lo").alias("wlo"), F.max("lo").alias("whi")).where("wlo < whi").select("anchor", "h", "wlo"))
    release(spark)
    older = each.join(low, ["anchor", "h"]).where("wlo < lo").groupBy("anchor", "ctx").agg(F.collect_list("off").alias("offs"))
    lows = written(counted.select("anchor", "ctx", "lo").join(older, ["anchor", "ctx"], "left"))
    drop(counted)
    drop(low)
    release(spark)
    place = chosen.mapInArrow(_occurrences(window, False), shape + "n int")
    hit = place.join(lows, ["anchor", "ctx"]).where("lo < doc_id or offs is not null")
    span = lambda start, n: F.struct(start.cast("int").alias("at"), n.cast("int").alias("n"))
    found = F.when(F.col("lo") < F.col("doc_id"), F.array(span(F.col("first"), F.col("n")))).otherwise(F.transform("offs", lambda x: span(x + F.col("first"), F.lit(1))))
    spans = written(hit.select("doc_id", "rid", F.explode(found).alias("s")).groupBy("doc_id", "rid").agg(F.collect_list("s").alias("spans")).select("doc_id", "rid", F.col("spans.at").alias("starts"), F.col("spans.n").alias("counts")))
    drop(lows)
    release(spark)
    cut_ = open_.select("doc_id", "rid", "text").join(spans, ["doc_id", "rid"], "left").select("doc_id", "text", "starts", "counts").mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return looked.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionAll(cut_)
