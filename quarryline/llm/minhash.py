"""Near-duplicates by circulant MinHash: two permutations generate every coordinate of the signature.

A shingle's XXH64 is placed on a circle of 2^20 places (the first permutation); a second permutation of the places, turned
by k, gives coordinate k, the least value at the set's places. So the values of one shingle for all coordinates are one
contiguous slice of the permutation, and a signature is the minimum of as many slices as there are shingles. Bands of ROWS
coordinates are the keys; documents that share one are candidates. At a likeness of 0.85 a pair shares none of the 51 bands
with a chance of (1 - 0.85^5)^51 = 10^-13; no other step loses a pair but the sketch (below).

Equal sets are one representative. Sets too small to be like a different one (five shingles or fewer at 0.85) have no keys. Each key's hub is its
most central member. Members are first set against the most central of their hubs and the one that they share most bands with,
then, where these are not in one component yet, against their other hubs. What is then still apart under a key is checked whatever the size of the key:
where one component has CROWD members or more, all others ask its blocks and each other's, in which full sets are looked
up and no row stands for a pair; all other pairs one by one. Sketches (a bit of each coordinate) rule out pairs whose estimate is six
standard errors below the likeness (4.5 in 10^8 of the pairs at exactly 0.85); all others are decided on the full sets.

A null text is empty; texts without words are linked with nothing, not with each other; texts of fewer words than a
shingle are one shingle. Rows with one doc_id are one document, linked where any of its texts is; rows without
doc_id have component null, are linked with nothing and are kept. Ties do not arise: a component's name is its smallest doc_id. Long texts
take memory for their distinct hashes only. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import components, drop, release, with_ids, written
from .simhash import SKETCH, jaccard, may_be_like, shingle_hashes

#: Coordinates (one bit of each makes the sketch), coordinates of a band, and places of the circle.
COORDINATES, ROWS, PLACES = SKETCH, 5, 1 << 20
#: Members from which a component is a crowd, and shingle hashes in a block of one.
CROWD, BLOCK = 64, 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLES: dict[int, np.ndarray] = {}


def _slices() -> np.ndarray:
    """Row p: the values that the coordinates give to a shingle at place p."""
    if not _TABLES:
        turn = np.random.default_rng(20240117).permutation(PLACES).astype(np.uint32)
        _TABLES[0] = np.lib.stride_tricks.sliding_window_view(np.r_[turn, turn[: COORDINATES - 1]], COORDINATES)
    return _TABLES[0]


def signature(h: np.ndarray) -> np.ndarray:
    """The coordinates of a non-empty set of 64-bit hashes."""
    at, slices = (h * _MIX) >> np.uint64(44), _slices()
    out = np.full(COORDINATES, PLACES, np.uint32)
    for k in range(0, len(at), 2048):
        np.minimum(out, slices[at[k : k + 2048]].min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    bands = len(sig) // ROWS
    key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for column in sig[: bands * ROWS].reshape(bands, ROWS).T.astype(np.uint64):
        key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def fewest(similarity: float) -> int:
    """The least size of a set that can be like a different one."""
    n = 1
    while n / (n + 1) < similarity:
        n += 1
    return n


def signatures(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, n, s1, s2, sketch, keys): size and 128-bit name of the shingle set, its sketch and band keys."""
    least = fewest(similarity)

    def run(batches):
        for batch in batches:
            size, name, sketch, keys = [], [], [], []
            for t in batch["text"]:
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                size.append(len(h))
                name.append(np.frombuffer(xxh3_128_digest(h), np.int64))
                sig = signature(h) if len(h) >= least else None
                sketch.append(b"" if sig is None else np.packbits(sig & 1).tobytes())
                keys.append(None if sig is None else band_keys(sig))
            s = np.array(name, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(size, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "sketch", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch binary, keys array<long>")


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs with a column of table for a and for b."""
    for x in ("a", "b"):
        pairs = pairs.join(table.select(F.col("doc_id").alias(x), F.col(column).alias(f"of_{x}")), x)
    return pairs.select("a", "b", "of_a", "of_b")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) that are alike: what sketches leave open, by the full sets of both."""

    def open_(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(may_be_like(batch["of_a"].to_pylist(), batch["of_b"].to_pylist(), similarity), pa.bool_()))

    def alike(batches):
        last, of_last = None, None
        for batch in batches:
            good = []
            for x, y in zip(batch["of_a"], batch["of_b"], strict=True):
                if (t := x.as_py()) != last:
                    last, of_last = t, np.unique(shingle_hashes(t, shingle))
                good.append(jaccard(of_last, np.unique(shingle_hashes(y.as_py(), shingle))) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    maybe = written(_both(pairs, sets, "sketch").mapInArrow(open_, "a long, b long").distinct())
    named = written(maybe.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = written(with_ids(docs.select("doc_id", "text"), named))
    out = written(_both(maybe, texts, "text").mapInArrow(alike, "a long, b long").distinct())
    for done in (maybe, named, texts):
        drop(done)
    return out


def _blocks(batches, similarity: float):
    """Rows (root, salt, part, asks, doc_id, grams) sorted by these: links (a, b) of the asking documents with a block's own.

    A block's hashes are sorted once; an asking document looks its own up and counts what it shares with each. Of the alike pairs of a
    block only those that join two parts of it are given, which are fewer than its documents.
    """
    of, docs, sets, table, above = None, [], [], None, {}

    def built():
        size = np.array([len(x) for x in sets], np.int64)
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        return h[order], np.repeat(np.arange(len(sets)), size)[order], size, np.array(docs, np.int64)

    def top(x):
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for batch in batches:
        links = []
        for *block, asks, doc, grams in zip(*(batch[c].to_pylist() for c in ("root", "salt", "part", "asks", "doc_id", "grams")), strict=True):
            if block != of:
                of, docs, sets, table, above = block, [], [], None, {}
            x = np.frombuffer(grams, np.uint64)
            if not asks:
                docs.append(doc)
                sets.append(x)
                continue
            table = table or built()
            h, owner, size, ids = table
            lo, hi = np.searchsorted(h, x, "left"), np.searchsorted(h, x, "right")
            n = hi - lo
            ends = np.cumsum(n)
            both = np.bincount(owner[np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], minlength=len(size))
            for other in ids[both / np.maximum(1, size + len(x) - both) >= similarity].tolist():
                p, q = top(doc), top(other)
                if p != q:
                    above[max(p, q)] = min(p, q)
                    links.append((min(doc, other), max(doc, other)))
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def against_crowds(near: DataFrame, crowds: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that join what is alike among near(doc_id, root) and between these and their root's members, crowds(node, root).

    By the full sets. Both sides are dealt over parts of about BLOCK hashes, and each part that asks is sent to each
    block of its crowd: no row stands for a pair.
    """

    def grams(batches):
        for batch in batches:
            got = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], names=["doc_id", "n", "grams"])

    every = written(crowds.select(F.col("node").alias("doc_id"), "root").unionAll(near.select("doc_id", "root")).distinct())
    sets = written(with_ids(docs.select("doc_id", "text"), every.select("doc_id").distinct()).mapInArrow(grams, "doc_id long, n long, grams binary"))
    shares = lambda df, name: df.join(sets, "doc_id").groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).alias(name))
    loads = written(shares(every, "salts").join(shares(near, "parts"), "root"))
    at = F.xxhash64("doc_id")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["root", "salt", "part", "asks", "doc_id", "grams"]
    own = every.join(loads, "root").withColumn("salt", F.pmod(at, "salts")).withColumn("part", upto("parts")).withColumn("asks", F.lit(0))
    ask = near.join(loads, "root").withColumn("part", F.pmod(at, "parts")).withColumn("salt", upto("salts")).withColumn("asks", F.lit(1))
    dealt = own.join(sets, "doc_id").select(*columns).unionAll(ask.join(sets, "doc_id").select(*columns))
    dealt = dealt.repartition("root", "salt", "part").sortWithinPartitions("root", "salt", "part", "asks", "doc_id")
    return written(dealt.mapInArrow(lambda x: _blocks(x, similarity), "a long, b long").where("a <> b").distinct())


def _rooted(members: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """members with the root of their component; a document without links is its own."""
    return members.join(roots.select(F.col("node").alias("doc_id"), F.col("root").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, "doc_id"))


def _rest(members: DataFrame, checked: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Alike pairs (a, b) among the documents that share a key and are not in one component yet; none is left out.

    Under each key the largest component stands against the others. Where it is a crowd, these ask its blocks, and those
    of the others; under all other keys pairs are made, once those of the crowds are joined.
    """
    roots = written(components(checked))
    placed = written(_rooted(members, roots, "root"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("here"))
    most = parts.groupBy("key").agg(F.max_by("root", F.struct("here", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    crowd = roots.groupBy(F.col("root").alias("main")).agg(F.count("*").alias("size")).where(F.col("size") >= CROWD).select("main", F.lit(True).alias("crowd"))
    most = most.join(crowd, "main", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    open_ = written(placed.join(most, "key"))
    near = written(open_.where("crowd and root <> main").select("doc_id", F.col("main").alias("root")).distinct())
    found = against_crowds(near, roots.join(near.select("root").distinct(), "root", "left_semi"), docs, shingle, similarity)
    later = _rooted(open_, components(checked.unionAll(found)), "now")
    later = later.where("not crowd")
    apart = later.groupBy("key").agg(F.min("now").alias("low"), F.max("now").alias("high")).where("low <> high").select("key")
    later = written(later.join(apart, "key"))
    x, y = later.where("root <> main").alias("x"), later.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.now") != F.col("y.now")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.doc_id") < F.col("y.doc_id"))) & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6)
    pairs = x.join(y, on).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    return found.unionAll(verified(pairs, sets, docs, shingle, similarity))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    spark = docs.sparkSession
    sigs = written(signatures(docs, shingle, similarity))
    known = sigs.where("n > 0 and doc_id is not null")
    names = written(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("of")))
    copies = written(known.select("s1", "s2", F.col("doc_id").alias("b")).join(names.where("of > 1").select("s1", "s2", F.col("doc_id").alias("a")), ["s1", "s2"]).where("a <> b").select("a", "b").distinct())
    sets = written(known.where("keys is not null").join(names.drop("of"), ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id", "s1", "s2"]).drop("s1", "s2"))
    rows = sets.select("doc_id", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("of")).where("of > 1")
    members = written(rows.join(shared, "key").select("key", "doc_id", "n", "of"))
    release(spark)
    # The centre of a group of near copies keeps most of what they share, so its keys are the fullest: it is every key's hub.
    central = members.groupBy("doc_id").agg(F.sum("of").alias("weight"))
    hubs = members.select("key", "doc_id").join(central, "doc_id").groupBy("key").agg(F.max_by(F.struct(F.col("doc_id").alias("a"), "weight"), F.struct("weight", -F.col("doc_id"))).alias("hub")).select("key", "hub.*")
    tries = written(members.join(hubs, "key").where("doc_id <> a").groupBy("a", F.col("doc_id").alias("b")).agg(F.count("*").alias("bands"), F.max("weight").alias("weight")))
    two = tries.groupBy("b").agg(F.max_by("a", F.struct("weight", -F.col("a"))).alias("centre"), F.max_by("a", F.struct("bands", -F.col("a"))).alias("best")).select(F.explode(F.array_distinct(F.array("centre", "best"))).alias("a"), "b")
    checked = verified(two, sets, docs, shingle, similarity)
    roots = components(checked)
    placed = tries
    for x in ("a", "b"):
        placed = placed.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    apart = placed.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").join(two, ["a", "b"], "left_anti")
    checked = checked.unionAll(verified(apart, sets, docs, shingle, similarity))
    rest = _rest(members.drop("of"), checked, sets, docs, shingle, similarity)
    roots = components(checked.unionAll(rest).unionAll(copies))
    for done in (members, tries, sets, names, copies):
        drop(done)
    release(spark)
    component = F.coalesce("root", "doc_id")
    out = sigs.select("doc_id", F.col("n").alias("n_shingles")).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
