"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is the bitwise majority of the XXH64 (seed 42) values of a text's word shingles. To find all pairs at two
or fewer differing bits, the 64 bits are cut into three segments (22, 21, 21 bits, each padded to a 23-bit word). The
perfect binary Golay code gives every word one codeword at distance 3 or less; a word at distance exactly 3 lists the
five codewords at distance 4 too, so that two words one bit apart always share a listed codeword. By pigeonhole, two
errors over three segments leave, for one of the pairs (second, third), (third, first), (first, second), at most one
error in the former and none in the latter: a key is the former's codeword index with the latter's bits. Keys are
joined and every candidate pair is verified by its differing bits.

A key shared by more than SMALL distinct fingerprints is not paired up: its fingerprints go to an exact linear way
instead, 65 one-bit variants each, where fingerprints that share a variant are two or fewer bits apart and a variant
has at most 65 owners. No link is lost and no group is expanded into all its pairs.

Null text is empty; a text without words has fingerprint zero and links like any other; repeated rows fall into one
class; extra columns pass through `near_dedup`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop, release, two_hashes, with_ids, without_ids, written

SMALL = 32
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SEGMENTS = ((42, 22), (21, 21), (0, 21))
_PAIRS = ((1, 2), (2, 0), (0, 1))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    out = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        out = np.where(out >> np.uint32(bit) & np.uint32(1), out ^ np.uint32(_GENERATOR << (bit - 11)), out)
    return out


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight 3 or less; the five patterns of weight 4 (0 where there are none)."""
    light = np.array([sum(1 << b for b in c) for w in range(4) for c in combinations(range(23), w)], np.uint32)
    leader = np.zeros(2048, np.uint32)
    leader[_syndromes(light)] = light
    four = np.array([sum(1 << b for b in c) for c in combinations(range(23), 4)], np.uint32)
    by = _syndromes(four)
    order = np.argsort(by, kind="stable")
    lists = np.zeros((2048, 5), np.uint32)
    lists[by[order].reshape(-1, 5)[:, 0]] = four[order].reshape(-1, 5)
    return leader, lists


_LEADER, _FOUR = _golay_tables()


def codewords_near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: (row, codeword index) of each listed codeword."""
    s = _syndromes(words)
    own = (words ^ _LEADER[s]) >> np.uint32(11)
    row, col = np.nonzero(_FOUR[s])
    more = (words[row] ^ _FOUR[s][row, col]) >> np.uint32(11)
    return np.concatenate([np.arange(len(words)), row]), np.concatenate([own, more])


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of 64-bit fingerprints."""
    fps = fps.astype(np.uint64)
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in _SEGMENTS]
    rows, keys = [], []
    for tag, (loose, exact) in enumerate(_PAIRS):
        row, index = codewords_near(parts[loose])
        rows.append(row)
        keys.append(np.uint64(tag) << np.uint64(40) | index.astype(np.uint64) << np.uint64(22) | parts[exact][row].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of every n-word shingle of the A-Z lower-cased text, repeats included; fewer words: of the whole sequence."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - n + 1].tolist()
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        count += np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the signed 64-bit fingerprint."""

    def run(batches):
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t.as_py(), shingle)) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _keyed(batches):
    for batch in batches:
        fps = batch["fp"].to_numpy()
        row, key = golay_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[row])], names=["key", "fp"])


def _within(batches, max_bits: int, small: int = SMALL):
    """Rows sorted by key: verified pairs of small groups, (fp, fp) for each member of a large one."""
    key = np.zeros(0, np.int64)
    fp = np.zeros(0, np.int64)
    large: int | None = None

    def pairs(key, fp):
        out = []
        for d in range(1, small):
            same = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else []
            if not len(same):
                break
            near = same[np.bitwise_count((fp[same] ^ fp[same + d]).view(np.uint64)) <= max_bits]
            out.append((fp[near], fp[near + d]))
        return out

    def rows(out):
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        key, fp = np.concatenate([key, batch["key"].to_numpy()]), np.concatenate([fp, batch["fp"].to_numpy()])
        if not len(key):
            continue
        out = []
        if large is not None:
            n = int(np.searchsorted(key, large, "right"))
            out.append((fp[:n], fp[:n]))
            key, fp = key[n:], fp[n:]
            if not len(key):
                yield rows(out)
                continue
            large = None
        last = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - last > small:
            large, last = int(key[-1]), len(key)
        done, of = key[:last], fp[:last]
        _, where, size = np.unique(done, return_inverse=True, return_counts=True)
        big = size[where] > small if len(done) else np.zeros(0, bool)
        out.append((of[big], of[big]))
        out += pairs(done[~big], of[~big])
        key, fp = key[last:], fp[last:]
        yield rows(out)
    yield rows(pairs(key, fp))


def link_fingerprints(fps: DataFrame, max_bits: int = 2, small: int = SMALL) -> DataFrame:
    """(a, b) edges over the distinct values of fps.fp whose components are those of 'at most max_bits (2 or fewer) bits apart'."""
    if max_bits > 2:
        raise ValueError("the keys are complete up to two differing bits")
    keyed = fps.select("fp").distinct().mapInArrow(_keyed, "key long, fp long")
    found = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _within(b, max_bits, small), "a long, b long"))
    edges = found.where("a <> b").distinct()
    large = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    flips = [F.lit(0), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)]]
    owners = large.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("variant")).groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    if max_bits < 2:
        owners = owners.where(F.array_contains("fps", F.col("variant")))
    star = owners.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b")).distinct()
    return edges.unionAll(star)


def _link_firsts(first: DataFrame, max_bits: int = 2, small: int = SMALL) -> DataFrame:
    """(a, b) links as those of link_fingerprints, between the documents first.first of the fingerprints first.fp."""
    edges = link_fingerprints(first, max_bits, small)
    named = edges.join(first.select(F.col("fp").alias("a"), F.col("first").alias("_a")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("_b")), "b")
    return named.select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def classes(fps: DataFrame, max_bits: int = 2, small: int = SMALL) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most max_bits differing bits."""
    fps = written(fps)
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(_link_firsts(first, max_bits, small))
    by_fp = first.join(roots, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# --- Near-duplicate removal at a shingle similarity ------------------------------------------------------------------

#: Bits of a sketch, each of one least hash; pairs whose estimate is SURE standard errors below the likeness are ruled out.
SKETCH, SURE = 256, 6.0
#: Rows from which a bucket of keys, if also HOT_TIMES the mean bucket, is dealt over SALTS tasks.
HOT_ROWS, HOT_TIMES, SALTS = 1 << 17, 8, 64
#: Members from which a key is a crowd's, whose pairs are made once rather than once a shared key.
CROWD = 64
_BUCKET_BITS = 20


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """Documents by bucket of their shingle hashes, from buckets that a task meets twice: what is common, for the order of keys."""

    def run(batches):
        n = np.zeros(1 << _BUCKET_BITS, np.int32)
        for batch in batches:
            for t in batch["text"]:
                np.add.at(n, _bucket(np.unique(shingle_hashes(t.as_py(), shingle))), 1)
        at = np.flatnonzero(n > 1)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part].astype(np.int64))], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << _BUCKET_BITS, np.int64)
    counts[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return counts


def prefix_keys(h: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in one order of all shingles, rare ones first: sets of this similarity share one.

    Of n shingles that is all but those that an overlap needs and one more: two sets that share none of them have fewer
    than ceil(similarity * n) shingles in common. That holds in any order; `counts` only makes the keys selective.
    """
    h = np.unique(h)
    need = int(np.ceil(similarity * len(h) - 1e-9))
    return h[np.lexsort((h, counts[_bucket(h)]))][: len(h) - need + 1] if len(h) else h


def _prefixes_of(batch, counts, shingle, similarity):
    """Number of shingles and prefix keys of each text of a batch."""
    sets = (np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch["text"])
    return [(len(h), prefix_keys(h, counts, similarity).view(np.int64)) for h in sets]


def prefixes(docs: DataFrame, counts, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, keys): prefix keys in order; `counts` is a broadcast of bucket_counts."""

    def run(batches):
        for batch in batches:
            keys = [k for _, k in _prefixes_of(batch, counts.value, shingle, similarity)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<long>")


_TIMES, _PLUS = np.random.default_rng(42).integers(0, 1 << 64, (2, SKETCH), np.uint64)
_TIMES |= np.uint64(1)


def sketch_bits(h: np.ndarray) -> np.ndarray:
    """Bytes of SKETCH bits of a set of hashes: bit 24 of the set's least value under each of SKETCH linear hashes.

    Two sets agree in a bit with probability (1 + likeness) / 2: surely where the least values come from one member, by
    even chance otherwise. That holds for sets of any size.
    """
    least = np.full(SKETCH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 60):  # blocks that stay in cache
        np.minimum(least, (h[at : at + 60, None] * _TIMES + _PLUS).min(0), out=least)
    return np.packbits((least >> np.uint64(24) & np.uint64(1)).astype(np.uint8))


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, sketch, fp): sketch bits and SimHash fingerprint (null without words) of the shingles of each text, in one pass over the texts."""

    def run(batches):
        for batch in batches:
            bits, fps, known = [], [], []
            for t in batch["text"]:
                h = shingle_hashes(t.as_py(), shingle)
                bits.append(sketch_bits(np.unique(h)).tobytes())
                fps.append(majority(h))
                known.append(len(h) > 0)
            fp = pa.array(np.array(fps, np.uint64).view(np.int64), mask=~np.array(known, bool))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(bits, pa.binary()), fp], names=["doc_id", "sketch", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sketch binary, fp long")


def fingerprint_pairs(fps: DataFrame) -> DataFrame:
    """(a, b) that join documents with fingerprints at two or fewer differing bits, by Golay keys: the firsts of linked fingerprints, and each document with the first of its own."""
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    same = fps.join(first, "fp").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    near = _link_firsts(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(same.unionAll(near).distinct())
    drop(first)
    return pairs


_KEYED = "doc_id long, n long, pos int, key long, salt int"


def keyed(docs: DataFrame, counts, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row for each prefix key of a document with an id; keys of a hot bucket carry a salt above 0, all others 0."""

    def run(batches):
        known = counts.value
        hot = known > max(HOT_ROWS, HOT_TIMES * float(known.mean()))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                of = _prefixes_of(part, known, shingle, similarity)
                size = np.array([len(k) for _, k in of], np.int64)
                keys = np.concatenate([k for _, k in of])
                pos = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
                doc, n = np.repeat(part["doc_id"].to_numpy(), size), np.repeat(np.array([x for x, _ in of], np.int64), size)
                salt = np.where(hot[_bucket(keys.view(np.uint64))], 1 + doc % SALTS, 0)
                yield pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(n), pa.array(pos.astype(np.int32)), pa.array(keys), pa.array(salt.astype(np.int32))], names=["doc_id", "n", "pos", "key", "salt"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, _KEYED)


def _shared(batches, similarity: float):
    """Rows sorted by (key, salt, n): those whose key another row has and whose place leaves room for a like document.

    A like document under the key has at least as many shingles as the key's first row and similarity * n, and at most
    what the position of the key leaves room for. Salted rows may have their like under another salt: they only need room.
    One row is held back over batches, so a key of any number of rows streams through.
    """
    names = ["doc_id", "n", "pos", "key", "salt"]
    held = {c: np.zeros(0, np.int64) for c in names}
    open_, least = None, 0  # the (key, salt) of the last row passed on, and its run's least n

    def passed(x, first, several):
        least = np.where(x["salt"] > 0, 0, np.maximum(first, similarity * x["n"]))
        room = (x["n"] - x["pos"]) * ((1 + similarity) / similarity) - x["n"] + 1e-6
        keep = (several | (x["salt"] > 0)) & (np.maximum(least, similarity * x["n"]) <= room)
        return pa.RecordBatch.from_arrays([pa.array(x["doc_id"][keep]), pa.array(x["n"][keep]), pa.array(x["pos"][keep].astype(np.int32)), pa.array(x["key"][keep])], names=names[:4])

    for batch in batches:
        x = {c: np.concatenate([held[c], batch[c].to_numpy().astype(np.int64)]) for c in names}
        total = len(x["key"])
        if not total:
            continue
        new = np.ones(total, bool)
        new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["salt"][1:] != x["salt"][:-1])
        goes_on = open_ == (int(x["key"][0]), int(x["salt"][0]))
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, total])
        first, several = x["n"][at], size > 1
        if goes_on:
            first[0], several[0] = least, True
        wait = int(not several[-1])  # the only row of its run so far
        if not wait:
            open_, least = (int(x["key"][-1]), int(x["salt"][-1])), int(first[-1])
        else:
            open_ = None
        held = {c: v[total - wait :] for c, v in x.items()}
        done = {c: v[: total - wait] for c, v in x.items()}
        yield passed(done, np.repeat(first, size)[: total - wait], np.repeat(several, size)[: total - wait])
    yield passed(held, held["n"], np.zeros(len(held["n"]), bool))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def may_be_like(a: list[bytes], b: list[bytes], similarity: float) -> np.ndarray:
    """Which pairs of sketches leave it open that their sets are of this similarity."""
    if not a:
        return np.zeros(0, bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    agree = SKETCH - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    p = (1 + similarity) / 2
    return agree >= SKETCH * p - SURE * np.sqrt(SKETCH * p * (1 - p))


def _verified(pairs: DataFrame, sketch: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) of the distinct candidate pairs that are alike: what sketches do not rule out, by all shingles of the texts."""
    def rule_out(batches):
        for batch in batches:
            keep = may_be_like(batch["sa"].to_pylist(), batch["sb"].to_pylist(), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(batches):
        last, of_last = None, None
        for batch in batches:
            good = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, of_last = a, np.unique(shingle_hashes(x.as_py(), shingle))
                good.append(jaccard(of_last, np.unique(shingle_hashes(y.as_py(), shingle))) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def both(df, table, column, short):
        return df.join(table.select(F.col("doc_id").alias("a"), F.col(column).alias(f"{short}a")), "a").join(table.select(F.col("doc_id").alias("b"), F.col(column).alias(f"{short}b")), "b")

    maybe = written(both(pairs, sketch, "sketch", "s").select("a", "b", "sa", "sb").mapInArrow(rule_out, "a long, b long"))
    named = maybe.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    named = written(named)
    texts = written(with_ids(docs.select("doc_id", "text"), named).dropDuplicates(["doc_id"]))
    alike = written(both(maybe, texts, "text", "t").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"))
    for done in (maybe, named, texts):
        drop(done)
    return alike


def _can_be_like(x: str, y: str, similarity: float) -> Column:
    """False only if rows (pos, n) of a shared key cannot be the first key that two like documents share.

    The overlap is then at most what is left of either from that key on; it has to be similarity / (1 + similarity) of
    both sizes.
    """
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return left + 1e-6 >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (similarity / (1 + similarity))


def _across(members: DataFrame, roots: DataFrame, similarity: float = 0.8, keys_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Distinct (a, b) that share a key, can be like and are not yet in one component: every such pair.

    In each key the largest component is set against the others, and these against each other, so a group that hangs
    together but for a few members costs those few times its size. Under keys of more than CROWD members, which like
    documents share by the dozen, a pair is made at the first key that it shares only (keys_of gives (doc_id, keys) of wanted documents).
    """
    placed = written(members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1").select("key", "main", "all")
    open_ = written(placed.join(most, "key"))

    def pairs(rows: DataFrame, more: Column | None = None) -> DataFrame:
        few, other = rows.where("root <> main").alias("x"), rows.alias("y")
        on = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.doc_id") < F.col("y.doc_id"))) & _can_be_like("x", "y", similarity)
        return few.join(other, on if more is None else on & more).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))

    if keys_of is None:
        return pairs(open_).distinct()
    who = written(open_.where(F.col("all") > CROWD).select("doc_id").distinct())
    keys = keys_of(who).groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("keys").alias("keys"))
    before = F.when(F.col("rows") == 1, F.slice("keys", F.lit(1), F.col("pos"))).otherwise(F.array().cast("array<long>"))  # what is not known for sure skips nothing
    crowded = written(open_.where(F.col("all") > CROWD).join(keys, "doc_id").withColumn("before", before).drop("rows", "keys"))
    return pairs(open_.where(F.col("all") <= CROWD)).unionAll(pairs(crowded, ~F.arrays_overlap("x.before", "y.before"))).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component."""
    for x in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every document that is not alone in its group.

    Equal texts are one representative. SimHash makes the first links: representatives whose fingerprints of these
    shingles are two or fewer bits apart, by Golay keys, are checked, and what is alike is one component. Two bits do not
    reach all pairs of the similarity, so what SimHash leaves apart has an exact way: any two of the similarity share a
    prefix key. First each representative is checked against the smallest document under any of its keys and the
    smallest under its rarest, then against the smallest under every key, each only if it is not in its component by
    then, which puts most like documents into one component without pairing a group up. Then every pair that shares a
    key and is not in one component yet is checked. Every link is verified on all shingles of both texts, once sketches have ruled out the clearly unlike;
    that is an estimate, which loses a pair of likeness 0.8 with a chance of 4.5 in 10^8, and no other step loses one. Documents without words are like equal texts only.
    """
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, shingle))
    release(docs.sparkSession)
    h1, h2 = two_hashes(F.coalesce("text", F.lit("")))
    info = written(docs.select("doc_id", h1.alias("h1"), h2.alias("h2")))
    reps = info.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copies = info.join(reps.where("n > 1"), ["h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    copies = written(copies.distinct())
    distinct = without_ids(docs.select("doc_id", "text"), copies.select(F.col("a").alias("doc_id")))
    rows = keyed(distinct, counts, shingle, similarity).repartition("key", "salt").sortWithinPartitions("key", "salt", "n")
    members = written(rows.mapInArrow(lambda b: _shared(b, similarity), "doc_id long, n long, pos int, key long"))
    release(docs.sparkSession)
    sketch = written(sketches(docs, shingle).dropDuplicates(["doc_id"]))
    close = fingerprint_pairs(without_ids(sketch.where("doc_id is not null and fp is not null").select("doc_id", "fp"), copies.select(F.col("a").alias("doc_id"))))
    linked = _verified(close, sketch, docs, shingle, similarity)
    roots = written(components(linked))
    first = written(members.groupBy("key").agg(F.min_by(F.struct("doc_id", "pos", "n"), "doc_id").alias("f")).select("key", F.col("f.*")))
    tries = members.alias("y").join(first.alias("x"), "key").where(F.col("y.doc_id") != F.col("x.doc_id")).where(_can_be_like("x", "y", similarity)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("y.pos").alias("pos"))
    two = tries.groupBy("b").agg(F.min("a").alias("low"), F.min_by("a", F.struct("pos", "a")).alias("rare")).select(F.explode(F.array_distinct(F.array("low", "rare"))).alias("a"), "b")
    checked = linked.unionAll(_verified(_apart(two, roots), sketch, docs, shingle, similarity))
    roots = written(components(checked))
    apart = _apart(tries.select("a", "b").distinct(), roots).join(two, ["a", "b"], "left_anti")
    checked = checked.unionAll(_verified(apart, sketch, docs, shingle, similarity))
    roots = components(checked)
    rest = _verified(_across(members, roots, similarity, lambda ids: prefixes(with_ids(docs, ids), counts, shingle, similarity)), sketch, docs, shingle, similarity)
    groups = components(checked.unionAll(rest).unionAll(copies))
    for done in (info, copies, members, sketch, close, first):
        drop(done)
    release(docs.sparkSession)
    return groups.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document (the smallest doc_id) of each group of near-duplicates.

    Rows with one doc_id stand or fall together; rows without a doc_id stay. A null text equals an empty one.
    """
    gone = written(near_groups(docs, shingle, similarity).where("doc_id <> component_id").select("doc_id"))
    return without_ids(docs, gone).select(*docs.columns)
