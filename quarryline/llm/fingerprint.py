"""Document fingerprints: threshold-scaled sketches of word shingles, built with DataFrame functions only.

A text's shingles are its sequences of five words (lower-cased, split at ASCII white space; a shorter text is one
shingle). Each shingle has a 63-bit hash. A fingerprint is struct(scale, hashes): it retains every hash below 1/scale of
the range, and nothing else. The scale is 1 for texts of up to SMALL different shingles, which retain all, and SCALE for
others. Two fingerprints are compared at the coarser of their scales, where both are samples by one threshold, so
containment may be estimated however unequal the two documents are; the merge of parts is the fingerprint of the union
of their shingles.

Null and empty texts and texts without words have no hashes; two such are alike (1.0), one of them and another are not
(0.0). Repeated rows are fingerprinted each; ties of doc_id are ordered by the other columns. A text is hashed whole, in
memory a few times its size. Extra columns pass through; a column of the name asked for is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounds, let

SHINGLE, SCALE, SMALL = 5, 4, 64
_RANGE = 1 << 63
#: Most buckets of neighbouring ids; their bounds are what the driver sees. A bucket is sorted with spilling.
MAX_BUCKETS = 4096


def _sketch(scale, hashes: Column) -> Column:
    return F.struct(F.lit(scale).cast("int").alias("scale"), F.sort_array(hashes).alias("hashes"))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE, small: int = SMALL) -> Column:
    """The fingerprint of a text: struct(scale, hashes), hashes ascending."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    mask = F.lit(_RANGE - 1)

    def of(h: Column) -> Column:
        last = F.greatest(F.size(h) - shingle, F.lit(0))
        return F.when(F.size(h) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]).bitwiseAND(mask)))).otherwise(F.array().cast("array<long>"))

    def retained(s: Column) -> Column:
        return F.when(F.size(s) <= small, _sketch(1, s)).otherwise(_sketch(scale, F.filter(s, lambda x: x < _RANGE // scale)))

    return let(let(hashed, of), retained)


def encode(sk: Column) -> Column:
    """A fingerprint as text: its scale, a colon and its hashes as 16 lowercase hex digits each, ascending, joined by commas."""
    return F.concat(sk["scale"].cast("string"), F.lit(":"), F.array_join(F.transform(sk["hashes"], lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ","))


def hashes_at(sk: Column, scale: Column) -> Column:
    """The hashes that the fingerprint retains at a scale as coarse as its own or coarser."""
    return F.when(sk["scale"] >= scale, sk["hashes"]).otherwise(F.filter(sk["hashes"], lambda x: x < (F.lit(_RANGE - 1) / scale).cast("long")))


def merge(a: Column, b: Column, scale: int = SCALE, small: int = SMALL) -> Column:
    """The fingerprint of the shingles of both."""
    wide = F.greatest(a["scale"], b["scale"])
    both = let(F.array_union(hashes_at(a, wide), hashes_at(b, wide)), lambda u: F.when((wide == 1) & (F.size(u) > small), F.filter(u, lambda x: x < _RANGE // scale)).otherwise(u))
    size = F.size(F.array_union(a["hashes"], b["hashes"]))
    return F.struct(F.when((wide == 1) & (size > small), F.lit(scale)).otherwise(wide).cast("int").alias("scale"), F.sort_array(both).alias("hashes"))


def _empty(sk: Column) -> Column:
    return (F.size(sk["hashes"]) == 0) & (sk["scale"] == 1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets (exact between two texts of up to SMALL shingles)."""
    wide = F.greatest(a["scale"], b["scale"])
    x, y = hashes_at(a, wide), hashes_at(b, wide)
    both = F.size(F.array_intersect(x, y))
    return F.when(_empty(a) & _empty(b), F.lit(1.0)).otherwise(F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none, null if none of a's is below the common threshold."""
    wide = F.greatest(a["scale"], b["scale"])
    x = hashes_at(a, wide)
    return F.when(_empty(a), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, hashes_at(b, wide))) / F.nullif(F.size(x), F.lit(0)))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "sketch") -> DataFrame:
    return docs.withColumn(name, sketch(F.col(text)))


def with_next(docs: DataFrame, *columns: str, key: str = "doc_id") -> DataFrame:
    """docs with next_<column>: the value in the row that follows by key (then by all columns), after the last the first.

    Rows go to buckets of neighbouring keys, split at approximate quantiles; the first rows of each bucket go to the
    bucket before as well, so one exchange serves all rows and no row is alone in charge of the order. Nulls sort first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(8, min(MAX_BUCKETS, 4 * parts))
    cuts = bounds(docs, key, wanted)
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda b: b < F.col(key))) if cuts else F.lit(0)
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(bucket).cast("int")
    firsts = {r["_b"]: r["_f"] for r in docs.select(bucket.alias("_b"), key).groupBy("_b").agg(F.min(key).alias("_f")).collect()}  # a row a bucket
    order = sorted(firsts)
    if not order:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    before = F.create_map(*[F.lit(x) for b, p in zip(order, [order[-1], *order[:-1]], strict=True) for x in (b, p)])
    is_first = F.col(key).isNull() | F.col(key).isin([f for f in firsts.values() if f is not None])
    tail = [c for c in docs.columns if c != key and not docs.schema[c].dataType.typeName().startswith(("map", "variant"))]
    # The row goes into a struct, so no column of its own can clash with these.
    placed = docs.select(F.struct(*docs.columns).alias("row"), bucket.alias("b"), is_first.alias("first"))
    rows = placed.select("row", F.posexplode(F.when(F.col("first"), F.array(F.col("b"), before[F.col("b")])).otherwise(F.array("b"))).alias("copy", "bucket")).repartition("bucket")  # before the window's own columns are taken from the row
    spec = "over (partition by bucket order by copy, {0})".format(", ".join(f"row.`{c}`" for c in (key, *tail)))
    out = rows.select("row", "copy", *[F.expr(f"lead(row.`{c}`) {spec}").alias(f"next_{c}") for c in columns])
    return out.where("copy = 0").select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in {f"next_{c}" for c in columns}], *[f"next_{c}" for c in columns])


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document with its text edited by the head of the next one, and both fingerprints (the digest columns' source)."""
    n = F.length("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = with_next(with_fingerprint(base), "text", "sketch")
    quarter = F.floor(n / 4).cast("int")
    head = F.coalesce("next_text", F.lit(""))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(head, F.lit(1), quarter))
    return with_fingerprint(base.withColumn("edited", edited), "edited", "edited_sketch")
