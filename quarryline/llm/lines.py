"""Line deduplication over levelled sorted runs of line keys.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased, held as 128 bits of hash. Each batch
counts its keys' documents (a key counts once a row), anti-joins the keys that the runs already know to be frequent,
and adds the rest as a new sorted run; when a level holds FANOUT runs they are merged into one of the next level, equal
keys being added up. Lines whose key is found in at least `min_documents` documents go from every document.

The lines are dropped where the text is: up to BROADCAST_KEYS frequent keys go to every task, so texts are never
shuffled. More keys than that are joined by shuffle with the lines of each text, known by a 128-bit hash of it.

Null or empty text is one empty line; keys of no code point are never dropped; repeated rows, also of one doc_id, count
as documents of their own; a key is frequent at exactly `min_documents` too. A text is handled whole, one row in memory
at a time and about three times its size. Other columns pass through, but for `n_lines` and `n_dropped`, which are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import SECOND, drop, let, lower_ascii, two_hashes, written

MIN_DOCUMENTS, BATCHES, FANOUT = 10, 4, 3
#: The frequent keys are broadcast up to this many (16 bytes each), else joined by shuffle.
BROADCAST_KEYS = 200_000
#: Rows of a slice that a task holds as Python objects.
ROWS = 500


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


class LineRuns:
    """Levels of immutable runs (h1, h2, n) of line keys and the documents they were found in."""

    def __init__(self, spark: SparkSession, min_documents: int = MIN_DOCUMENTS, fanout: int = FANOUT):
        self.spark, self.min_documents, self.fanout = spark, min_documents, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return (self._merged(runs) if len(runs) > 1 else runs[0]).where(F.col("n") >= self.min_documents).select("h1", "h2")

    def add(self, counts: DataFrame) -> None:
        """Add a batch of (h1, h2, n), one row a key."""
        if self.runs():
            counts = counts.join(self.frequent(), ["h1", "h2"], "left_anti")
        self.levels[0].append(written(counts.sortWithinPartitions("h1", "h2")))
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = written(self._merged(level).sortWithinPartitions("h1", "h2"))
                for run in level:
                    drop(run)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)


def frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(h1, h2) of the keys found in at least min_documents rows, through the levelled runs."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: k != ""))
    h1, h2 = two_hashes(F.col("key"))
    one = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("key")).select("batch", h1.alias("h1"), h2.alias("h2"))
    staged = written(one.groupBy("batch", "h1", "h2").agg(F.count("*").alias("n")), "batch")
    index = LineRuns(docs.sparkSession, min_documents)
    for b in range(batches):
        index.add(staged.where(F.col("batch") == b).select("h1", "h2", "n"))
    out = written(index.frequent())
    for run in index.runs():
        drop(run)
    drop(staged)
    return out


def _where_the_text_is(docs: DataFrame, frequent: dict[int, set[int]]) -> DataFrame:
    """The lines dropped by tasks that all hold the frequent keys, by the first hash."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)
    fields = [StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]
    schema = StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    seed = xxh64_intdigest(struct.pack("<q", SECOND), 42)
    at = docs.columns.index("text")

    def run(batches):
        known = shared.value

        def common(line: bytes) -> bool:
            key = line.strip(b" \t\n\x0b\x0c\r").lower()
            return bool(key) and (second := known.get(xxh64_intdigest(key, 42))) is not None and xxh64_intdigest(key, seed) in second

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts, sizes, gone = [], [], []
                for raw in part.column(at).cast(pa.large_binary()).to_pylist():
                    raw = raw or b""
                    lines = raw.split(b"\n")
                    kept = [line for line in lines if not common(line)]
                    texts.append(raw if len(kept) == len(lines) else b"\n".join(kept))
                    sizes.append(len(lines))
                    gone.append(len(lines) - len(kept))
                columns = part.columns
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _by_join(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """The lines dropped by a join of every text's lines with the frequent keys; copies of a text count once in it."""
    t1, t2 = two_hashes(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"), t1.alias("t1"), t2.alias("t2"))
    lines = rows.select("t1", "t2", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).select("t1", "t2", "at", key_of(F.col("line")).alias("key")).where("key <> ''")
    h1, h2 = two_hashes(F.col("key"))
    drops = lines.select("t1", "t2", "at", h1.alias("h1"), h2.alias("h2")).distinct().join(frequent, ["h1", "h2"]).groupBy("t1", "t2").agg(F.collect_set("at").alias("drops"))
    split = lines_of(F.col("text"))
    hit = F.col("drops").isNotNull()
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drops"))
    kept = let(split, lambda ls: F.array_join(F.transform(kept_at, lambda i: F.get(ls, i)), "\n"))
    out = rows.join(drops, ["t1", "t2"], "left")
    columns = [F.when(hit, kept).otherwise(F.col("text")).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """docs with text replaced by the kept lines, plus n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    frequent = frequent_lines(docs, min_documents, batches)
    if frequent.count() > BROADCAST_KEYS:
        return _by_join(docs, frequent)
    known: dict[int, set[int]] = {}
    for h1, h2 in frequent.collect():  # at most BROADCAST_KEYS rows
        known.setdefault(h1 % (1 << 64), set()).add(h2 % (1 << 64))
    return _where_the_text_is(docs, known)
