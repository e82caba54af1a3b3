"""Intervals that cover a place: the innermost one of each point, and all that cover a line.

A file is cut into blocks of positions. An interval goes to every block that it meets, a point to the one where it
starts, so a file with most of the rows is spread over its blocks. No point is paired with all the intervals of its file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions in a block.
BLOCK = 4096


def _blocks(df: DataFrame, width: int) -> DataFrame:
    return df.where("start <= end").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def innermost(points: DataFrame, intervals: DataFrame, kinds: tuple[str, ...] | None = ("function", "method"), width: int = BLOCK) -> DataFrame:
    """points(file, id, start, end) with owner: the shortest interval(file, id, kind, start, end) of these kinds that covers it, else null.

    Among equally short ones the first by start, then id. Ends are inclusive. Each block is swept once in order of
    position; what it holds is the intervals open at the place. Points without file or start, or of negative length, have no owner.
    """
    if kinds is not None:
        intervals = intervals.where(F.col("kind").isin(*kinds))
    cast = lambda c: F.col(c).cast("long").alias(c)
    who = F.col("id").cast("string").alias("id")
    opening = _blocks(intervals.select("file", who, cast("start"), cast("end")), width).where("file is not null")
    points = points.withColumn("start", cast("start")).withColumn("end", cast("end"))
    good = (F.col("file").isNotNull() & (F.col("start") <= F.col("end"))).alias("_good")
    asked = points.where(good).select("file", who, "start", "end", F.floor(F.col("start") / width).alias("_block")).distinct()
    both = opening.withColumn("_point", F.lit(0)).unionByName(asked.withColumn("_point", F.lit(1)))

    def sweep(batches):
        of, open_ = None, []
        for batch in batches:
            out = []
            for file, block, point, name, start, end in zip(*(batch[c].to_pylist() for c in ("file", "_block", "_point", "id", "start", "end")), strict=True):
                if (file, block) != of:
                    of, open_ = (file, block), []
                if not point:
                    open_.append((end - start, start, name, end))
                    continue
                open_ = [x for x in open_ if x[3] >= start]
                best = min((x for x in open_ if x[3] >= end), default=None)
                if best:
                    out.append((file, name, start, end, best[2]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch["file"].type, pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "id", "start", "end", "owner"])

    kind = dict(intervals.dtypes)["file"]
    ordered = both.repartition("file", "_block").sortWithinPartitions("file", "_block", "start", "_point", "id")
    owners = ordered.select("file", "_block", "_point", "id", "start", "end").mapInArrow(sweep, f"file {kind}, id string, start long, end long, owner string")
    p = points.withColumn("_key", who).alias("p")
    o = owners.withColumnRenamed("id", "_key").alias("o")
    on = [F.col(f"p.{c}") == F.col(f"o.{c}") for c in ("file", "_key", "start", "end")]
    return p.join(o, on, "left").select(*[F.col(f"p.{c}") for c in points.columns], "o.owner")


def covering(lines: DataFrame, intervals: DataFrame, width: int = 64) -> DataFrame:
    """lines(file, line, ...) with the id of every interval(file, id, start, end) over it, one row for each."""
    spans = _blocks(intervals.select("file", F.col("id").alias("owner"), "start", "end"), width)
    at = lines.withColumn("_block", F.floor(F.col("line") / width))
    both = at.join(spans, ["file", "_block"]).where("line between start and end")
    return both.select(*lines.columns, "owner")
