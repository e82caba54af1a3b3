"""Shared helpers: reading tables, reliable intermediate tables, and a let-binding for expressions."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: \x20 and \x09-\x0D.
SPACE = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs in this process, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='quarryline-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session is already gone; its shared folder goes with it
        pass


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarryline/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarryline_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    delete(df.sparkSession, df._quarryline_path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now rather than at the next driver GC."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of the filter that spares the shuffle of rows without a wanted id; its table has at most a 64th as many rows.
FILTER_BITS = 1 << 23


def _filter(ids: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """Words of a bit filter of ids.key, which may be broadcast at any number of ids, and the condition of a hit."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(at, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    mine = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")
    return F.broadcast(words), (F.shiftright(at, 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(mine) != 0)


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in ids (semi-join); only rows that hit a bit filter of the ids are shuffled."""
    words, hit = _filter(ids, key)
    return docs.join(words, hit, "left_semi").join(ids.select(key), key, "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in ids (anti-join; null keys stay); only rows that hit a bit filter of the ids are shuffled."""
    words, hit = _filter(ids, key)
    return docs.join(words, hit, "left_anti").unionAll(docs.join(words, hit, "left_semi").join(ids.select(key), key, "left_anti").select(*docs.columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: What the second of two hashes starts with.
SECOND = 0x5DEECE66D


def two_hashes(*cols: Column) -> tuple[Column, Column]:
    """128 bits as two independent 64-bit hashes."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(SECOND), *cols)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (long ids): rows (node, root), root the smallest id.

    Alternating large-star and small-star rounds; every round is a table in the shared folder. Only nodes with an edge
    appear. Each round groups by node with partial aggregation and joins back on the node, which AQE may split.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = written(e)
    for _ in range(rounds):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low2.select("u", F.col("m").alias("v")))
        nxt = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = nxt.join(cur, ["u", "v"], "left_anti").limit(1).count() == 0 and cur.join(nxt, ["u", "v"], "left_anti").limit(1).count() == 0
        drop(cur)
        cur = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Values of an integer column that cut its rows into `parts` ranges of about equal size (fewer where values tie)."""
    got = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    return sorted(set(got or []))
