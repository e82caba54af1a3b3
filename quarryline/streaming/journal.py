"""The write-ahead journal of the verbatim queue: appended before it is applied, replayed after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that the queue holds; the oldest go first.
CAP = 500
_NODE_FIELDS = ["id", "type", "label", "workspace"]


def journal_lines(entries: DataFrame) -> DataFrame:
    """entries(workspace, id, type, label, content, enqueued_at) as lines `line`, one JSON object each."""
    node = F.struct("id", "type", "label", "workspace", "content")
    return entries.withColumn("line", F.to_json(F.struct("workspace", node.alias("node"), F.col("enqueued_at").alias("enqueuedAt"))))


def append(entries: DataFrame, path: str, batch: int) -> None:
    """Write a batch's lines, in the order of its column n, as the journal's part of that number; written again, it is the same part."""
    journal_lines(entries).select(F.lit(batch).alias("batch"), "n", "line").write.mode("overwrite").json(f"{path}/batch={batch:012d}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a journal folder; n follows the batches and the order within each. A torn line has what is left of it."""
    parts = spark.read.schema("n long, line string").option("columnNameOfCorruptRecord", "torn").json(path)
    return parts.select(F.struct(F.col("batch").cast("long").alias("batch"), "n").alias("n"), "line")


def _text(v, path: str):
    """The string at a path of a variant; null if what is there is no string or an empty one."""
    at = F.variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.nullif(F.variant_get(v, path, "string"), F.lit("")))


def parsed(lines: DataFrame) -> DataFrame:
    """lines(n, line) with valid, workspace, id, type, label, content, enqueued_at; blank lines are left out.

    A line is valid if it is an object with a workspace and a node with id, type, label and workspace, all non-empty strings.
    """
    v = F.try_parse_json("line")
    x = lines.where(F.trim(F.regexp_replace(F.coalesce("line", F.lit("")), r"\s", " ")) != "").withColumn("_v", v)
    v = F.col("_v")
    at = F.variant_get(v, "$.enqueuedAt", "variant")
    number = F.when(F.schema_of_variant(at).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.enqueuedAt", "double"))
    x = x.select(*lines.columns, _text(v, "$.workspace").alias("workspace"), *[_text(v, f"$.node.{f}").alias("of" if f == "workspace" else f) for f in _NODE_FIELDS], F.try_variant_get(v, "$.node.content", "string").alias("content"), number.cast("long").alias("enqueued_at"))
    valid = F.lit(True)
    for c in ("workspace", "id", "type", "label", "of"):
        valid = valid & F.col(c).isNotNull()
    return x.withColumn("valid", valid).drop("of")


def replay(lines: DataFrame, now: int | None = None, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """The queue that a journal leaves, oldest first by `n`, and (replayed, malformed) of its lines.

    Pushing an entry moves its id to the back; beyond the cap the oldest go. What is left after all pushes is the last `cap` ids by
    their last push, since an entry that is once among the oldest stays so until it is pushed again. So one group-by and
    a top-n replace the sequential replay. enqueued_at that is no number is `now`.
    """
    x = parsed(lines)
    report = x.agg(F.count_if("valid").alias("replayed"), F.count_if(~F.col("valid")).alias("malformed"))
    last = x.where("valid").groupBy("id").agg(F.max_by(F.struct("n", "workspace", "type", "label", "content", "enqueued_at"), "n").alias("e"))
    queue = last.select("id", "e.*").withColumn("enqueued_at", F.coalesce("enqueued_at", F.lit(now).cast("long")))
    return queue.orderBy(F.desc("n")).limit(cap), report


def enqueue(path: str, apply, cap: int = CAP):
    """A foreachBatch writer of entries(n, workspace, id, type, label, content, enqueued_at): first the journal, then apply(queue, batch).

    A batch that is run again, because the job died after the journal or within apply, leaves the same journal.
    """

    def write(batch: DataFrame, number: int) -> None:
        append(batch, path, number)
        apply(replay(read(batch.sparkSession, path), cap=cap)[0], number)

    return write
