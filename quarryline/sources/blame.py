"""Line histories: the porcelain text of `git blame` to rows, and the authors of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import covering
from ..operators.scan import carried

#: First line of a block: commit, line in the original, line in the final file. Fixed values of the format.
_HEADER = r"^([0-9a-f]{7,40})\s+(\d+)\s+(\d+)"
#: Lines of a log that one window holds.
BLOCK = 65_536


def blame_lines(log: DataFrame) -> DataFrame:
    """log(file, n, text), n the number of the text line, to (file, line, sha, author, at, content).

    A block reaches from its header to the next one; of several author, author-time or content lines its last counts. Blocks without a content
    line, and lines before the first header, give no row. An author-time that is no number is null.
    """
    x = log.select("file", "n", "text", F.when(F.col("text").rlike(_HEADER), F.col("n")).alias("_head"))
    x = carried(x, ["file"], F.floor(F.col("n") / BLOCK), ["n"], F.col("_head"), "_start").where("_start is not null")
    last = lambda starts: F.max_by("text", F.when(F.col("_head").isNull() & F.col("text").startswith(starts), F.col("n")))
    got = x.groupBy("file", "_start").agg(F.max_by("text", F.when(F.col("_head").isNotNull(), F.col("n"))).alias("_header"), last("author ").alias("_author"), last("author-time ").alias("_time"), last("\t").alias("_content"))
    seconds = F.regexp_extract("_time", r"^author-time\s+(-?\d+)", 1).try_cast("long")
    return got.where("_content is not null").select(
        "file", F.regexp_extract("_header", _HEADER, 3).cast("long").alias("line"), F.regexp_extract("_header", _HEADER, 1).alias("sha"),
        F.expr("substring(_author, 8)").alias("author"), F.timestamp_seconds(seconds).alias("at"), F.expr("substring(_content, 2)").alias("content"),
    )


def symbol_authors(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, authors) of symbols(id, file, start, end): who wrote its lines, in order of the first of each."""
    named = covering(lines.where("author <> ''").select("file", "line", "author"), symbols)
    first = named.groupBy("owner", "author").agg(F.min("line").alias("line"))
    return first.groupBy(F.col("owner").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "author"))), lambda x: x["author"]).alias("authors"))
