"""Conversation prefix trie by smallest-member ownership, without building a trie.

A node is a distinct sequence of first turns; its owner is its smallest member. The nodes that a conversation owns are a
suffix of its path: whoever is smallest among the members of a node is so among those of every node below. So ownership is
one depth a conversation, and what a node's subtree holds follows from its members alone: every node below is passed
once for each of its members and owned once. One group-by over prefixes then sums, over the members, the tokens that they
pass from here on, less the tokens that they own, their owned next node (a child) and their owned childless end (a leaf).

Prefixes are 128-bit running hashes. Positions and running values come from windows over parts of a conversation (its
rows within one range of the sorted table) and a second window over its parts' totals, so no conversation has to
fit in one task. The group-by sums before its shuffle, so a turn that all conversations start with is one row a task.

Rows without conv_id belong to no conversation. A null role or text is empty; null turns come first; rows of one turn are
ordered by role, then text; repeated rows are turns of their own. Texts are read once, for hash and length, whatever
their length. A conversation without turns is a member of the root; an empty table has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SECOND, drop, release, written

#: Ids of members that are joined to one text before they are hashed.
BLOCK = 4096
_ROW = 33  # bits of the row's number within its partition in monotonically_increasing_id


def numbered(conversations: DataFrame) -> DataFrame:
    """Table (conv_id, part, pos, a1, a2, size): each turn's position, two hashes of role and text, and code points of the text."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    ranged = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn")).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    seq = written(ranged.select("conv_id", at.alias("at"), F.xxhash64("role", "text").alias("a1"), F.xxhash64(F.lit(SECOND), "role", "text").alias("a2"), F.length("text").cast("long").alias("size")).withColumn("part", F.shiftright("at", _ROW)))
    parts = seq.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return seq.join(parts, ["conv_id", "part"]).select("conv_id", "part", (F.col("at") - F.col("first") + F.col("done")).alias("pos"), "a1", "a2", "size")


def rebuilt(turns: DataFrame, base_of, head_of, most: int) -> DataFrame:
    """Rows (conv_id, part, depth, a1, a2, size) of the rebuilt conversations, with one of depth 0 for each.

    base_of and head_of give, as columns, the conversation whose first turns are taken and how many (at most `most`).
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", base_of(F.col("conv_id")).alias("base"), head_of(F.col("conv_id")).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    first = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "a1", "a2", "size")
    shape = ["conv_id", "part", "depth", "a1", "a2", "size"]
    zero = F.lit(0).cast("long")
    head = convs.join(first, "base").where("pos < h").select("conv_id", F.lit(-1).cast("long").alias("part"), (F.col("pos") + 1).alias("depth"), "a1", "a2", "size")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "a1", "a2", "size")
    root = convs.select("conv_id", F.lit(-1).cast("long").alias("part"), zero.alias("depth"), zero.alias("a1"), zero.alias("a2"), zero.alias("size"))
    return root.select(*shape).unionAll(head.select(*shape)).unionAll(own.select(*shape))


def paths(rows: DataFrame) -> DataFrame:
    """rows of rebuilt() to (conv_id, depth, size, h1, h2, up1, up2, upto, total, last).

    h: hashes of the first `depth` turns; up: of one turn fewer; upto: code points up to this turn; total and last: those and the
    depth of the whole conversation.
    """
    rows = rows.withColumn("e1", F.when(F.col("depth") > 0, F.xxhash64("depth", "a1", "a2")).otherwise(F.lit(0))).withColumn("e2", F.when(F.col("depth") > 0, F.xxhash64("a2", "depth", "a1")).otherwise(F.lit(0)))
    whole = Window.partitionBy("conv_id", "part")
    run = whole.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = written(rows.select("conv_id", "part", "depth", "size", "e1", "e2", F.expr("bit_xor(e1)").over(run).alias("x1"), F.expr("bit_xor(e2)").over(run).alias("x2"), F.sum("size").over(run).alias("s")))
    totals = local.groupBy("conv_id", "part").agg(F.expr("bit_xor(e1)").alias("t1"), F.expr("bit_xor(e2)").alias("t2"), F.sum("size").alias("t"), F.max("depth").alias("d"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    zero = F.lit(0).cast("long")
    totals = totals.select("conv_id", "part", F.coalesce(F.expr("bit_xor(t1)").over(before), zero).alias("b1"), F.coalesce(F.expr("bit_xor(t2)").over(before), zero).alias("b2"), F.coalesce(F.sum("t").over(before), zero).alias("b"), F.sum("t").over(every).alias("total"), F.max("d").over(every).alias("last"))
    h1, h2 = F.col("x1").bitwiseXOR(F.col("b1")), F.col("x2").bitwiseXOR(F.col("b2"))
    return local.join(totals, ["conv_id", "part"]).select("conv_id", "depth", "size", h1.alias("h1"), h2.alias("h2"), h1.bitwiseXOR(F.col("e1")).alias("up1"), h2.bitwiseXOR(F.col("e2")).alias("up2"), (F.col("s") + F.col("b")).alias("upto"), "total", "last")


_NODE = ["depth", "h1", "h2"]


def _digest(batches):
    """Rows sorted by node and block: SHA-256 of each node's blocks, joined by commas, one block in memory at a time."""
    of, sha = None, None
    for batch in batches:
        out = []
        for depth, h1, h2, ids in zip(*(batch[c].to_pylist() for c in (*_NODE, "ids")), strict=True):
            if (depth, h1, h2) != of:
                if of:
                    out.append((*of, sha.hexdigest()))
                of, sha = (depth, h1, h2), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield _frame(out)
    yield _frame([(*of, sha.hexdigest())] if of else [])


def _frame(rows):
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*_NODE, "ends"])


def ends(steps: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends): SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined."""
    last = steps.where("depth = last").select(*_NODE, "conv_id", F.floor(F.col("conv_id") / BLOCK).alias("block"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = last.groupBy(*_NODE, "block").agg(text.alias("ids"))
    return blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").select(*_NODE, "ids").mapInArrow(_digest, "depth long, h1 long, h2 long, ends string")


def prefix_trie(conversations: DataFrame, base_of, head_of, most: int) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each."""
    spark = conversations.sparkSession
    turns = written(numbered(conversations))
    release(spark)
    steps = written(paths(rebuilt(turns, base_of, head_of, most)))
    drop(turns)
    release(spark)
    nodes = written(steps.groupBy(*_NODE).agg(F.min("conv_id").alias("owner"), F.max("last").alias("deepest"), F.min("upto").alias("upto"), F.min("size").alias("size"), F.min("up1").alias("up1"), F.min("up2").alias("up2")))
    # A conversation owns its path from `since` on; `spent`: code points up to there, that node's excluded; `leaf`: its end has no children.
    owned = nodes.groupBy("owner").agg(F.min("depth").alias("since"), F.min(F.col("upto") - F.col("size")).alias("spent"), F.max("depth").alias("end"), F.max_by("deepest", "depth").alias("deepest"))
    owned = owned.select(F.col("owner").alias("conv_id"), "since", "spent", (F.col("end") == F.col("deepest")).cast("long").alias("leaf"))
    # Only where a conversation's own path begins does the parent belong to another one.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("up1"), F.col("h2").alias("up2"), F.col("owner").alias("parent"))
    begins = nodes.join(owned.select(F.col("conv_id").alias("owner"), F.col("since").alias("depth")), ["owner", "depth"]).select("owner", "depth", "up1", "up2")
    parents = begins.join(above, ["depth", "up1", "up2"]).select(F.col("owner").alias("conv_id"), "parent")
    passed = F.col("total") - F.col("upto") + F.col("size")
    mine = F.col("depth") >= F.col("since")
    marked = steps.join(owned, "conv_id", "left").withColumn("owns", F.when(mine, passed).when(F.col("since").isNotNull(), F.col("total") - F.col("spent")).otherwise(F.lit(0)))
    following = (F.col("depth") < F.col("last")) & (F.col("depth") + 1 >= F.col("since"))
    summed = marked.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min_by("since", "conv_id").alias("since"), F.count("*").alias("n_convs"), F.count(F.when(following, 1)).alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.sum(passed - F.col("owns")).alias("saved_tokens"),
    )
    out = summed.join(ends(steps), _NODE, "left").join(parents, "conv_id", "left")
    parent = F.when(F.col("depth") == 0, F.lit(None).cast("long")).when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
