"""Mutations of the node and edge tables as table-to-table functions, and the JSONL ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "ts") -> DataFrame:
    """The newest row of each key; a new row wins over an old one of the same time."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def insert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with accepted: whether both endpoints exist."""
    ids = nodes.select("id").distinct()
    a = ids.select(F.col("id").alias("src"), F.lit(True).alias("_a"))
    b = ids.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select(*edges.columns, (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("accepted"))


def reconcile(nodes: DataFrame, live: DataFrame, repo: str) -> DataFrame:
    """nodes without the file-scoped ones of a repository whose file is no longer there."""
    gone = nodes.where((F.col("repo") == repo) & F.col("file").isNotNull()).join(live, "file", "left_anti").select("id")
    return nodes.join(gone, "id", "left_anti")


def hard_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("id")
    return nodes.join(ids, "id", "left_anti"), edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")


def supersede(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """marks(id, by, at): those nodes become superseded; the first mark by (at, by) counts; a superseded node stays as it is."""
    first = marks.groupBy("id").agg(F.min(F.struct("at", "by")).alias("m"))
    return nodes.join(first, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "m.by")).withColumn("superseded_at", F.coalesce("superseded_at", "m.at")).drop("m")


def union_merge(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key; ours wins."""
    return ours.unionByName(theirs.join(ours.select(*key), key, "left_anti"))


#: Optional fields of a node's line, in order: column and field.
NODE_FIELDS = [("metadata", "metadata"), ("superseded_at", "supersededAt"), ("superseded_by", "supersededBy"), ("superseded_reason", "supersededReason"), ("embedding", "embedding")]


def export_lines(nodes: DataFrame, edges: DataFrame, header: dict[str, str] | None = None) -> DataFrame:
    """Ledger lines (ord, line): a header if wanted, nodes, then edges whose source is exported; JSON with fixed field order.

    Nulls are left out; tags go as one string joined by commas. header: workspace and exported_at; its version is 2 if any
    node has a vector, else 1.
    """
    has = [F.col(c).alias(f) for c, f in NODE_FIELDS if c in nodes.columns]
    tags = [F.array_join("tags", ",").alias("tags")] if "tags" in nodes.columns else []
    n = nodes.select(F.lit(1).alias("ord"), F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "label", "content", *tags, *has)).alias("line"))
    e = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select(F.lit(2).alias("ord"), F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("src").alias("sourceId"), F.col("dst").alias("targetId"), F.col("kind").alias("relation"))).alias("line"))
    out = n.unionByName(e)
    if header:
        vectors = F.max(F.size("embedding")) > 0 if "embedding" in nodes.columns else F.lit(False)
        types = nodes.agg(F.sort_array(F.collect_set("type")).alias("exportedTypes"), F.coalesce(vectors, F.lit(False)).alias("vectors"))  # one row
        top = types.select(F.lit(0).alias("ord"), F.to_json(F.struct(F.when(F.col("vectors"), 2).otherwise(1).alias("version"), F.lit(header["exported_at"]).alias("exportedAt"), F.lit(header["workspace"]).alias("sourceWorkspace"), "exportedTypes")).alias("line"))
        out = top.unionByName(out)
    return out


LINE = "kind string, id string, type string, label string, content string, tags string, metadata string, supersededAt string, supersededBy string, supersededReason string, embedding array<double>, sourceId string, targetId string, relation string, version int"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parsed ledger lines (line): status node, edge, header, skipped (unknown kind) or error (not JSON)."""
    x = lines.withColumn("x", F.from_json("line", LINE))
    bad = F.col("x").isNull() | ~F.col("line").startswith("{") | F.coalesce(F.get_json_object("line", "$.kind").isNull() & F.get_json_object("line", "$.version").isNull(), F.lit(True))
    status = F.when(bad, "error").when(F.col("x.kind").isin("node", "edge"), F.col("x.kind")).when(F.col("x.version").isin(1, 2), "header").otherwise("skipped")
    return x.select("line", status.alias("status"), "x.*")


def import_nodes(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, outcome) of the nodes of a ledger: new, or replaced where the store has the id already; a repeated id counts once."""
    ids = parsed.where("status = 'node' and id is not null").select("id").distinct()
    return ids.join(existing.select("id", F.lit(True).alias("known")).distinct(), "id", "left").select("id", F.when(F.col("known"), "replaced").otherwise("new").alias("outcome"))


def append(prior: DataFrame, added: DataFrame) -> DataFrame:
    """Ledger rows after an append: a new line of an id wins; nothing is added if any new line lacks kind or id."""
    bad = added.where("kind is null or (kind = 'node' and id is null) or (kind = 'edge' and (sourceId is null or targetId is null))")
    if bad.limit(1).count():
        raise ValueError("a ledger line without its kind or ids")
    key = F.when(F.col("kind") == "node", F.col("id")).otherwise(F.concat_ws("\x01", "sourceId", "targetId", "relation"))
    old, new = prior.withColumn("_key", key), added.withColumn("_key", key).dropDuplicates(["kind", "_key"])
    return union_merge(new, old, ["kind", "_key"]).drop("_key")


def import_outcomes(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges of a ledger with outcome ok or deferred (an endpoint is neither in the ledger nor in the store)."""
    ids = parsed.where("status = 'node'").select("id").unionByName(existing.select("id")).distinct()
    e = parsed.where("status = 'edge'").select(F.col("sourceId").alias("src"), F.col("targetId").alias("dst"), F.col("relation").alias("kind"))
    return insert_edges(e, ids).select("src", "dst", "kind", F.when(F.col("accepted"), "ok").otherwise("deferred").alias("outcome"))


def restore_supersedes(parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, by, reason, outcome) of a ledger's superseded nodes, after its nodes are in and before its edges.

    A node line with supersededAt and supersededBy is restored where the replacement is known by then, in the ledger or the store; otherwise the
    outcome is an error and the node stays as it was written. Lines without either are left alone; of several lines of an id the last by text counts.
    """
    lines = parsed.where("status = 'node' and coalesce(id, '') <> ''")
    known = lines.select("id").unionByName(existing.select("id")).distinct().select(F.col("id").alias("by"), F.lit(True).alias("_known"))
    marked = lines.where("coalesce(supersededAt, '') <> '' and supersededBy is not null")
    last = marked.groupBy("id").agg(F.max_by(F.struct(F.col("supersededBy").alias("by"), F.col("supersededReason").alias("reason")), "line").alias("m")).select("id", "m.*")
    return last.join(known, "by", "left").select("id", "by", "reason", F.when(F.col("_known"), "restored").otherwise("error").alias("outcome"))


def collisions(members: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, n): ids that several members have."""
    both = reduce(DataFrame.unionByName, [df.select("id", F.lit(name).alias("member")) for name, df in members])
    return both.groupBy("id").agg(F.countDistinct("member").alias("n")).where("n > 1")


def first_owner(rows: DataFrame) -> DataFrame:
    """rows(id, member_ord, ...): only those of the first member that has the id."""
    own = rows.groupBy("id").agg(F.min("member_ord").alias("_m"))
    return rows.join(own, "id").where("member_ord = _m").drop("_m")


def manifest_diff(saved: DataFrame, current: DataFrame) -> DataFrame:
    """(file, change) between two listings (file, mtime, size): added, changed, removed, same."""
    a, b = saved.select("file", F.struct("mtime", "size").alias("a")), current.select("file", F.struct("mtime", "size").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", change.alias("change"))
