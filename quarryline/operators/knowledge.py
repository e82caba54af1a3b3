"""Recall over the knowledge ledger: lists, keyword and vector search, verbatim status, neighbours, context blocks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import has_tags, occurrences, snippet


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("superseded_at").isNull() & ~F.col("id").startswith("knowledge:tombstone:"))


def listing(nodes: DataFrame, types: list[str], tags: list[str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of live nodes by id, with the total."""
    got = live(nodes).where(F.col("type").isin(types) & has_tags(F.col("tags"), tags or []))
    total = got.agg(F.count("*").alias("total"))
    return got.orderBy("id").offset(offset).limit(min(limit, 500)).join(F.broadcast(total)).select("id", "type", "label", "total")  # total: one row


def keyword_score(tokens: list[str]) -> Column:
    each = [3 * occurrences(F.lower("label"), t) + 2 * occurrences(F.lower(F.array_join("tags", " ")), t) + occurrences(F.lower("content"), t) for t in tokens]
    return reduce(lambda a, b: a + b, each) if each else F.lit(0)


def tokens_of(query: str) -> list[str]:
    """Lower-cased runs of letters, digits, _ and -; a token may repeat and then counts again."""
    return [t for t in re.split(r"[^\w-]+", query.lower()) if t]


def keyword_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score): occurrences of the query's tokens, label 3, tags 2, content 1; best first, then by id."""
    return live(nodes).withColumn("score", keyword_score(tokens_of(query))).where("score > 0").orderBy(F.desc("score"), "id").select("id", "score").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(F.size(a) == F.size(b), dot / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def semantic(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """(id, score): the nearest vectors by cosine; vectors with other than finite values do not count."""
    q = F.array(*[F.lit(float(x)) for x in query])
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(finite).select("id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(limit)


def fuse(lists: list[DataFrame], k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of top lists (id, score)."""
    w = Window.orderBy(F.desc("score"), "id")  # over lists of at most a page
    ranked = [df.select("id", (1.0 / (k + F.row_number().over(w))).alias("r")) for df in lists]
    return reduce(DataFrame.unionByName, ranked).groupBy("id").agg(F.round(F.sum("r"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def recall(vectors: DataFrame, nodes: DataFrame, query: list[float], types: list[str], most: int = 10) -> DataFrame:
    """Over-fetch, drop what is superseded, knowledge types before others, cut, with snippets."""
    near = semantic(vectors, query, min(5 * most, 100))
    got = near.join(live(nodes), "id").withColumn("other", (~F.col("type").isin(types)).cast("int"))
    return got.orderBy("other", F.desc("score"), "id").limit(most).select("id", "type", "score", snippet(F.col("content")).alias("snippet"))


def verbatim_status(entries: DataFrame, supersedes: DataFrame) -> DataFrame:
    """entries(id, topics, at), supersedes(src, dst): current, superseded-by or outdated-by the newest later one on a topic.

    The newest entry of a topic outdates the others, so no pairs are formed: the maximum by topic decides.
    """
    by_topic = entries.select("id", "at", F.explode("topics").alias("topic"))
    newest = by_topic.groupBy("topic").agg(F.max(F.struct("at", "id")).alias("top"))
    later = by_topic.join(newest, "topic").where("top.at > at").groupBy("id").agg(F.max("top").alias("top"))
    gone = supersedes.join(entries.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("by"))
    out = entries.join(gone, "id", "left").join(later, "id", "left")
    status = F.when(F.col("by").isNotNull(), F.concat(F.lit("superseded-by:"), "by")).when(F.col("top").isNotNull(), F.concat(F.lit("outdated-by:"), "top.id", F.lit(" (by time)"))).otherwise(F.lit("current"))
    return out.select("id", "at", status.alias("status"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "kind", F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("id"), "kind", F.lit("in").alias("direction")))


def unbacked(nodes: DataFrame, edges: DataFrame, backing: DataFrame) -> DataFrame:
    """Live decisions with no edge, either way, to a backing node."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    backed = both.join(backing.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
    return live(nodes).where("type = 'decision'").join(backed, "id", "left_anti").select("id")


def context_block(ranked: DataFrame, most: int = 8000) -> DataFrame:
    """ranked(rank, id, content), at most a few pages: the longest prefix by rank that fits, with how many were left out."""
    w = Window.orderBy("rank")
    run = ranked.withColumn("total", F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = run.agg(F.count(F.when(F.col("total") > most, 1)).alias("omitted"))
    return run.where(F.col("total") <= most).join(F.broadcast(left)).select("rank", "id", F.col("total").cast("long").alias("total"), "omitted")  # one row


#: Intents in order: (pattern, tool).
INTENTS = [("who calls|callers of", "call_graph"), ("what breaks|impact|blast", "blast_radius"), ("dead|unused", "find_dead_code"), ("hot ?spot|complex", "hotspots"), ("drift|schema", "schema_drift"), ("decision|convention|why", "knowledge_search")]


def route(text: Column) -> Column:
    out: Column | None = None
    for pattern, tool in INTENTS:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, tool) if out is None else out.when(hit, tool)
    return out.otherwise(F.lit("knowledge_recall"))


def verbatim_recall(entries: DataFrame, supersedes: DataFrame, limit: int = 50) -> DataFrame:
    """Entries tagged verbatim with their status: current first, newest first, then by id; at most `limit` (500 at most)."""
    got = verbatim_status(entries, supersedes)
    return got.orderBy((F.col("status") != "current").cast("int"), F.desc("at"), "id").limit(min(max(limit, 0), 500))


def walk(edges: DataFrame, nodes: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    """(id, kind, direction, type, label) of one hop either way; a self-loop counts as out; an end without a node has nulls."""
    kept = edges if relation is None else edges.where(F.col("kind") == relation)
    near = neighbours(kept, node).where((F.col("id") != node) | (F.col("direction") == "out"))
    return near.join(nodes.select("id", "type", "label"), "id", "left")


def edge_exists(edges: DataFrame, src: str, dst: str, kind: str) -> bool:
    return edges.where((F.col("src") == src) & (F.col("dst") == dst) & (F.col("kind") == kind)).limit(1).count() > 0


#: Types of knowledge nodes.
TYPES = ("architecture", "bug_pattern", "convention", "decision", "troubleshooting")


def check_types(types: list[str]) -> list[str]:
    unknown = [t for t in types if t not in TYPES]
    if unknown:
        raise ValueError(f"invalid_arguments: unknown type {', '.join(unknown)}")
    return types


def check_arguments(given: dict, required: dict[str, type], optional: dict[str, type] | None = None, most: int = 500) -> dict:
    """Arguments of a tool: what is required is there, numbers and booleans are coerced, limits are clamped."""
    out = {}
    for name, kind in {**required, **(optional or {})}.items():
        value = given.get(name)
        if value is None:
            if name in required:
                raise ValueError(f"invalid_arguments: {name} is required")
            continue
        if kind is bool and isinstance(value, str):
            value = value.lower() == "true"
        try:
            value = kind(value)
        except (TypeError, ValueError):
            raise ValueError(f"invalid_arguments: {name} is no {kind.__name__}") from None
        out[name] = max(1, min(value, most)) if name in ("limit", "max") else value
    return out


def path_allowed(path: str, roots: list[str]) -> bool:
    """Whether a path without `..` is one of the roots or under one."""
    return ".." not in path.split("/") and any(path == r.rstrip("/") or path.startswith(r.rstrip("/") + "/") for r in roots)


#: A definition's keyword and the name after it.
DEFINITION = r"\b(?:function|class|interface|def|fn|func|type|struct|enum|trait|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"


def defined_name(text: Column) -> Column:
    """The first name that a text defines, else null."""
    name = F.regexp_extract(text, DEFINITION, 1)
    return F.when(name != "", name)


def asked_symbol(text: Column) -> Column:
    """The symbol that a question names: in backticks, else in quotes, else the first capitalised word after the first."""
    out = None
    for pattern in (r"`([^`]+)`", r"[\"']([^\"']+)[\"']", r"\s([A-Z][A-Za-z0-9_.]+)"):
        found = F.regexp_extract(text, pattern, 1)
        out = F.when(found != "", found) if out is None else out.when(found != "", found)
    return out
