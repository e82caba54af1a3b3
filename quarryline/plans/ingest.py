"""Queries of the write path: queues, journals, staged writes, single files, ignore rules, blame, containers, capped reads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph, intervals, scan
from ..sources import blame, ignore, store
from ..streaming import breaker as quarantine, journal
from . import projections as P
from .registry import query

S, E, N = P.SYM, P.EDG, P.NODES


@query(
    "WITH RECURSIVE a AS (SELECT user_id % 30 AS workspace, event_id AS id, ts AS \"at\", event_type IN ('error', 'view') AS failed, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id) AS n FROM events), "
    "r AS (SELECT workspace, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, 0 AS streak, CAST(NULL AS TIMESTAMP) AS until, '' AS outcome FROM (SELECT DISTINCT workspace FROM a) "
    "UNION ALL SELECT a.workspace, a.n, a.id, CASE WHEN a.\"at\" < until THEN streak WHEN failed THEN streak + 1 ELSE 0 END, CASE WHEN a.\"at\" < until THEN until WHEN failed AND streak + 1 >= 3 THEN a.\"at\" + INTERVAL 6 HOUR END, "
    "CASE WHEN a.\"at\" < until THEN 'skipped' WHEN NOT failed THEN 'landed' WHEN streak + 1 >= 3 THEN 'opened' ELSE 'failed' END FROM r JOIN a ON a.workspace = r.workspace AND a.n = r.n + 1) "
    "SELECT workspace, id, outcome, streak FROM r WHERE n > 0"
)
def flush_breaker(spark, d):
    e = P.table(spark, d, "events").select((F.col("user_id") % 30).alias("workspace"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").isin("error", "view").alias("failed"))
    return quarantine.outcomes(e, cooldown=6 * 3600).select("workspace", "id", "outcome", "streak")


@query(
    "WITH s AS (SELECT o_custkey % 25 AS file, 'o' || o_orderkey AS id, o_orderkey - low AS a, o_orderkey + low - 1 AS b FROM (SELECT *, CASE WHEN o_orderkey = 0 THEN 1 ELSE o_orderkey & (-o_orderkey) END AS low FROM orders WHERE o_orderstatus IN ('F', 'O'))), "
    "p AS (SELECT DISTINCT l_suppkey % 25 AS file, l_orderkey AS a, l_orderkey + l_linenumber - 1 AS b FROM lineitem), "
    "o AS (SELECT p.file, p.a, p.b, arg_min(s.id, (s.b - s.a, s.a, s.id)) AS owner FROM p JOIN s ON s.file = p.file AND s.a <= p.a AND s.b >= p.b GROUP BY 1, 2, 3) "
    "SELECT l_suppkey % 25 AS file, 'p' || l_partkey AS id, l_orderkey AS start, owner FROM lineitem LEFT JOIN o ON o.file = l_suppkey % 25 AND o.a = l_orderkey AND o.b = l_orderkey + l_linenumber - 1"
)
def call_owners(spark, d):
    """Call sites (order lines) to the innermost function or method (order) around them; the orders of a file nest."""
    k = F.col("o_orderkey")
    low = F.when(k == 0, 1).otherwise(k.bitwiseAND(-k))
    kind = F.when(F.col("o_orderstatus") == "F", "function").when(F.col("o_orderstatus") == "O", "method").otherwise("class")
    symbols = P.table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("file"), F.concat(F.lit("o"), k).alias("id"), kind.alias("kind"), (k - low).alias("start"), (k + low - 1).alias("end"))
    at = F.col("l_orderkey")
    calls = P.table(spark, d, "lineitem").select((F.col("l_suppkey") % 25).alias("file"), F.concat(F.lit("p"), "l_partkey").alias("id"), at.alias("start"), (at + F.col("l_linenumber") - 1).alias("end"))
    return intervals.innermost(calls, symbols).select("file", "id", "start", "owner")


def _blame_log(spark, d):
    """Events as the lines of ten files, in the text form that blame prints."""
    e = P.table(spark, d, "events").withColumn("file", F.concat(F.lit("f"), F.col("event_id") % 10))
    line = lambda k, text: F.struct((F.col("event_id") * 5 + k).alias("n"), text.alias("text"))
    head = F.concat_ws(" ", F.substring(F.md5(F.col("event_id").cast("string")), 1, 12), F.lit("1"), "event_id", F.lit("1"))
    author = F.concat(F.lit("author user "), F.col("user_id") % 17)
    lines = F.array(line(0, head), line(1, author), line(2, F.concat(F.lit("author-mail <"), "user_id", F.lit("@x>"))), line(3, F.concat(F.lit("author-time "), F.unix_timestamp("ts"))), line(4, F.concat(F.lit("\t"), "props")))
    return e.select("file", F.explode(lines).alias("x")).select("file", "x.n", "x.text")


@query("SELECT 'f' || (event_id % 10) AS file, event_id AS line, md5(CAST(event_id AS VARCHAR))[1:12] AS sha, 'user ' || (user_id % 17) AS author, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, props AS content FROM events")
def blame_lines(spark, d):
    return blame.blame_lines(_blame_log(spark, d)).select("file", "line", "sha", "author", F.unix_timestamp("at").alias("seconds"), "content")


@query(
    "WITH l AS (SELECT event_id % 10 AS file, event_id AS line, 'user ' || (user_id % 17) AS author FROM events), s AS (SELECT 'o' || o_orderkey AS id, o_custkey % 10 AS file, o_orderkey AS a, o_orderkey + 40 AS b FROM orders), "
    "f AS (SELECT id, author, min(line) AS line FROM s JOIN l ON l.file = s.file AND line BETWEEN a AND b GROUP BY 1, 2) SELECT id, string_agg(author, ',' ORDER BY line) AS authors FROM f GROUP BY 1"
)
def symbol_authors(spark, d):
    at = F.col("o_orderkey")
    symbols = P.table(spark, d, "orders").select(F.concat(F.lit("o"), at).alias("id"), F.concat(F.lit("f"), F.col("o_custkey") % 10).alias("file"), at.alias("start"), (at + 40).alias("end"))
    return blame.symbol_authors(blame.blame_lines(_blame_log(spark, d)), symbols).select("id", F.array_join("authors", ",").alias("authors"))


def _journal(spark, d):
    """Every turn as a journal line; some are torn, one in thirteen lacks its label, and texts that repeat are pushed again."""
    c = P.table(spark, d, "conversations")
    n = F.col("conv_id") * 1000 + F.col("turn")
    e = c.select(n.alias("n"), F.concat(F.lit("w"), F.col("conv_id") % 3).alias("workspace"), F.concat(F.lit("verbatim:"), F.substring(F.md5("text"), 1, 12)).alias("id"), F.lit("verbatim").alias("type"), F.when(n % 13 != 5, F.concat(F.lit("turn "), n)).alias("label"), F.lit("x").alias("content"), n.alias("enqueued_at"))
    return journal.journal_lines(e).select("n", F.when(F.col("n") % 11 == 3, F.expr("left(line, length(line) - 9)")).otherwise(F.col("line")).alias("line"))


_JOURNAL = "j AS (SELECT conv_id * 1000 + turn AS n, 'w' || (conv_id % 3) AS workspace, 'verbatim:' || md5(text)[1:12] AS id, text IS NOT NULL AND (conv_id * 1000 + turn) % 11 <> 3 AND (conv_id * 1000 + turn) % 13 <> 5 AS valid FROM conversations)"


@query(f"WITH {_JOURNAL} SELECT id, max(n) AS n, arg_max(workspace, n) AS workspace, 'turn ' || max(n) AS label, max(n) AS enqueued_at FROM j WHERE valid GROUP BY id ORDER BY n DESC LIMIT 500")
def journal_replay(spark, d):
    return journal.replay(_journal(spark, d))[0].select("id", "n", "workspace", "label", "enqueued_at")


@query(f"WITH {_JOURNAL} SELECT count(*) FILTER (valid) AS replayed, count(*) FILTER (NOT valid) AS malformed FROM j")
def journal_report(spark, d):
    return journal.replay(_journal(spark, d))[1]


def _store(spark) -> store.Store:
    return store.Store(spark, f"{graph.shared_dir(spark)}/quarryline-store/{uuid.uuid4().hex}")


def _staged(spark, d):
    s = P.symbols(spark, d, complexity=False)
    lost = F.regexp_extract("id", r"(\d+)", 1).cast("int") % 17 == 0
    nodes = s.select("id", F.lit("code_symbol").alias("type"), F.when(~lost, F.col("name")).alias("label"), F.lit("").alias("content"), "file")
    edges = P.edges(spark, d).join(s.select(F.col("id").alias("src"), "file"), "src").select("src", "dst", "kind", "file")
    return nodes, _store(spark).write(nodes, edges)


_REJ = f"{S}, {E}, k AS (SELECT id, file, CAST(substr(id, 2) AS INT) % 17 <> 0 AS good FROM sym), rej AS (SELECT file, 'node' AS item, 'node without label' AS error FROM k WHERE NOT good UNION ALL SELECT a.file, 'edge', CASE WHEN NOT a.good THEN 'source missing' ELSE 'target missing' END FROM edg JOIN k a ON a.id = src JOIN k b ON b.id = dst WHERE NOT (a.good AND b.good))"


@query(f"WITH {_REJ} SELECT file, item, error, count(*) AS n FROM rej GROUP BY 1, 2, 3")
def staged_write(spark, d):
    return _staged(spark, d)[1].groupBy("file", "item", "error").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT doc_id, greatest(doc_id % 6, CASE WHEN doc_id % 7 < 6 THEN doc_id % 7 ELSE 0 END) AS gen FROM documents) SELECT 'n' || doc_id AS id, 'v' || gen AS label, 'src' || (doc_id % 5) AS file FROM g WHERE NOT (doc_id % 9 = 4 AND gen < 4)")
def compacted_nodes(spark, d):
    """Six writes, each of its own documents and of some again, the fifth with removals; folded when five have landed."""
    s = _store(spark)
    x = P.table(spark, d, "documents")
    for k in range(6):
        rows = x.where(f"doc_id % 6 = {k} or doc_id % 7 = {k}").select(F.concat(F.lit("n"), "doc_id").alias("id"), F.lit("document").alias("type"), F.lit(f"v{k}").alias("label"), F.lit("").alias("content"), F.concat(F.lit("src"), F.col("doc_id") % 5).alias("file"))
        gone = x.where("doc_id % 9 = 4").select(F.concat(F.lit("n"), "doc_id").alias("id")) if k == 4 else None
        s.write(rows, spark.createDataFrame([], store.EDGES), gone)
        s.fold()
    return s.nodes().select("id", "label", "file")


def _by_language(spark, d):
    return P.table(spark, d, "documents").select(F.col("lang").alias("type"), "doc_id")


_CAP = 120
_TOP = f"top AS (SELECT lang AS type, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= {_CAP})"


@query(f"WITH {_TOP} SELECT * FROM top")
def capped_nodes(spark, d):
    return scan.capped(_by_language(spark, d), "type", ["doc_id"], _CAP)[0]


@query(f"SELECT lang AS type, CAST(least(count(*), {_CAP}) AS BIGINT) AS kept, count(*) AS total, count(*) > {_CAP} AS truncated FROM documents GROUP BY lang")
def capped_report(spark, d):
    return scan.capped(_by_language(spark, d), "type", ["doc_id"], _CAP)[1]


@query(f"WITH {_TOP} SELECT doc_id AS src, doc_id + 3 AS dst FROM documents WHERE doc_id IN (SELECT doc_id FROM top)")
def capped_edges(spark, d):
    """Edges of the capped export: those whose source is in it, whatever their target."""
    kept = scan.capped(_by_language(spark, d), "type", ["doc_id"], _CAP)[0]
    edges = P.table(spark, d, "documents").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 3).alias("dst"))
    return edges.join(kept.select(F.col("doc_id").alias("src")), "src", "left_semi")


_RULES = {"": ["*.snap", "# comment", "", "!keep.ts", "src1/", "**/en/*7.ts", "fr/*[05].js", "a(b", "src?/de/1*.md"], "src2": ["es/", "*9.ts"], "src3/en": ["/x", "2*"]}


@query(
    "WITH p AS (SELECT DISTINCT source || '/' || coalesce(lang, 'xx') || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.md' ELSE '.snap' END AS path FROM documents) "
    "SELECT path, suffix(path, '.snap') OR starts_with(path, 'src1/') OR regexp_matches(path, '/en/[^/]*7\\.ts$') OR regexp_matches(path, '/fr/[^/]*[05]\\.js$') OR regexp_matches(path, '^src./de/1[^/]*\\.md$') "
    "OR starts_with(path, 'src2/es/') OR regexp_matches(path, '^src2/.*9\\.ts$') OR starts_with(path, 'src3/en/2') AS ignored FROM p"
)
def ignored_paths(spark, d):
    ext = F.element_at(F.array(*map(F.lit, [".ts", ".js", ".md", ".snap"])), (F.col("doc_id") % 4 + 1).cast("int"))
    p = P.table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), "doc_id", ext).alias("path")).distinct()
    return p.select("path", ignore.ignored(F.col("path"), {k: ignore.rules_of("\n".join(v)) for k, v in _RULES.items()}).alias("ignored"))
