"""Queries of the index path and of graph reads: node and edge building, import edges, context relations, expansion, convergent ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import communities, graph, knowledge, ledger, resolve, views
from ..streaming import progress
from . import projections as P
from .registry import query

S, E, N = P.SYM, P.EDG, P.NODES

_FILES = "fl AS (SELECT doc_id, 'm' || doc_id || '.ts' AS file, CASE WHEN doc_id % 6 <> 0 THEN 'm' || (doc_id * 7 % (SELECT count(*) FROM documents)) || '.ts' END AS target FROM documents)"
_SYMS = "sy AS (SELECT 'm' || doc_id || '.ts' AS file, name, 'm' || doc_id || ':' || name AS id FROM (SELECT doc_id, unnest(['f0', 'f1', 'default']) AS name FROM documents) WHERE name = 'f1' OR (name = 'f0' AND doc_id % 2 = 0) OR (name = 'default' AND doc_id % 3 = 0))"


@query(
    f"WITH {_FILES}, {_SYMS}, i AS (SELECT file, './x' || (doc_id % 50) AS specifier, target, doc_id % 3 = 0 AS named, doc_id % 4 = 1 AS dflt, doc_id % 5 = 2 AS ns FROM fl), r AS ("
    "SELECT 'file:' || i.file AS src, sy.id AS dst, 1.0::DOUBLE AS confidence FROM i JOIN sy ON sy.file = i.target AND sy.name IN ('f0', 'f1') WHERE named "
    "UNION SELECT 'file:' || i.file, coalesce(sy.id, 'file:' || i.target), 0.9 FROM i LEFT JOIN sy ON sy.file = i.target AND sy.name = 'default' WHERE dflt AND target IS NOT NULL "
    "UNION SELECT 'file:' || file, 'file:' || target, 0.9 FROM i WHERE ns AND target IS NOT NULL UNION SELECT 'file:' || file, 'file:' || target, 0.8 FROM i WHERE NOT named AND NOT dflt AND NOT ns AND target IS NOT NULL "
    "UNION SELECT 'file:' || file, 'import:' || specifier, 0.9 FROM i WHERE target IS NULL) SELECT src, dst, 'imports' AS kind, confidence FROM r"
)
def import_edges(spark, d):
    x = P.table(spark, d, "documents").select("doc_id")
    file = lambda c: F.concat(F.lit("m"), c, F.lit(".ts"))
    i = F.col("doc_id")
    imports = x.select(file(i).alias("file"), F.concat(F.lit("./x"), i % 50).alias("specifier"), F.when(i % 6 != 0, file(i * 7 % x.count())).alias("target_file"), F.when(i % 3 == 0, F.array(F.lit("f0"), F.lit("f1"))).alias("named"), F.when(i % 4 == 1, "d").alias("default_alias"), F.when(i % 5 == 2, "ns").alias("namespace_alias"))
    names = x.select("doc_id", F.explode(F.array(F.lit("f0"), F.lit("f1"), F.lit("default"))).alias("name")).where("name = 'f1' or (name = 'f0' and doc_id % 2 = 0) or (name = 'default' and doc_id % 3 = 0)")
    return resolve.import_edges(imports, names.select(file(i).alias("file"), "name", F.concat(F.lit("m"), i, F.lit(":"), "name").alias("id")))


def _stored(spark, d):
    """Symbols and relations of one repository as they are stored: some relations start at a file or end at a package."""
    s = P.symbols(spark, d).select("id", "file", F.concat(F.lit("r/"), "file", F.lit(":"), "id").alias("uid"))
    e = P.edges(spark, d).join(s.select(F.col("id").alias("src"), F.col("uid").alias("a"), F.col("file").alias("fa")), "src").join(s.select(F.col("id").alias("dst"), F.col("uid").alias("b")), "dst")
    relations = e.select(F.when(F.col("src").startswith("s"), F.concat(F.lit("file:"), "fa")).otherwise(F.col("a")).alias("src"), F.when(F.col("kind") == "extends", F.concat(F.lit("import:pkg"), F.length("dst"))).otherwise(F.col("b")).alias("dst"), "kind")
    return s, relations


_STORED = (
    f"{S}, {E}, u AS (SELECT id, file, 'r/' || file || ':' || id AS uid FROM sym), rel AS (SELECT CASE WHEN starts_with(src, 's') THEN 'code-file:r/' || a.file ELSE 'code-symbol:' || a.uid END AS src, CASE WHEN edg.kind = 'extends' THEN 'code-import:pkg' || length(dst) ELSE 'code-symbol:' || b.uid END AS dst, edg.kind FROM edg JOIN u a ON a.id = src JOIN u b ON b.id = dst), "
    "st AS (SELECT 'code-file:r/' || file AS src, 'code-symbol:' || uid AS dst, 'contains' AS kind FROM u UNION SELECT * FROM rel)"
)


@query(f"WITH {_STORED} SELECT * FROM st")
def stored_edges(spark, d):
    s, relations = _stored(spark, d)
    return views.stored_edges(s, relations, "r")


@query(f"WITH {_STORED} SELECT DISTINCT CASE WHEN starts_with(src, 'code-symbol:') THEN src[13:] ELSE 'file:' || src[13:] END AS src, dst[13:] AS dst, kind FROM st WHERE starts_with(dst, 'code-symbol:') AND (starts_with(src, 'code-symbol:') OR (starts_with(src, 'code-file:') AND kind = 'imports'))")
def context_relations(spark, d):
    """The relations that are recovered from the stored edges; a file's path is without its repository."""
    s, relations = _stored(spark, d)
    return resolve.code_relations(views.stored_edges(s, relations, "r"))


@query(f"WITH {S}, {E}, r AS (SELECT CASE WHEN starts_with(src, 's') THEN 'file:x/' || src ELSE src END AS src, dst, kind FROM edg) SELECT CASE WHEN starts_with(r.src, 'file:') THEN r.src[6:] ELSE file END AS file, r.kind, count(*) AS n FROM r LEFT JOIN sym ON sym.id = r.src GROUP BY 1, 2")
def relations_by_file(spark, d):
    e = P.edges(spark, d).withColumn("src", F.when(F.col("src").startswith("s"), F.concat(F.lit("file:x/"), "src")).otherwise(F.col("src")))
    return views.relations_by_file(e, P.symbols(spark, d)).groupBy("file", "kind").agg(F.count("*").alias("n"))


@query(
    f"WITH {S} SELECT 'code-file:r/' || path AS id, 'code_file' AS type, path AS label, language, loc, size_bytes FROM (SELECT source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.txt' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'python' END AS language, "
    "CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(translate(l, chr(9) || chr(13), '  ')) <> '')) AS INT) AS loc, strlen(text) AS size_bytes FROM documents) UNION ALL SELECT 'code-symbol:' || id, 'code_symbol', name, NULL, 0, complexity FROM sym"
)
def code_nodes(spark, d):
    """File nodes of the documents and symbol nodes of the trade graph, as one table of stored nodes."""
    path = F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".txt"))
    files = P.table(spark, d, "documents").select(path.alias("file"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))
    symbols = views.symbol_nodes(P.symbols(spark, d).select(F.col("id").alias("uid"), "name", F.col("complexity").cast("long").alias("size_bytes")))
    shape = ["id", "type", "label", "language", "loc", "size_bytes"]
    return views.file_nodes(files.withColumn("language", X.language_of(F.col("file"))), "r").select(*shape).unionByName(symbols.select("id", "type", "label", "size_bytes"), allowMissingColumns=True).withColumn("loc", F.coalesce("loc", F.lit(0))).select(*shape)


@query(f"WITH {E}, n AS (SELECT dst AS id FROM edg WHERE src = 's2' UNION SELECT src FROM edg WHERE dst = 's2') SELECT 's2' AS id, NULL AS parent UNION ALL SELECT * FROM (SELECT id, 's2' AS parent FROM n WHERE id <> 's2' ORDER BY id LIMIT 200)")
def expand_node(spark, d):
    shown = spark.createDataFrame([("s2", None)], "id string, parent string")
    return views.expand(shown, P.edges(spark, d), "s2")


@query("WITH RECURSIVE t AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey >= 10 THEN CAST(o_orderkey // 10 AS VARCHAR) END AS parent FROM orders), g AS (SELECT id FROM t WHERE parent = '7' UNION ALL SELECT t.id FROM g JOIN t ON t.parent = g.id) SELECT * FROM t WHERE id NOT IN (SELECT id FROM g)")
def collapse_node(spark, d):
    """Orders as a tree of decimal prefixes: closing 7 takes all orders that start with a 7."""
    k = F.col("o_orderkey")
    shown = P.table(spark, d, "orders").select(k.cast("string").alias("id"), F.when(k >= 10, F.floor(k / 10).cast("string")).alias("parent")).distinct()
    return views.collapse(shown, "7")


@query(f"WITH {N}, {E}, x AS (SELECT dst AS id, kind, 'out' AS direction FROM edg WHERE src = 's2' AND kind = 'calls' UNION ALL SELECT src, kind, 'in' FROM edg WHERE dst = 's2' AND src <> 's2' AND kind = 'calls') SELECT x.*, CASE WHEN id LIKE 'c%' THEN 'customer' END AS type, CASE WHEN id LIKE 'c%' THEN c_name END AS label FROM x LEFT JOIN customer ON x.id = 'c' || c_custkey")
def walk(spark, d):
    nodes = P.table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("type"), F.col("c_name").alias("label"))
    return knowledge.walk(P.edges(spark, d), nodes, "s2", "calls")


@query(f"WITH {S}, {E}, k AS (SELECT CASE WHEN kind = 'extends' THEN 'contains' ELSE kind END AS kind, CASE WHEN dst IN ('s1', 's3') THEN 'code-folder:' || dst ELSE dst END AS dst, src FROM edg) SELECT a.file AS src, b.file AS dst, count(*) AS n FROM k JOIN sym a ON a.id = k.src JOIN sym b ON b.id = k.dst WHERE k.kind <> 'contains' AND a.file <> b.file GROUP BY 1, 2")
def coupling_edges(spark, d):
    """File-to-file edges for communities; containment and folders do not couple."""
    e = P.edges(spark, d).select("src", F.when(F.col("dst").isin("s1", "s3"), F.concat(F.lit("code-folder:"), "dst")).otherwise(F.col("dst")).alias("dst"), F.when(F.col("kind") == "extends", "contains").otherwise(F.col("kind")).alias("kind"))
    s = P.symbols(spark, d).select("id", "file")
    folders = s.where("id in ('s1', 's3')").select(F.concat(F.lit("code-folder:"), "id").alias("id"), "file")
    return communities.coupling_edges(e, s.unionByName(folders)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_matches(path, '\\.(test|spec)\\.[cm]?[jt]sx?$|(^|/)(__tests__|__mocks__|__fixtures__|__snapshots__)(/|$)|(^|/)e2e(/|$)|\\.snap$') AS test, regexp_extract(text, '([A-Z][a-z]+)', 1) AS name, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'a/e2e/x.ts' WHEN 1 THEN 'a/b.spec.mjs' WHEN 2 THEN '__mocks__/z.py' WHEN 3 THEN 'src/latest.ts' ELSE 'e2ex/y.snap' END AS path, ' ' || source || ', ,' || coalesce(lang, '') || ' ,' || source AS tags FROM documents)")
def path_and_tag_facts(spark, d):
    path = F.element_at(F.array(*map(F.lit, ["a/e2e/x.ts", "a/b.spec.mjs", "__mocks__/z.py", "src/latest.ts", "e2ex/y.snap"])), (F.col("doc_id") % 5 + 1).cast("int"))
    tags = F.concat(F.lit(" "), "source", F.lit(", ,"), F.coalesce("lang", F.lit("")), F.lit(" ,"), "source")
    name = knowledge.defined_name(F.concat(F.lit("class "), F.regexp_extract("text", "([A-Z][a-z]+)", 1), F.lit(" {")))
    return P.table(spark, d, "documents").select("doc_id", X.is_test_file(path).alias("test"), F.coalesce(name, F.lit("")).alias("name"), F.array_join(X.normalise_tags(tags), "|").alias("tags"))


_ASKED = ["s2", "17", "00042", "Customer#000000007", "nothing here"]


@query(
    f"WITH {S}, a AS (SELECT unnest({_ASKED!r}) AS entry), h AS (SELECT DISTINCT entry, id, CASE WHEN name = entry THEN 0 WHEN id = entry THEN 1 ELSE 2 END AS tier FROM a JOIN sym ON name = entry OR suffix(id, entry)), "
    "k AS (SELECT * FROM h QUALIFY tier = min(tier) OVER (PARTITION BY entry)) SELECT entry, id, count(*) OVER (PARTITION BY entry) AS n, id = min(id) OVER (PARTITION BY entry) AS first FROM k"
)
def trace_entries(spark, d):
    return graph.entries(P.symbols(spark, d), _ASKED)


@query(f"WITH {S}, {E}, n AS (SELECT id FROM sym ORDER BY CASE kind WHEN 'class' THEN 0 ELSE 1 END, id LIMIT 300) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, kind FROM edg WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def full_graph_edges(spark, d):
    """The edges among the nodes of the capped whole graph, undirected, each once."""
    nodes = graph.full_graph(P.symbols(spark, d).select("id", F.col("kind").alias("type")), {"class": 0, "method": 1}, 300)
    return graph.induced(P.edges(spark, d), graph.cut(nodes.select("id")))


@query(
    f"WITH {N}, r AS (SELECT id, 'n' || (doc_id + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 10000000 END) AS \"by\", CASE WHEN doc_id % 4 = 0 THEN 'newer' END AS reason, superseded_at FROM nodes WHERE doc_id % 3 = 0) "
    "SELECT id, \"by\", reason, CASE WHEN \"by\" IN (SELECT id FROM nodes) THEN 'restored' ELSE 'error' END AS outcome FROM r WHERE superseded_at IS NOT NULL"
)
def ledger_import_supersedes(spark, d):
    n = P.nodes(spark, d)
    k = F.col("doc_id")
    by = F.when(k % 3 == 0, F.concat(F.lit("n"), k + F.when(k % 2 == 0, 5).otherwise(10_000_000)))
    n = n.withColumn("superseded_by", by).withColumn("superseded_reason", F.when(k % 4 == 0, "newer")).select("id", "type", "label", "content", "tags", "superseded_at", "superseded_by", "superseded_reason")
    lines = ledger.export_lines(n, spark.createDataFrame([], "src string, dst string, kind string"))
    return ledger.restore_supersedes(ledger.parse_lines(lines.select("line")), spark.createDataFrame([], "id string"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE 'conv:' || conv_id END AS source, CASE WHEN turn % 4 = 3 THEN '' ELSE '2026-01-0' || (1 + turn % 9) END AS at, CASE WHEN turn % 4 = 3 THEN NULL ELSE md5(CASE WHEN length(text) > 400 THEN text[1:400] || chr(10) || '[truncated]' ELSE text END) END AS digest, CASE WHEN turn % 5 = 1 THEN '2025-12-31' END AS first_date FROM conversations WHERE text IS NOT NULL")
def verbatim_contents(spark, d):
    """Verbatim contents built from turns and taken apart again; some have no header, some texts are over the cap."""
    c = P.table(spark, d, "conversations").where("text is not null")
    t = F.col("turn")
    built = X.verbatim_content(F.concat(F.lit("conv:"), "conv_id"), F.concat(F.lit("2026-01-0"), 1 + t % 9), F.col("text"), 400)
    content = F.when(t % 4 == 3, F.concat(F.lit("no header "), "conv_id")).otherwise(built)
    head = F.concat(F.repeat(F.lit("x\n"), 10), F.when(t % 5 == 1, "since 2025-12-31").otherwise(""), F.repeat(F.lit("\n"), 12), F.lit("2024-02-02"))
    x = c.select("conv_id", "turn", X.verbatim_parts(content).alias("p"), X.date_in_head(head).alias("first_date"))
    return x.select("conv_id", "turn", "p.source", "p.at", F.when(t % 4 != 3, F.md5("p.text")).alias("digest"), "first_date")


@query(
    "WITH u AS (SELECT user_id AS workspace, event_id AS n, CASE event_type WHEN 'click' THEN 'filesDone' WHEN 'view' THEN 'nodesWritten' WHEN 'purchase' THEN 'phase' ELSE 'error' END AS field, CAST(event_id AS VARCHAR) AS value FROM events), "
    "l AS (SELECT workspace, field, arg_max(value, n) AS value FROM u GROUP BY 1, 2), i AS (SELECT unnest(['indexing', 'phase', 'filesDone', 'filesTotal', 'nodesWritten', 'edgesWritten']) AS field, unnest(['false', '\"idle\"', '0', '0', '0', '0']) AS idle), "
    "e AS (SELECT DISTINCT workspace, i.field, idle FROM u, i) SELECT coalesce(e.workspace, l.workspace) AS workspace, coalesce(e.field, l.field) AS field, coalesce(value, idle) AS value FROM e FULL JOIN l ON e.workspace = l.workspace AND e.field = l.field"
)
def index_progress(spark, d):
    kind = F.col("event_type")
    field = F.when(kind == "click", "filesDone").when(kind == "view", "nodesWritten").when(kind == "purchase", "phase").otherwise("error")
    return progress.snapshots(P.table(spark, d, "events").select(F.col("user_id").alias("workspace"), F.col("event_id").alias("n"), field.alias("field"), F.col("event_id").cast("string").alias("value")))
