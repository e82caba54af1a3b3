"""The reference operators as queries over the driver's tables, each with an oracle where SQL can say the same."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import analytics, communities as groups, graph, knowledge, ledger, resolve, views
from ..sources import code, store
from ..streaming import verbatim
from . import projections as P
from .registry import ORACLES, QUERIES, query  # noqa: F401  the entry reads them here

S, E, C, N = P.SYM, P.EDG, P.CHURN, P.NODES


def _walk(kinds: str, back: bool, most: int) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"WITH RECURSIVE {E}, w AS (SELECT 's2' AS id, 0 AS depth UNION SELECT e.{b}, w.depth + 1 FROM w JOIN edg e ON e.{a} = w.id WHERE w.depth < {most} AND e.kind IN ({kinds}))"


@query(f"{_walk("'calls', 'imports'", True, 3)}, {S} SELECT s.id, s.name, s.file, s.kind, m.depth FROM (SELECT id, min(depth) AS depth FROM w GROUP BY id) m JOIN sym s ON s.id = m.id WHERE m.depth > 0")
def blast_radius_up(spark, d):
    return graph.blast_radius(P.symbols(spark, d, complexity=False), graph.of_kinds(P.edges(spark, d, distinct=False)), "s2").select("id", "name", "file", "kind", "depth")


@query(f"{_walk("'calls'", False, 3)}, {S} SELECT s.id, s.name, s.file, s.kind, m.depth FROM (SELECT id, min(depth) AS depth FROM w GROUP BY id) m JOIN sym s ON s.id = m.id WHERE m.depth > 0")
def call_graph_down(spark, d):
    return graph.blast_radius(P.symbols(spark, d, complexity=False), graph.of_kinds(P.edges(spark, d, distinct=False), ("calls",)), "s2", upstream=False).select("id", "name", "file", "kind", "depth")


@query(f"{_walk("'calls'", False, 8)}, m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id) SELECT id, depth, NOT EXISTS (SELECT 1 FROM edg WHERE kind = 'calls' AND src = m.id) AS terminal FROM m ORDER BY depth, id LIMIT 200")
def process_trace(spark, d):
    return graph.trace(P.symbols(spark, d, complexity=False), P.edges(spark, d, distinct=False), "s2")


#: Names given to some symbols so that every exemption is met.
_NAMES = [*analytics.ENTRY_NAMES, "registerRoutes", "setup", "Main", "handler2"]
_LIVE = f"""nm AS (SELECT id, kind, parent_id, CASE WHEN n % 7 = 0 THEN ({_NAMES!r})[CAST(n % {len(_NAMES)} AS INT) + 1] ELSE name END AS name,
  file || CASE n % 11 WHEN 0 THEN '/a.test.ts' WHEN 1 THEN '/b.spec.js' WHEN 2 THEN '/test/c.ts' WHEN 3 THEN '/tests/d.ts' ELSE '' END AS file FROM (SELECT *, CAST(substr(id, 2) AS INT) AS n FROM sym))"""
_DEAD = """dead AS (SELECT s.id, s.name, s.kind, s.file FROM nm s LEFT JOIN sym p ON s.parent_id = p.id
  WHERE s.kind IN ('function', 'method', 'class') AND NOT EXISTS (SELECT 1 FROM edg WHERE dst = s.id AND kind IN ('calls', 'imports')) AND NOT EXISTS (SELECT 1 FROM use_ WHERE dst = s.id AND kind IN ('calls', 'imports'))
  AND NOT (starts_with(s.name, 'register') OR s.name IN ('main', 'run', 'start', 'init', 'register', 'default', 'index', 'handler', 'handle', 'execute', 'serve', 'listen', 'bootstrap'))
  AND NOT (contains(s.file, '/test/') OR contains(s.file, '.test.') OR contains(s.file, '.spec.')) AND (p.kind IS NULL OR p.kind NOT IN ('function', 'method')))"""


def _named_symbols(spark, d):
    n = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    place = F.when(n % 11 == 0, "/a.test.ts").when(n % 11 == 1, "/b.spec.js").when(n % 11 == 2, "/test/c.ts").when(n % 11 == 3, "/tests/d.ts").otherwise("")
    name = F.when(n % 7 == 0, F.get(F.array(*map(F.lit, _NAMES)), n % len(_NAMES))).otherwise(F.col("name"))
    return P.symbols(spark, d, complexity=False).withColumn("name", name).withColumn("file", F.concat("file", place))


@query(f"WITH {S}, {E}, {P.USE}, {_LIVE}, {_DEAD} SELECT * FROM dead")
def dead_code(spark, d):
    """Dead is what neither an edge of the trade graph nor a use by an event reaches: all of both count."""
    return analytics.dead_code(_named_symbols(spark, d), P.edges(spark, d, distinct=False).unionByName(P.uses(spark, d)))


_HOT = "hot AS (SELECT s.id, s.file, s.complexity, CAST(s.complexity * coalesce(c.additions, 1) AS DOUBLE) AS score FROM sym s LEFT JOIN churn c ON s.file = c.file WHERE s.complexity >= 2 ORDER BY score DESC, id LIMIT 50)"


@query(f"WITH {S}, {C}, {_HOT} SELECT * FROM hot")
def hotspots(spark, d):
    return analytics.hotspots(P.symbols(spark, d), P.churn(spark, d).select("file", F.col("additions").alias("churn")))


_CROSS = "cross_ AS (SELECT regexp_replace(a.file, '/[^/]*$', '') AS f, regexp_replace(b.file, '/[^/]*$', '') AS t, e.kind FROM edg e JOIN sym a ON e.src = a.id JOIN sym b ON e.dst = b.id WHERE e.kind IN ('calls', 'imports')), x AS (SELECT * FROM cross_ WHERE f <> t)"


@query(
    f"WITH {S}, {E}, {_CROSS}, m AS (SELECT regexp_replace(file, '/[^/]*$', '') AS module, count(*) AS symbols FROM sym GROUP BY 1), o AS (SELECT f, count(*) AS n FROM x GROUP BY 1), i AS (SELECT t, count(*) AS n FROM x GROUP BY 1) "
    "SELECT module, symbols, coalesce(o.n, 0) AS ce, coalesce(i.n, 0) AS ca, round(CASE WHEN coalesce(o.n, 0) + coalesce(i.n, 0) > 0 THEN coalesce(o.n, 0)::DOUBLE / (coalesce(o.n, 0) + coalesce(i.n, 0)) END, 6) AS instability FROM m LEFT JOIN o ON module = f LEFT JOIN i ON module = t"
)
def coupling(spark, d):
    return analytics.coupling(P.symbols(spark, d, complexity=False), P.edges(spark, d))


@query(f"WITH {S}, {E}, {_CROSS}, w AS (SELECT f AS from_module, t AS to_module, count(*) AS weight, count(*) FILTER (kind = 'calls') AS calls, count(*) FILTER (kind = 'imports') AS imports FROM x GROUP BY 1, 2) SELECT w.*, EXISTS (SELECT 1 FROM w v WHERE v.from_module = w.to_module AND v.to_module = w.from_module) AS cyclic FROM w")
def tectonic_map(spark, d):
    return analytics.tectonic(P.symbols(spark, d, complexity=False), P.edges(spark, d))


@query(
    f"WITH RECURSIVE {S}, {E}, {_CROSS}, e AS (SELECT DISTINCT f, t FROM x), r AS (SELECT f AS a, t AS b FROM e UNION SELECT r.a, e.t FROM r JOIN e ON r.b = e.f), "
    "c AS (SELECT p.a AS id, min(q.a) AS m FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY 1) SELECT id, m AS component, count(*) OVER (PARTITION BY m) AS size FROM c QUALIFY count(*) OVER (PARTITION BY m) >= 2"
)
def dependency_cycles(spark, d):
    x = analytics.cross_module(P.symbols(spark, d, complexity=False), graph.of_kinds(P.edges(spark, d)))
    return graph.sccs(x.select(F.col("from_module").alias("src"), F.col("to_module").alias("dst")))


@query(P.rank_sql(10, "'calls', 'imports'"))
def pagerank_k10(spark, d):
    return graph.pagerank(P.symbols(spark, d, complexity=False), graph.of_kinds(P.edges(spark, d, distinct=False)), 10).select("id", F.round("rank", 9).alias("rank"))


_LAYERS = [("edge", "^(AMERICA|ASIA)/"), ("core", "^EUROPE/"), ("data", "^AFRICA/")]
_ALLOWED = [("edge", "core"), ("core", "data")]
_LAYER = "CASE WHEN regexp_matches(file, '^(AMERICA|ASIA)/') THEN 'edge' WHEN regexp_matches(file, '^EUROPE/') THEN 'core' WHEN regexp_matches(file, '^AFRICA/') THEN 'data' END"


@query(f"WITH {S}, {E}, l AS (SELECT id, {_LAYER} AS layer FROM sym) SELECT src, dst, kind, a.layer AS from_layer, b.layer AS to_layer FROM edg JOIN l a ON src = a.id JOIN l b ON dst = b.id WHERE kind IN ('calls', 'imports') AND a.layer <> b.layer AND a.layer || '>' || b.layer NOT IN ('edge>core', 'core>data')")
def layer_violations(spark, d):
    return analytics.layer_violations(P.symbols(spark, d, complexity=False), P.edges(spark, d), _LAYERS, _ALLOWED)


_DRIFT = """live AS (SELECT lower(p_brand) AS t, lower(p_type) AS c FROM part GROUP BY 1, 2), decl AS (SELECT lower(p_brand) AS t, lower(p_type) AS c FROM part WHERE p_size > 25 GROUP BY 1, 2),
u AS (SELECT t FROM live UNION SELECT t FROM decl), md AS (SELECT t, string_agg(c, ',' ORDER BY c) AS x FROM (SELECT * FROM live EXCEPT SELECT * FROM decl) GROUP BY t), ml AS (SELECT t, string_agg(c, ',' ORDER BY c) AS x FROM (SELECT * FROM decl EXCEPT SELECT * FROM live) GROUP BY t),
drift AS (SELECT u.t AS "table", CASE WHEN u.t NOT IN (SELECT t FROM decl) THEN 'only_live' WHEN u.t NOT IN (SELECT t FROM live) THEN 'only_declared' WHEN md.x IS NOT NULL OR ml.x IS NOT NULL THEN 'columns' ELSE 'same' END AS status,
  CASE WHEN u.t IN (SELECT t FROM decl) AND u.t IN (SELECT t FROM live) THEN coalesce(md.x, '') END AS missing_declared, CASE WHEN u.t IN (SELECT t FROM decl) AND u.t IN (SELECT t FROM live) THEN coalesce(ml.x, '') END AS missing_live FROM u LEFT JOIN md USING (t) LEFT JOIN ml USING (t))"""


def _drift(spark, d):
    part = P.table(spark, d, "part")
    make = lambda df: df.groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_type").alias("columns"))
    return analytics.schema_drift(make(part), make(part.where("p_size > 25")))


@query(f"WITH {_DRIFT} SELECT * FROM drift")
def schema_drift(spark, d):
    return _drift(spark, d)


@query(f"WITH {C} SELECT * FROM churn")
def file_churn(spark, d):
    return P.churn(spark, d)


def _spans(spark, d):
    return P.symbols(spark, d).withColumn("start_line", F.regexp_extract("id", r"(\d+)", 1).cast("int")).withColumn("end_line", F.col("start_line") + F.col("complexity") % 7)


def _ranges(spark, d):
    return P.symbols(spark, d).where("kind = 'class'").select("file", F.regexp_extract("id", r"(\d+)", 1).cast("int").alias("range_start")).withColumn("range_end", F.col("range_start") + 3)


_CHANGED = "sp AS (SELECT *, CAST(substr(id, 2) AS INT) AS start_line, CAST(substr(id, 2) AS INT) + complexity % 7 AS end_line FROM sym), rg AS (SELECT file, CAST(substr(id, 2) AS INT) AS a, CAST(substr(id, 2) AS INT) + 3 AS b FROM sym WHERE kind = 'class'), ch AS (SELECT DISTINCT sp.* FROM sp JOIN rg ON sp.file = rg.file AND start_line <= b AND end_line >= a)"


@query(f"WITH {S}, {_CHANGED} SELECT id, file, start_line, CAST(end_line AS BIGINT) AS end_line FROM ch")
def changed_symbols(spark, d):
    return analytics.changed_symbols(_spans(spark, d), _ranges(spark, d)).select("id", "file", "start_line", "end_line")


@query(
    f"WITH {S}, {E}, {C}, {_CHANGED}, i AS (SELECT dst, count(DISTINCT src) AS n FROM edg WHERE kind IN ('calls', 'imports') GROUP BY 1), r AS (SELECT ch.id, ch.file, greatest(coalesce(i.n, 0), 1) * greatest(complexity, 1) * ln(1 + coalesce(churn.additions, 0)) AS score FROM ch LEFT JOIN i ON dst = ch.id LEFT JOIN churn ON churn.file = ch.file), t AS (SELECT sum(score) AS total, max(score) AS most FROM r) "
    "SELECT id, file, round(score, 2) AS score, round(total, 2) AS total_score, CASE WHEN most >= 50 OR total >= 200 THEN 'critical' WHEN most >= 20 OR total >= 80 THEN 'high' WHEN most >= 5 OR total >= 20 THEN 'medium' ELSE 'low' END AS band FROM r, t"
)
def pr_risk(spark, d):
    return analytics.pr_risk(analytics.changed_symbols(_spans(spark, d), _ranges(spark, d)), P.edges(spark, d), P.churn(spark, d).select("file", F.col("additions").alias("churn")))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS authors FROM events GROUP BY 1")
def authors(spark, d):
    return views.authors(P.table(spark, d, "events"), "user_id", "event_type")


@query(f"WITH {S}, {E}, {P.USE}, {C}, {_LIVE}, {_DEAD}, {_HOT}, {_DRIFT} SELECT 'dead_code' AS type, id AS subject, 'medium' AS severity FROM dead UNION ALL SELECT 'hotspot', id, CASE WHEN score > 10 THEN 'high' WHEN score > 5 THEN 'medium' ELSE 'low' END FROM hot UNION ALL SELECT 'schema_drift', \"table\", 'high' FROM drift WHERE status <> 'same'")
def alerts(spark, d):
    return analytics.alerts(dead_code(spark, d), hotspots(spark, d), _drift(spark, d))


@query(f"WITH {N} SELECT 'type:' || type AS measure, count(*) AS value FROM nodes GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'projects', count(DISTINCT project) FROM nodes UNION ALL (WITH {E} SELECT 'edges', count(*) FROM edg)")
def stats(spark, d):
    return analytics.stats(P.nodes(spark, d), P.edges(spark, d))


def _clusters(spark, d):
    """Documents as files in cliques of five; every seventh clique has no common folder and is labelled by its symbols."""
    n, g = F.col("doc_id"), F.floor(F.col("doc_id") / 5)
    folder = F.when(g % 7 == 3, F.concat(F.lit("x"), n)).otherwise(F.concat(F.lit("r"), F.floor(g / 8), F.lit("/src/g"), g % 8))
    name = F.concat(F.when(n % 5 < 3, F.lit("getAlpha_")).otherwise(F.lit("handle_beta_")), n)
    return P.table(spark, d, "documents").select("doc_id", g.alias("g"), F.concat(folder, F.lit("/f"), n % 5, F.lit(".ts")).alias("file"), name.alias("name"))


_CLU = """clu AS (SELECT doc_id, doc_id // 5 AS g, CASE WHEN (doc_id // 5) % 7 = 3 THEN 'x' || doc_id ELSE 'r' || (doc_id // 40) || '/src/g' || ((doc_id // 5) % 8) END || '/f' || (doc_id % 5) || '.ts' AS file FROM documents),
lab AS (SELECT g, min(file) AS community, min(file) AS first, CASE WHEN g % 7 = 3 AND count(*) > 1 THEN 'alpha' WHEN g % 7 = 3 THEN split_part(min(file), '/', 1) ELSE 'g' || (g % 8) END AS label, string_agg(regexp_replace(file, '^.*/', ''), '|' ORDER BY regexp_replace(file, '^.*/', '')) AS names FROM clu GROUP BY g)"""


def _members(spark, d):
    x = _clusters(spark, d)
    y = x.select("g", F.col("file").alias("dst"), F.col("doc_id").alias("other"))
    edges = x.join(y.hint("merge"), "g").where("doc_id < other").select(F.col("file").alias("src"), "dst")  # five a clique
    return groups.louvain(x.select(F.col("file").alias("id")), edges).select(F.col("id").alias("file"), "community"), x.select("file", "name")


@query(f"WITH {_CLU} SELECT clu.file, lab.community FROM clu JOIN lab ON clu.g = lab.g")
def communities(spark, d):
    return _members(spark, d)[0]


@query(f"WITH {_CLU} SELECT community, label FROM lab")
def community_labels(spark, d):
    return groups.labels(*_members(spark, d)).select("community", "label")


_SID = f"""{_CLU}, sid AS (SELECT *, label || '~' || regexp_replace(regexp_replace(first, '^.*/', ''), '[.][^.]+$', '') AS bare, lpad(lower(to_hex(list_reduce([2166136261] || list_transform(string_split(names, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296))), 8, '0') AS hash FROM lab),
turn AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY first) AS turn, row_number() OVER (ORDER BY first) - 1 AS number FROM sid), late AS (SELECT *, row_number() OVER (PARTITION BY bare, hash, turn > 1 ORDER BY first) AS later FROM turn),
ids AS (SELECT community, label, CASE WHEN turn = 1 THEN bare WHEN later = 1 THEN bare || '~' || hash ELSE bare || '~' || hash || '~' || number END AS stable_id FROM late)"""


@query(f"WITH {_SID} SELECT community, stable_id FROM ids")
def stable_ids(spark, d):
    members, symbols = _members(spark, d)
    return groups.stable_ids(groups.labels(members, symbols), members)


@query(f"WITH {_SID}, m AS (SELECT clu.g, lab.community, file, split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS folder FROM clu JOIN lab USING (g)), fo AS (SELECT community, folder, count(*) AS k FROM m GROUP BY 1, 2) SELECT stable_id AS id, label, count(*) AS file_count, array_to_string(list_sort(list(file))[1:5], ',') AS files, (SELECT arg_min(folder, (-k, folder)) FROM fo WHERE fo.community = ids.community) AS folder FROM ids JOIN m ON m.community = ids.community GROUP BY ids.community, stable_id, label HAVING count(*) >= 2")
def community_listing(spark, d):
    return groups.listing(*_members(spark, d)).select("id", "label", "file_count", F.array_join("sample_files", ",").alias("files"), "folder")


def _module_links(spark, d):
    m = P.symbols(spark, d).select(F.col("id").alias("file"), X.dirname(F.col("file")).alias("community"))
    return groups.directed_links(P.edges(spark, d).where("kind = 'imports'").select("src", "dst"), m)


def _module_layers(spark, d):
    return P.table(spark, d, "nation").join(P.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("community"), (F.col("r_regionkey") + 1).alias("rank"))


_LINK = f"""WITH RECURSIVE {S}, {E}, m AS (SELECT id, regexp_replace(file, '/[^/]*$', '') AS c FROM sym), ln AS (SELECT a.c AS src, b.c AS dst, count(*) AS weight FROM edg JOIN m a ON src = a.id JOIN m b ON dst = b.id WHERE a.c <> b.c AND edg.kind = 'imports' GROUP BY 1, 2),
rc AS (SELECT src AS a, dst AS b FROM ln UNION SELECT rc.a, ln.dst FROM rc JOIN ln ON rc.b = ln.src), cy AS (SELECT p.a AS id, min(q.a) AS c FROM rc p JOIN rc q ON p.a = q.b AND p.b = q.a GROUP BY 1 HAVING count(*) > 1),
la AS (SELECT r_name || '/' || n_name AS c, r_regionkey + 1 AS rank FROM nation JOIN region ON n_regionkey = r_regionkey), inv AS (SELECT src, dst FROM ln JOIN la a ON src = a.c JOIN la b ON dst = b.c WHERE a.rank <> 5 AND a.rank - b.rank >= 2)"""


@query(f"{_LINK} SELECT 'cycle' AS finding, id AS src, c AS dst FROM cy UNION ALL SELECT 'hub', dst, CAST(count(DISTINCT src) AS VARCHAR) FROM ln WHERE dst NOT IN (SELECT id FROM cy) GROUP BY dst HAVING count(DISTINCT src) >= 3 UNION ALL SELECT 'inversion', src, dst FROM inv")
def community_insights(spark, d):
    return groups.insights(_module_links(spark, d), _module_layers(spark, d))


@query(f"{_LINK}, fl AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, weight, src IN (SELECT id FROM cy) AND (SELECT c FROM cy WHERE id = src) = (SELECT c FROM cy WHERE id = dst) AS cyc, EXISTS (SELECT 1 FROM inv WHERE inv.src = ln.src AND inv.dst = ln.dst) AS bad FROM ln) SELECT a, b, CAST(sum(weight) AS BIGINT) AS weight, coalesce(bool_or(cyc), false) AS cyclic, bool_or(bad) AS violation FROM fl GROUP BY 1, 2")
def community_edges(spark, d):
    links = _module_links(spark, d)
    return groups.links_of(links, groups.insights(links, _module_layers(spark, d)))


_SUB = f"""WITH {E}, b AS (SELECT src AS o, dst AS id FROM edg UNION SELECT dst, src FROM edg), one AS (SELECT id, min(o) AS by_ FROM b WHERE o = 's2' AND id <> 's2' GROUP BY 1 ORDER BY by_, id LIMIT 199), two AS (SELECT id FROM (SELECT b.id, row_number() OVER (ORDER BY min(b.o), b.id) AS n FROM b JOIN one ON b.o = one.id WHERE b.id <> 's2' AND b.id NOT IN (SELECT id FROM one) GROUP BY b.id) WHERE n <= 199 - (SELECT count(*) FROM one)),
sub AS (SELECT 's2' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two)"""


@query(f"{_SUB} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, kind FROM edg WHERE src IN (SELECT id FROM sub) AND dst IN (SELECT id FROM sub) AND src <> dst")
def subgraph_edges(spark, d):
    return graph.subgraph(P.edges(spark, d), "s2")[1]


@query(f"{_SUB} SELECT * FROM sub")
def subgraph_nodes(spark, d):
    return graph.subgraph(P.edges(spark, d), "s2")[0]


_ORDER = {"decision": 0, "architecture": 1, "convention": 2}


@query(f"WITH {N} SELECT id, type, CASE type WHEN 'decision' THEN 0 WHEN 'architecture' THEN 1 WHEN 'convention' THEN 2 ELSE 99 END AS priority FROM nodes ORDER BY priority, id LIMIT 3000")
def full_graph(spark, d):
    return graph.full_graph(P.nodes(spark, d), _ORDER).select("id", "type", "priority")


@query(f"WITH {S}, f AS (SELECT DISTINCT file, string_split(file, '/') AS p FROM sym), u AS (SELECT p, unnest(range(0, len(p))) AS i FROM f) SELECT DISTINCT CASE WHEN i = 0 THEN '.' ELSE array_to_string(p[1:i], '/') END AS parent, array_to_string(p[1:i + 1], '/') AS child, i = len(p) - 1 AS child_is_file FROM u")
def folders(spark, d):
    return graph.folders(P.symbols(spark, d))


@query("SELECT DISTINCT 'code-import:' || CASE WHEN trim(regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g'), '_') = '' THEN '_' ELSE trim(regexp_replace(regexp_replace(x, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') END AS id FROM (SELECT unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS x FROM pages)")
def import_nodes(spark, d):
    return views.import_nodes(P.table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)).alias("module")))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f), c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS card FROM n WHERE k <= 160 GROUP BY 1) SELECT CAST(d.doc_id AS VARCHAR) AS file, concat_ws(' ', d.doc_id, substr(coalesce(card, ''), 1, 2000)) AS card FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id")
def context_cards(spark, d):
    return views.file_cards(P.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("content")))


@query("WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN length(text) > 8000 THEN 'too large' WHEN text IS NULL THEN 'unreadable' END AS reason FROM documents) SELECT reason, count(*) AS n, array_to_string(list_sort(list(DISTINCT file))[1:5], ',') AS sample FROM x WHERE reason IS NOT NULL GROUP BY 1")
def skipped_summary(spark, d):
    reason = F.when(F.length("text") > 8000, "too large").when(F.col("text").isNull(), "unreadable")
    x = P.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), reason.alias("reason")).where("reason is not null")
    return views.skipped_summary(x).withColumn("sample", F.array_join("sample", ","))


_KEY = "k AS (SELECT id, content, 3 * ((length(lower(label)) - length(replace(lower(label), 'en', ''))) // 2) + 2 * ((length(lower(array_to_string(tags, ' '))) - length(replace(lower(array_to_string(tags, ' ')), 'en', ''))) // 2) + (length(lower(content)) - length(replace(lower(content), 'en', ''))) // 2 + 3 * ((length(lower(label)) - length(replace(lower(label), 'src1', ''))) // 4) + 2 * ((length(lower(array_to_string(tags, ' '))) - length(replace(lower(array_to_string(tags, ' ')), 'src1', ''))) // 4) + (length(lower(content)) - length(replace(lower(content), 'src1', ''))) // 4 AS score FROM nodes WHERE superseded_at IS NULL)"


@query(f"WITH {N}, {_KEY} SELECT id, CAST(score AS BIGINT) AS score FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def keyword_search(spark, d):
    return knowledge.keyword_search(P.nodes(spark, d), "en, src1")


@query(f"WITH {N}, {_KEY}, r AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, content FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 20), t AS (SELECT rank, id, CAST(sum(length(content)) OVER (ORDER BY rank) AS BIGINT) AS total FROM r) SELECT rank, id, total, (SELECT count(*) FROM t WHERE total > 90000) AS omitted FROM t WHERE total <= 90000")
def context_block(spark, d):
    nodes = P.nodes(spark, d)
    top = knowledge.keyword_search(nodes, "en src1")
    ranked = top.join(nodes.select("id", "content"), "id").select(F.expr("row_number() over (order by score desc, id)").cast("long").alias("rank"), "id", "content")
    return knowledge.context_block(ranked, 90000)


@query(f"WITH {N}, l AS (SELECT id, type, label FROM nodes WHERE superseded_at IS NULL AND type IN ('decision', 'convention') AND list_contains(tags, 'en')) SELECT *, (SELECT count(*) FROM l) AS total FROM l ORDER BY id LIMIT 50 OFFSET 10")
def knowledge_list(spark, d):
    return knowledge.listing(P.nodes(spark, d), ["decision", "convention"], ["EN"], 50, 10)


def _vectors(spark, d):
    return P.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def _probe(spark, d):
    return [float(x) for x in P.table(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]]


_SEM = "SELECT CAST(vec_id AS VARCHAR) AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings"


@query(f"{_SEM} ORDER BY score DESC, id LIMIT 10")
def semantic_topk(spark, d):
    return knowledge.semantic(_vectors(spark, d), _probe(spark, d))


@query(f"WITH {N}, {_KEY}, s AS ({_SEM}), a AS (SELECT 'n' || id AS id, row_number() OVER (ORDER BY score DESC, 'n' || id) AS r FROM (SELECT * FROM s ORDER BY score DESC, 'n' || id LIMIT 20)), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, score FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 20)) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 10")
def hybrid_search(spark, d):
    near = knowledge.semantic(_vectors(spark, d).withColumn("id", F.concat(F.lit("n"), "id")), _probe(spark, d), 20)
    return knowledge.fuse([near, knowledge.keyword_search(P.nodes(spark, d), "en SRC1")])


@query(f"WITH {N}, s AS (SELECT 'n' || id AS id, score FROM ({_SEM}) ORDER BY score DESC, 'n' || id LIMIT 50) SELECT s.id, type, score, CASE WHEN length(content) > 280 THEN content[1:280] || '…' ELSE content END AS snippet FROM s JOIN nodes ON s.id = nodes.id WHERE superseded_at IS NULL ORDER BY CASE WHEN type IN ('decision', 'convention') THEN 0 ELSE 1 END, score DESC, s.id LIMIT 10")
def semantic_recall(spark, d):
    v = _vectors(spark, d).withColumn("id", F.concat(F.lit("n"), "id"))
    return knowledge.recall(v, P.nodes(spark, d), _probe(spark, d), ["decision", "convention"])


@query("WITH e AS (SELECT conv_id || ':' || turn AS id, conv_id, turn FROM conversations), m AS (SELECT conv_id, max((turn, conv_id || ':' || turn)) AS t FROM e GROUP BY 1) SELECT e.id, turn AS at, CASE WHEN turn = 1 AND conv_id % 7 = 0 THEN 'superseded-by:' || conv_id || ':0' WHEN m.t[1] > turn THEN 'outdated-by:' || m.t[2] || ' (by time)' ELSE 'current' END AS status FROM e JOIN m USING (conv_id)")
def verbatim_status(spark, d):
    c = P.table(spark, d, "conversations")
    e = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.array(F.col("conv_id").cast("string")).alias("topics"), F.col("turn").alias("at"))
    sup = c.where("turn = 1 and conv_id % 7 = 0").select(F.concat_ws(":", "conv_id", F.lit("0")).alias("src"), F.concat_ws(":", "conv_id", F.lit("1")).alias("dst"))
    return knowledge.verbatim_status(e, sup)


@query(f"WITH {E} SELECT dst AS id, kind, 'out' AS direction FROM edg WHERE src = 's2' UNION ALL SELECT src, kind, 'in' FROM edg WHERE dst = 's2'")
def neighbours(spark, d):
    return knowledge.neighbours(P.edges(spark, d), "s2")


@query(f"WITH {N}, e AS (SELECT 'n' || a.doc_id AS src, 'n' || (a.doc_id + 3) AS dst FROM documents a WHERE a.doc_id % 3 = 0), p AS (SELECT id FROM nodes WHERE type = 'convention') SELECT id FROM nodes WHERE type = 'decision' AND superseded_at IS NULL AND id NOT IN (SELECT src FROM e WHERE dst IN (SELECT id FROM p) UNION SELECT dst FROM e WHERE src IN (SELECT id FROM p))")
def unbacked_work(spark, d):
    nodes = P.nodes(spark, d)
    e = nodes.where("doc_id % 3 = 0").select(F.col("id").alias("src"), F.concat(F.lit("n"), F.col("doc_id") + 3).alias("dst"))
    return knowledge.unbacked(nodes, e, nodes.where("type = 'convention'").select("id"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'who calls|callers of') THEN 'call_graph' WHEN regexp_matches(lower(text), 'what breaks|impact|blast') THEN 'blast_radius' WHEN regexp_matches(lower(text), 'dead|unused') THEN 'find_dead_code' WHEN regexp_matches(lower(text), 'hot ?spot|complex') THEN 'hotspots' WHEN regexp_matches(lower(text), 'drift|schema') THEN 'schema_drift' WHEN regexp_matches(lower(text), 'decision|convention|why') THEN 'knowledge_search' ELSE 'knowledge_recall' END AS tool FROM conversations")
def intent_router(spark, d):
    return P.table(spark, d, "conversations").select("conv_id", "turn", knowledge.route(F.col("text")).alias("tool"))


@query(f"WITH {S}, {E}, c AS (SELECT e.dst, s.file, e.src FROM edg e JOIN sym s ON e.src = s.id WHERE e.kind = 'calls') SELECT dst AS id, count(DISTINCT src) AS callers, array_to_string(list_sort(list(DISTINCT file))[1:3], ',') AS files, greatest(count(DISTINCT file) - 3, 0) AS more FROM c GROUP BY 1")
def hook_enrichment(spark, d):
    return views.callers(P.edges(spark, d), P.symbols(spark, d))


_RC = """ca AS (SELECT o_orderkey AS call_id, 'c' || o_custkey AS caller, s.file, CASE WHEN o_orderkey % 4 = 3 THEN s.repo || '.' ELSE '' END || 'f' || (o_orderkey % 50) AS callee, CASE o_orderkey % 8 WHEN 0 THEN s.repo WHEN 4 THEN 'this' END AS receiver FROM orders JOIN sym s ON s.id = 'c' || o_custkey),
t0 AS (SELECT *, CAST(substr(id, 2) AS INT) AS n FROM sym), t AS (SELECT id, 'f' || (n % 50) AS name, CASE WHEN n % 4 <> 1 THEN repo || '.' ELSE '' END || 'f' || (n % 50) AS q, file, (file, n, id) AS o, n % 9 <> 0 AS can FROM t0),
loc AS (SELECT file, name, arg_min(id, o) AS dst, count(*) AS n FROM t WHERE can GROUP BY 1, 2), exp AS (SELECT file, name, arg_min(id, o) AS dst FROM t GROUP BY 1, 2), qa AS (SELECT q, arg_min(id, o) AS dst FROM t GROUP BY 1), qf AS (SELECT q, file, arg_min(id, o) AS dst FROM t GROUP BY 1, 2), bare AS (SELECT name, arg_min(id, o) AS dst FROM t WHERE can AND q = name GROUP BY 1),
im AS (SELECT DISTINCT a.file, b.file AS target_file, CASE WHEN b.n % 3 = 0 THEN b.repo WHEN b.kind = 'class' THEN '*' ELSE 'f' || (b.n % 50) END AS name FROM edg JOIN t0 a ON src = a.id JOIN t0 b ON dst = b.id WHERE edg.kind = 'imports'),
ni AS (SELECT file, name, min(target_file) AS target_file FROM im WHERE name <> '*' GROUP BY 1, 2), wi AS (SELECT im.file, exp.name, arg_min(exp.dst, target_file) AS dst FROM im JOIN exp ON exp.file = im.target_file WHERE im.name = '*' GROUP BY 1, 2),
x AS (SELECT call_id, caller AS src, coalesce(r1.dst, r2.dst, r3.dst) AS d0, loc.dst AS d1, loc.n AS k, e.dst AS d2, wi.dst AS d3, q4.dst AS d4, bare.dst AS d5 FROM (SELECT *, CASE WHEN regexp_full_match(receiver, '[A-Za-z_$][A-Za-z0-9_$]*') AND receiver <> 'this' THEN receiver END AS r FROM ca) ca
  LEFT JOIN qf r1 ON r1.q = r || '.' || callee AND r1.file = ca.file LEFT JOIN ni rn ON rn.file = ca.file AND rn.name = r LEFT JOIN qf r2 ON r2.q = r || '.' || callee AND r2.file = rn.target_file LEFT JOIN qa r3 ON r3.q = r || '.' || callee
  LEFT JOIN loc ON loc.file = ca.file AND loc.name = callee LEFT JOIN ni ON ni.file = ca.file AND ni.name = callee LEFT JOIN exp e ON e.file = ni.target_file AND e.name = callee LEFT JOIN wi ON wi.file = ca.file AND wi.name = callee LEFT JOIN qa q4 ON q4.q = callee LEFT JOIN bare ON bare.name = callee)"""


def _call_tables(spark, d):
    """(calls, symbols, imports) of the trade graph: orders call, symbols are callable by number, edges of the kind import."""
    s = P.symbols(spark, d).withColumn("n", F.regexp_extract("id", r"(\d+)", 1).cast("int"))
    name = F.concat(F.lit("f"), F.col("n") % 50)
    t = s.select("id", name.alias("name"), F.when(F.col("n") % 9 == 0, "variable").otherwise(F.col("kind")).alias("kind"), F.when(F.col("n") % 4 != 1, F.col("repo")).alias("scope"), "file", F.col("n").alias("start_line"))
    key = F.col("o_orderkey")
    o = P.table(spark, d, "orders").join(s.select(F.col("id").alias("caller"), "file", "repo"), F.concat(F.lit("c"), "o_custkey") == F.col("caller"))
    calls = o.select(key.alias("call_id"), "caller", "file", F.concat(F.when(key % 4 == 3, F.concat("repo", F.lit("."))).otherwise(F.lit("")), F.lit("f"), key % 50).alias("callee"), F.when(key % 8 == 0, F.col("repo")).when(key % 8 == 4, "this").alias("receiver"))
    e = P.edges(spark, d).where("kind = 'imports'").select("src", "dst")
    imported = F.when(F.col("n") % 3 == 0, F.col("repo")).when(F.col("kind") == "class", "*").otherwise(name)
    imp = e.join(s.select(F.col("id").alias("src"), "file"), "src").join(s.select(F.col("id").alias("dst"), F.col("file").alias("target_file"), imported.alias("name"), "n"), "dst")
    return calls, t, imp.select("file", "target_file", "name").distinct()


@query(f"WITH {S}, {E}, {_RC} SELECT call_id, src, coalesce(d0, d1, d2, d3, d4, d5) AS dst, CAST(CASE WHEN d0 IS NOT NULL THEN 0.95 WHEN d1 IS NOT NULL THEN CASE WHEN k > 1 THEN 0.85 ELSE 1.0 END WHEN d2 IS NOT NULL THEN 0.95 WHEN d3 IS NOT NULL THEN 0.8 WHEN d4 IS NOT NULL THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN d0 IS NOT NULL THEN 'receiver' WHEN d1 IS NOT NULL THEN 'same file' WHEN d2 IS NOT NULL THEN 'named import' WHEN d3 IS NOT NULL THEN 'wildcard import' WHEN d4 IS NOT NULL THEN 'qualified name' ELSE 'bare name' END AS reason FROM x WHERE coalesce(d0, d1, d2, d3, d4, d5) IS NOT NULL")
def resolve_calls(spark, d):
    return resolve.resolve_calls(*_call_tables(spark, d))


@query(f"WITH {S}, {E}, {_RC} SELECT DISTINCT src, coalesce(d0, d1, d2, d3, d4, d5) AS dst, 'calls' AS kind FROM x JOIN sym s ON s.id = x.src WHERE s.repo = 'ASIA' AND coalesce(d0, d1, d2, d3, d4, d5) IS NOT NULL")
def single_file_index(spark, d):
    """The files of one repository indexed anew against the stored symbols of all others: the edges of a full index. Stale symbols go."""
    calls, t, imports = _call_tables(spark, d)
    s = store.Store(spark, f"{graph.shared_dir(spark)}/quarryline-store/{uuid.uuid4().hex}")
    fresh = t.withColumn("scope", F.col("scope").cast("string"))
    mine = F.col("file").startswith("ASIA/")
    none = [x.limit(0) for x in (calls, imports)]
    stale = fresh.where(mine).withColumn("id", F.concat(F.lit("old-"), "id")).withColumn("name", F.lit("gone"))
    store.replace_files(s, fresh.where(~mine).unionByName(stale), *none, fresh.select("file").distinct())
    store.replace_files(s, fresh.where(mine), calls.where(mine), imports.where(mine), fresh.where(mine).select("file").distinct())
    return s.edges().select("src", "dst", "kind")


@query("WITH f AS (SELECT DISTINCT source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.ts' WHEN doc_id % 3 = 1 THEN '.js' ELSE '/index.ts' END AS path FROM documents), i AS (SELECT DISTINCT source || '/' || lang || '/m' || doc_id || '.ts' AS file, CASE WHEN doc_id % 4 = 0 THEN 'react' ELSE './' || doc_id END AS specifier, source || '/' || lang AS dir, doc_id FROM documents), x AS (SELECT i.file, specifier, path AS target_file, CASE WHEN suffix(path, '/index.ts') THEN 10 WHEN suffix(path, '.ts') THEN 1 ELSE 3 END AS p FROM i JOIN f ON specifier <> 'react' AND path IN (dir || '/' || doc_id || '.ts', dir || '/' || doc_id || '.js', dir || '/' || doc_id || '/index.ts')) SELECT i.file, i.specifier, b.target_file FROM i LEFT JOIN (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY file, specifier ORDER BY p) = 1) b ON i.file = b.file AND i.specifier = b.specifier")
def resolve_imports(spark, d):
    x = P.table(spark, d, "documents")
    base = F.concat_ws("/", "source", "lang")
    ext = F.when(F.col("doc_id") % 3 == 0, ".ts").when(F.col("doc_id") % 3 == 1, ".js").otherwise("/index.ts")
    files = x.select(F.concat(base, F.lit("/"), "doc_id", ext).alias("file")).distinct()
    imports = x.select(F.concat(base, F.lit("/m"), "doc_id", F.lit(".ts")).alias("file"), F.when(F.col("doc_id") % 4 == 0, F.lit("react")).otherwise(F.concat(F.lit("./"), "doc_id")).alias("specifier")).distinct()
    return resolve.resolve_paths(imports, files)


@query(f"WITH {S}, t AS (SELECT id, 'K' || substr(id, 2) AS name, CAST(substr(id, 2) AS INT) AS n, repo, file, kind FROM sym), s AS (SELECT a.id, 'extends' AS kind, CASE WHEN a.n % 2 = 0 THEN replace(a.repo, ' ', '_') || '.K' ELSE 'K' END || (a.n % 20) AS target FROM t a), k AS (SELECT id AS dst, name, replace(repo, ' ', '_') || '.' || name AS q, file, n FROM t WHERE kind = 'class'), c AS (SELECT s.id, s.kind, target, dst, 0 AS p, 1.0::DOUBLE AS confidence, file, n FROM s JOIN k ON target = q UNION ALL SELECT s.id, s.kind, target, dst, 1, 0.7, file, n FROM s JOIN k ON target = name), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, kind, target ORDER BY p, file, n, dst) = 1) SELECT id AS src, dst, kind, confidence FROM b WHERE id <> dst")
def inheritance(spark, d):
    num = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    s = P.symbols(spark, d).select("id", F.concat(F.lit("K"), num).alias("name"), F.translate("repo", " ", "_").alias("scope"), "file", "kind", num.alias("start_line"))
    sig = F.concat(F.lit("class "), "name", F.lit(" extends "), F.when(F.col("start_line") % 2 == 0, F.concat("scope", F.lit(".K"))).otherwise(F.lit("K")), F.col("start_line") % 20)
    return resolve.inheritance(s.withColumn("signature", sig))


@query(f"WITH {S} SELECT parent_id AS src, id AS dst, 'contains' AS kind FROM sym WHERE parent_id IS NOT NULL")
def contains_edges(spark, d):
    return resolve.contains(P.symbols(spark, d))


_TABLES = ["orders", "thing", "the", "que", "der", "los", "en"]


@query("WITH t AS (SELECT unnest(['orders', 'thing', 'the', 'que', 'der', 'los']) AS \"table\"), w AS (SELECT 'n' || doc_id AS src, text, unnest(list_distinct(regexp_extract_all(lower(text), '\\w+'))) AS word FROM documents) SELECT DISTINCT src, \"table\", CASE WHEN regexp_matches(text, '(?i)\\b(insert|update|delete|merge|upsert|create|save|write)\\b') THEN 'writes' ELSE 'queries' END AS kind FROM w JOIN t ON word = \"table\"")
def data_links(spark, d):
    return resolve.data_links(P.table(spark, d, "documents").select(F.concat(F.lit("n"), "doc_id").alias("id"), F.col("text").alias("body")), spark.createDataFrame([(t,) for t in _TABLES], "table string"))


@query(f"WITH {S} SELECT id, 2 AS tier, (SELECT count(DISTINCT repo) > 1 FROM sym WHERE CAST(substr(id, 2) AS INT) % 50 = 7) AS ambiguous FROM sym WHERE CAST(substr(id, 2) AS INT) % 50 = 7")
def find_symbol(spark, d):
    num = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    return resolve.find_symbol(P.symbols(spark, d).select("id", F.concat(F.lit("f"), num % 50).alias("name"), F.col("repo").alias("scope"), "repo"), "f7")


@query("WITH i AS (SELECT DISTINCT 'src' || (doc_id % 20) AS repo, CASE WHEN doc_id % 3 = 0 THEN '@scope/p' || (doc_id % 7) ELSE 'p' || (doc_id % 7) END AS package FROM documents), m AS (SELECT DISTINCT source AS member, CASE WHEN doc_id % 2 = 0 THEN '@scope/p' ELSE 'p' END || (doc_id % 7) AS package FROM documents) SELECT DISTINCT repo, member, package FROM i JOIN m USING (package) WHERE repo <> member")
def package_bridge(spark, d):
    x = P.table(spark, d, "documents")
    imports = x.select(F.concat(F.lit("src"), F.col("doc_id") % 20).alias("repo"), F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("@scope/p")).otherwise(F.lit("p")), F.col("doc_id") % 7, F.lit("/lib/x")).alias("module"))
    members = x.select(F.col("source").alias("member"), F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("@scope/p")).otherwise(F.lit("p")), F.col("doc_id") % 7).alias("package")).distinct()
    return resolve.package_bridge(imports, members)


@query(f"WITH {S}, r AS (SELECT DISTINCT repo AS root, 'ws-' || repo AS ws FROM sym UNION SELECT DISTINCT regexp_replace(file, '/[^/]*$', ''), 'ws-' || regexp_extract(file, '/([^/]*)/', 1) FROM sym WHERE repo = 'ASIA'), p AS (SELECT DISTINCT file AS path FROM sym) SELECT path, arg_max(ws, length(root)) AS workspace FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1")
def path_workspace(spark, d):
    s = P.symbols(spark, d)
    a = s.select(F.col("repo").alias("root"), F.concat(F.lit("ws-"), "repo").alias("workspace")).distinct()
    b = s.where("repo = 'ASIA'").select(X.dirname(F.col("file")).alias("root"), F.concat(F.lit("ws-"), F.split("file", "/")[1]).alias("workspace")).distinct()
    return resolve.workspace_of(s.select(F.col("file").alias("path")).distinct(), a.unionByName(b).withColumn("added", F.lit(0)))


@query("WITH o AS (SELECT doc_id, lang, 1 AS ts FROM documents), n AS (SELECT doc_id, 'new' AS lang, CAST(doc_id % 3 AS INT) AS ts FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 1000000, 'new', 2 FROM documents WHERE doc_id % 10 = 0) SELECT id, lang, ts FROM (SELECT doc_id AS id, lang, ts, 0 AS new_ FROM o UNION ALL SELECT doc_id, lang, ts, 1 FROM n) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, new_ DESC) = 1")
def node_upsert(spark, d):
    x = P.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    new = x.where("id % 2 = 0").select("id", F.lit("new").alias("lang"), (F.col("id") % 3).cast("int").alias("ts"))
    more = x.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("new").alias("lang"), F.lit(2).alias("ts"))
    return ledger.upsert(x.withColumn("ts", F.lit(1)), new.unionByName(more))


@query(f"WITH {S}, {E} SELECT src, dst, kind, src IN (SELECT id FROM sym WHERE repo <> 'ASIA') AND dst IN (SELECT id FROM sym WHERE repo <> 'ASIA') AS accepted FROM edg")
def edge_insert(spark, d):
    return ledger.insert_edges(P.edges(spark, d), P.symbols(spark, d).where("repo <> 'ASIA'"))


@query(f"WITH {S} SELECT id, repo, file FROM sym WHERE NOT (repo = 'ASIA' AND file LIKE '%customers')")
def stale_reconcile(spark, d):
    s = P.symbols(spark, d).select("id", "repo", "file")
    return ledger.reconcile(s, s.where("file not like '%customers'").select("file").distinct(), "ASIA")


@query(f"WITH {S}, {E}, g AS (SELECT id FROM sym WHERE repo = 'EUROPE') SELECT * FROM edg WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)")
def hard_delete(spark, d):
    s = P.symbols(spark, d)
    return ledger.hard_delete(s, P.edges(spark, d), s.where("repo = 'EUROPE'"))[1]


@query(f"WITH {N} SELECT id, coalesce(superseded_at, CASE WHEN doc_id % 4 = 1 THEN '2026-02-01' END) AS superseded_at, CASE WHEN doc_id % 4 = 1 THEN 'n' || (doc_id + 1) END AS superseded_by FROM nodes")
def supersede(spark, d):
    n = P.nodes(spark, d)
    marks = n.where("doc_id % 4 = 1").select("id", F.concat(F.lit("n"), F.col("doc_id") + 1).alias("by"), F.lit("2026-02-01").alias("at"))
    return ledger.supersede(n, marks).select("id", "superseded_at", "superseded_by")


@query("WITH a AS (SELECT doc_id AS id, source AS v FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS id, lang AS v FROM documents WHERE doc_id % 3 = 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def ledger_union(spark, d):
    x = P.table(spark, d, "documents")
    return ledger.union_merge(x.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("v")), x.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("v")), ["id"])


def _lines(spark, d, header=None):
    n = P.nodes(spark, d)
    nodes = n.select("id", "type", "label", "content", "tags", "superseded_at")
    edges = n.select(F.col("id").alias("src"), F.concat(F.lit("n"), F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(10_000_000)).alias("dst"), F.lit("relates_to").alias("kind"))
    return ledger.export_lines(nodes, edges, header)


@query(
    f"WITH {N} SELECT 0 AS ord, '{{\"version\":1,\"exportedAt\":\"t\",\"sourceWorkspace\":\"w\",\"exportedTypes\":' || CAST(to_json(list_sort(list(DISTINCT type))) AS VARCHAR) || '}}' AS line FROM nodes "
    "UNION ALL SELECT 1, '{\"kind\":\"node\",\"id\":' || to_json(id) || ',\"type\":' || to_json(type) || ',\"label\":' || to_json(label) || coalesce(',\"content\":' || to_json(content), '') || ',\"tags\":' || to_json(array_to_string(tags, ',')) || coalesce(',\"supersededAt\":' || to_json(superseded_at), '') || '}' FROM nodes "
    "UNION ALL SELECT 2, '{\"kind\":\"edge\",\"sourceId\":\"' || id || '\",\"targetId\":\"n' || (doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 10000000 END) || '\",\"relation\":\"relates_to\"}' FROM nodes"
)
def ledger_export(spark, d):
    return _lines(spark, d, {"exported_at": "t", "workspace": "w"})


@query(f"WITH {N} SELECT id AS src, 'n' || (doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 10000000 END) AS dst, 'relates_to' AS kind, CASE WHEN doc_id % 3 = 0 AND doc_id + 1 IN (SELECT doc_id FROM nodes) THEN 'ok' ELSE 'deferred' END AS outcome FROM nodes")
def ledger_import(spark, d):
    return ledger.import_outcomes(ledger.parse_lines(_lines(spark, d).select("line")), spark.createDataFrame([], "id string"))


@query(f"WITH {N} SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'replaced' ELSE 'new' END AS outcome FROM nodes")
def ledger_import_nodes(spark, d):
    parsed = ledger.parse_lines(_lines(spark, d).select("line"))
    return ledger.import_nodes(parsed, P.nodes(spark, d).where("doc_id % 2 = 0").select("id"))


@query("SELECT doc_id AS id, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0) GROUP BY 1 HAVING count(*) > 1")
def id_collisions(spark, d):
    x = P.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return ledger.collisions([("a", x.where("id % 2 = 0")), ("b", x.where("id % 3 = 0"))])


@query("SELECT doc_id % 100 AS id, source AS member, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS member_ord, count(*) AS n FROM documents d WHERE CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) = (SELECT min(CAST(regexp_extract(e.source, '([0-9]+)', 1) AS INT)) FROM documents e WHERE e.doc_id % 100 = d.doc_id % 100) GROUP BY 1, 2, 3")
def group_ownership(spark, d):
    x = P.table(spark, d, "documents").select((F.col("doc_id") % 100).alias("id"), F.col("source").alias("member"), F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("member_ord"))
    return ledger.first_owner(x.groupBy("id", "member", "member_ord").agg(F.count("*").alias("n")))


@query("WITH a AS (SELECT doc_id AS file, n_chars AS size FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS file, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 6 <> 0) SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'added' WHEN b.file IS NULL THEN 'removed' WHEN a.size = b.size THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.file = b.file")
def incremental_manifest(spark, d):
    x = P.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.lit(1).alias("mtime"), F.col("n_chars").alias("size"))
    return ledger.manifest_diff(x.where("file % 5 <> 0"), x.where("file % 6 <> 0").withColumn("size", F.col("size") + F.when(F.col("file") % 7 == 0, 1).otherwise(0)))


def _redact_sql() -> str:
    out = "text"
    for p in X.REDACTIONS:
        out = f"regexp_replace({out}, '{p}', '[REDACTED]', 'g')"
    return f"SELECT doc_id, md5({out}) AS digest FROM documents"


@query(_redact_sql())
def redact(spark, d):
    return P.table(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text"))).alias("digest"))


@query("SELECT doc_id AS file, 1 AS from_line, array_to_string(string_split(text, chr(10))[1:8], chr(10)) AS slice FROM documents")
def source_slice(spark, d):
    return code.source_slice(P.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")), 2, 3)


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(translate(l, chr(9) || chr(13), '  ')) <> '')) AS INT) AS loc FROM documents")
def line_counts(spark, d):
    return P.table(spark, d, "documents").select("doc_id", X.loc(F.col("text")).alias("loc"))


@query("SELECT doc_id, 'verbatim:' || sha256(text)[1:12] AS id, CAST(1 + ceil(greatest(0, length(text) - 1200) / 1050.0) AS BIGINT) AS chunks FROM documents WHERE text IS NOT NULL")
def verbatim_ids(spark, d):
    return P.table(spark, d, "documents").where("text is not null").select("doc_id", X.verbatim_id(F.col("text")).alias("id"), X.chunk_estimate(F.col("text")).alias("chunks"))


@query("SELECT event_id, CASE WHEN event_type IN ('calls', 'imports') THEN event_type ELSE 'calls' END AS relation, CASE WHEN event_id % 3 = 0 THEN 'file' WHEN event_id % 3 = 1 THEN 'knowledge' ELSE 'other' END AS class FROM events")
def relation_and_class(spark, d):
    node = F.when(F.col("event_id") % 3 == 0, F.lit("code-file:x")).when(F.col("event_id") % 3 == 1, F.lit("knowledge:x")).otherwise(F.lit("x"))
    return P.table(spark, d, "events").select("event_id", X.relation(F.col("event_type")).alias("relation"), X.node_class(node).alias("class"))


@query("WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/Pods/x.pyi' WHEN 1 THEN 'src/.Venv3/y.ts' WHEN 2 THEN 'src/z.go' ELSE 'lib/w.unknown' END AS path FROM documents) SELECT doc_id, doc_id % 4 < 2 AS skipped, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' END AS language FROM p")
def file_predicates(spark, d):
    k = F.col("doc_id") % 4
    path = F.when(k == 0, "a/Pods/x.pyi").when(k == 1, "src/.Venv3/y.ts").when(k == 2, "src/z.go").otherwise("lib/w.unknown")
    return P.table(spark, d, "documents").select("doc_id", X.skip_dir(path).alias("skipped"), X.language_of(path).alias("language"))


@query(f"WITH {E}, b AS (SELECT src AS id, dst AS o FROM edg UNION SELECT dst, src FROM edg) SELECT id, count(*) AS degree, round(least(1.8, 1 + log2(1 + count(*)) / 10), 6) AS size FROM b GROUP BY 1")
def drilldown_degree(spark, d):
    return views.degrees(P.edges(spark, d))


@query(f"WITH {N} SELECT type, count(*) AS visible FROM nodes WHERE type <> 'convention' AND project IN ('src1', 'src2', 'src3') GROUP BY 1")
def visible_stats(spark, d):
    return views.visible(P.nodes(spark, d), ["convention"], ["src1", "src2", "src3"])


@query("WITH c AS (SELECT conv_id, turn, text, CAST(1 + ceil(greatest(0, length(text) - 1200) / 1050.0) AS BIGINT) AS c FROM conversations), r AS (SELECT conv_id % 10 AS workspace, conv_id || ':' || turn AS id, (row_number() OVER w - 1) // 5 AS a, CAST((sum(c) OVER w - c) AS BIGINT) // 32 AS b FROM c WINDOW w AS (PARTITION BY conv_id % 10 ORDER BY turn, conv_id || ':' || turn ROWS UNBOUNDED PRECEDING)) SELECT workspace, id, greatest(a, b) AS batch FROM r")
def flush_batches(spark, d):
    q = P.table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("workspace"), F.col("turn").alias("at"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return verbatim.flush_batches(q)


@query("SELECT user_id AS workspace, count(*) AS pending, count(*) FILTER (event_type = 'error') AS failures, min(ts) AS oldest FROM events GROUP BY 1")
def queue_health(spark, d):
    return verbatim.health(P.table(spark, d, "events").select(F.col("user_id").alias("workspace"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed")))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    x = verbatim.windowed(P.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return x.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {N}, m AS (SELECT id FROM nodes WHERE type = 'decision' UNION SELECT id FROM nodes WHERE superseded_at IS NOT NULL) SELECT id FROM m")
def citations(spark, d):
    n = P.nodes(spark, d)
    return views.citations([n.where("type = 'decision'"), n.where("superseded_at is not null")])


from . import index, ingest  # noqa: E402, F401  they enter their queries
