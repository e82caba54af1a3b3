"""Analytics over the code graph: dead code, hotspots, coupling, layers, drift, risk, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dirname
from .graph import cut, of_kinds

#: Names that are entry points by convention, as fixed values.
ENTRY_NAMES = ["main", "run", "start", "init", "register", "default", "index", "handler", "handle", "execute", "serve", "listen", "bootstrap"]


def entry_point(name: Column, file: Column, parent_kind: Column) -> Column:
    """What no edge has to reach: entry names, register*, test files and callables inside a function or method."""
    test = file.contains("/test/") | file.contains(".test.") | file.contains(".spec.")
    return name.isin(ENTRY_NAMES) | name.startswith("register") | test | F.coalesce(parent_kind.isin("function", "method"), F.lit(False))


def dead_code(symbols: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "method", "class"), exempt: Column | None = None) -> DataFrame:
    """Callable symbols that nothing calls or imports, less entry points (or what `exempt` says instead)."""
    parents = symbols.select(F.col("id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    used = of_kinds(edges).select(F.col("dst").alias("id")).distinct()
    free = entry_point(F.col("name"), F.col("file"), F.col("parent_kind")) if exempt is None else exempt
    return symbols.where(F.col("kind").isin(*kinds)).join(used, "id", "left_anti").join(parents, "parent_id", "left").where(~free).select("id", "name", "kind", "file")


def hotspots(symbols: DataFrame, churn: DataFrame, least: int = 2, top: int = 50) -> DataFrame:
    """Complexity times churn (one where unknown), the top by score, then id."""
    score = F.col("complexity") * F.coalesce(F.when(F.col("churn") > 0, F.col("churn")), F.lit(1))
    return symbols.where(F.col("complexity") >= least).join(churn, "file", "left").select("id", "file", "complexity", score.cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(top)


def cross_module(symbols: DataFrame, edges: DataFrame, module: Column | None = None) -> DataFrame:
    """(from_module, to_module, kind) of every edge between two modules; edges from file: sources do not count."""
    m = symbols.select("id", (dirname(F.col("file")) if module is None else module).alias("m"))
    both = edges.where(~F.col("src").startswith("file:")).join(m.select(F.col("id").alias("src"), F.col("m").alias("from_module")), "src").join(m.select(F.col("id").alias("dst"), F.col("m").alias("to_module")), "dst")
    return both.where("from_module <> to_module").select("from_module", "to_module", "kind")


def coupling(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Efferent and afferent coupling and instability of each module (edge multiplicity counts)."""
    pairs = cross_module(symbols, of_kinds(edges)).groupBy("from_module", "to_module").agg(F.count("*").alias("n"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("from_module").alias("module"), F.col("n").alias("ce"), F.lit(0).cast("long").alias("ca")), F.struct(F.col("to_module").alias("module"), F.lit(0).cast("long").alias("ce"), F.col("n").alias("ca")))).alias("x"))
    size = symbols.groupBy(dirname(F.col("file")).alias("module")).agg(F.count("*").alias("symbols"))
    both = ends.groupBy("x.module").agg(F.sum("x.ce").alias("ce"), F.sum("x.ca").alias("ca"))
    ce, ca = F.coalesce("ce", F.lit(0)).cast("long"), F.coalesce("ca", F.lit(0)).cast("long")
    return size.join(both, "module", "left").select("module", "symbols", ce.alias("ce"), ca.alias("ca"), F.round(F.when(ce + ca > 0, ce / (ce + ca)), 6).alias("instability"))


def tectonic(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Weights between modules by kind, and whether the edge is half of a two-cycle."""
    w = cut(cross_module(symbols, of_kinds(edges)).groupBy("from_module", "to_module").agg(F.count("*").alias("weight"), F.count(F.when(F.col("kind") == "calls", 1)).alias("calls"), F.count(F.when(F.col("kind") == "imports", 1)).alias("imports")))  # both sides of the join read it
    back = w.select(F.col("to_module").alias("from_module"), F.col("from_module").alias("to_module"), F.lit(True).alias("b"))
    return w.join(back, ["from_module", "to_module"], "left").select("from_module", "to_module", "weight", "calls", "imports", F.col("b").isNotNull().alias("cyclic"))


def layer_of(file: Column, layers: list[tuple[str, str]]) -> Column:
    """The first layer whose pattern fits the file, else null. layers: (name, regular expression) in order."""
    out: Column | None = None
    for name, pattern in layers:
        out = F.when(file.rlike(pattern), name) if out is None else out.when(file.rlike(pattern), name)
    return out if out is not None else F.lit(None).cast("string")


def layer_violations(symbols: DataFrame, edges: DataFrame, layers: list[tuple[str, str]], allowed: list[tuple[str, str]]) -> DataFrame:
    at = symbols.select("id", layer_of(F.col("file"), layers).alias("layer"))
    both = of_kinds(edges).join(at.select(F.col("id").alias("src"), F.col("layer").alias("from_layer")), "src").join(at.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    ok = F.concat_ws(">", "from_layer", "to_layer").isin([f"{a}>{b}" for a, b in allowed])
    return both.where(F.col("from_layer").isNotNull() & F.col("to_layer").isNotNull() & (F.col("from_layer") != F.col("to_layer")) & ~ok).select("src", "dst", "kind", "from_layer", "to_layer")


def schema_drift(live: DataFrame, declared: DataFrame) -> DataFrame:
    """Tables of two schemas (name, columns) by lower-cased name: where each stands and which columns differ."""

    def by_name(df, side):
        cols = F.array_distinct(F.flatten(F.collect_list(F.transform("columns", F.lower))))
        return df.groupBy(F.lower("name").alias("table")).agg(cols.alias(side))

    both = by_name(live, "a").join(by_name(declared, "b"), "table", "full_outer")
    status = F.when(F.col("b").isNull(), "only_live").when(F.col("a").isNull(), "only_declared").when((F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))) > 0, "columns").otherwise("same")
    text = lambda c: F.array_join(F.sort_array(c), ",")
    return both.select("table", status.alias("status"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), text(F.array_except("a", "b"))).alias("missing_declared"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), text(F.array_except("b", "a"))).alias("missing_live"))


#: Lines of a bucket of changed_symbols.
LINES = 256


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols (file, start_line, end_line) that overlap a changed range (file, range_start, range_end).

    Both sides go to buckets of LINES lines, so a file with many symbols and ranges is not paired up.
    """

    def bucketed(df, lo, hi):
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / LINES), F.floor(F.greatest(lo, hi) / LINES))))

    hit = bucketed(symbols, "start_line", "end_line").join(bucketed(ranges.select("file", "range_start", "range_end"), "range_start", "range_end"), ["file", "_bucket"])
    return hit.where("start_line <= range_end and end_line >= range_start").select(*symbols.columns).distinct()


def pr_risk(changed: DataFrame, edges: DataFrame, churn: DataFrame) -> DataFrame:
    """max(direct dependents, 1) * max(complexity, 1) * ln(1 + churn) of each changed symbol, and the change set's total and band.

    The band goes by the largest score (5, 20, 50) or the total (20, 80, 200), whichever says more.
    """
    inbound = of_kinds(edges).select("src", F.col("dst").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("n"))
    score = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) * F.greatest("complexity", F.lit(1)) * F.log1p(F.coalesce("churn", F.lit(0)).cast("double"))
    each = changed.join(inbound, "id", "left").join(churn, "file", "left").withColumn("score", score)
    whole = each.agg(F.sum("score").alias("total"), F.max("score").alias("most"))
    at_least = lambda most, total: (F.col("most") >= most) | (F.col("total") >= total)
    band = F.when(at_least(50, 200), "critical").when(at_least(20, 80), "high").when(at_least(5, 20), "medium").otherwise("low")
    one = whole.select(F.round("total", 2).alias("total_score"), band.alias("band"))
    return each.crossJoin(F.broadcast(one)).select("id", "file", F.round("score", 2).alias("score"), "total_score", "band")  # one row


def alerts(dead: DataFrame, hot: DataFrame, drift: DataFrame) -> DataFrame:
    a = dead.select(F.lit("dead_code").alias("type"), F.col("id").alias("subject"), F.lit("medium").alias("severity"))
    b = hot.select(F.lit("hotspot").alias("type"), F.col("id").alias("subject"), F.when(F.col("score") > 10, "high").when(F.col("score") > 5, "medium").otherwise("low").alias("severity"))
    c = drift.where("status <> 'same'").select(F.lit("schema_drift").alias("type"), F.col("table").alias("subject"), F.lit("high").alias("severity"))
    return a.unionByName(b).unionByName(c)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (measure, value): node and edge counts, nodes by type, distinct projects."""
    by_type = nodes.groupBy("type").count().select(F.concat(F.lit("type:"), "type").alias("measure"), F.col("count").alias("value"))
    total = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("project").alias("projects")).select(F.explode(F.create_map(F.lit("nodes"), "nodes", F.lit("projects"), "projects")).alias("measure", "value"))
    return by_type.unionByName(total).unionByName(edges.agg(F.count("*").alias("value")).select(F.lit("edges").alias("measure"), "value"))
