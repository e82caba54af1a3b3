"""Communities of a file graph: detection by modularity, labels, stable ids, listing, links and coupling insights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import basename, camel_tokens, fnv1a8
from .graph import cut, free, sccs
from .scan import ranked

#: Share of a community's files that a common folder has to hold.
SHARE = 0.6
#: Folder names that say nothing, as fixed values.
PLAIN_SEGMENTS = ["", "src", "lib", "app", "apps", "pkg", "pkgs", "packages", "source", "sources", "code", "main", "index"]
#: Leading verbs of symbol names that say nothing, as fixed values.
PLAIN_VERBS = ["get", "set", "is", "has", "handle", "do", "make", "build", "create", "new", "run", "init", "fn", "on", "add", "remove", "update", "delete", "find", "to", "from", "with", "use"]
#: Layers (rank, name, pattern of a folder), as fixed values; the first that fits counts.
LAYERS = [
    (1, "presentation", r"(?i)(^|[/.])(apps|web|ui|components|pages|views|client|frontend|screens)([/.]|$)"),
    (2, "api", r"(?i)(^|[/.])(api|handlers?|controllers?|endpoints?|routes?|mcp|graphql|rest)([/.]|$)"),
    (3, "domain", r"(?i)(^|[/.])(domain|core|services?|model|models|entities|dsl|logic|usecases?|projection)([/.]|$)"),
    (4, "data", r"(?i)(^|[/.])(persistence|storage|repositor(y|ies)|dao|db|database|migrations?|store|entities)([/.]|$)"),
    (5, "infra", r"(?i)(^|[/.])(connectors?|adapters?|infra|infrastructure|gateways?|drivers?)([/.]|$)"),
]
#: Distinct dependents of a hub; rank gap of an inversion; the rank that may depend on anything.
HUB, GAP, EXEMPT_RANK = 3, 2, 5


def coupling_edges(edges: DataFrame, files_of: DataFrame) -> DataFrame:
    """(src, dst) between different files of edges(src, dst, kind), by files_of(id, file).

    Containment and descriptions do not couple, nor do folders and imported packages.
    """
    keep = edges.where(~F.col("kind").isin("contains", "describes"))
    for c in ("src", "dst"):
        keep = keep.where(~F.col(c).startswith("code-folder:") & ~F.col(c).startswith("code-import:"))
    at = keep.join(files_of.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(files_of.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    return at.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 60, levels: int = 30) -> DataFrame:
    """(id, community): modularity optimisation over the undirected simple graph; a community is named by its smallest id.

    Each level moves nodes to the neighbouring community of largest gain (ties: the smallest name) until nothing wants
    to move, a random half of the willing at a time so that neighbours do not swap for ever; then communities become the
    nodes of the next level. It ends when a level moves nothing. Nodes without edges are alone. Tables as large as the graph
    are merged in every turn rather than broadcast through the driver.
    """
    ids = nodes.select("id").distinct()
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    pairs = pairs.join(ids.withColumnRenamed("id", "u").hint("merge"), "u", "left_semi").join(ids.withColumnRenamed("id", "v").hint("merge"), "v", "left_semi").select("u", "v", F.lit(1.0).alias("w"))
    links = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    total = links.agg(F.sum("w")).first()[0] or 0.0
    member = cut(ids.select("id", F.col("id").alias("c")))
    for level in range(levels):
        if not total:
            break
        degree = cut(links.groupBy("u").agg(F.sum("w").alias("k")))
        label = cut(degree.select("u", F.col("u").alias("c")))
        moved_any = False
        for turn in range(rounds):
            own = label.join(degree.hint("merge"), "u")
            size = own.groupBy("c").agg(F.sum("k").alias("tot"))
            near = links.where("u <> v").join(label.select(F.col("u").alias("v"), "c").hint("merge"), "v").groupBy("u", "c").agg(F.sum("w").alias("win"))
            cost = resolution * F.col("k") / total
            stay = own.join(near.hint("merge"), ["u", "c"], "left").join(size.hint("merge"), "c").select("u", F.col("c").alias("c0"), "k", (F.coalesce("win", F.lit(0.0)) - cost * (F.col("tot") - F.col("k"))).alias("now"))
            go = near.join(stay.hint("merge"), "u").where("c <> c0").join(size.hint("merge"), "c").withColumn("gain", F.col("win") - cost * F.col("tot") - F.col("now")).where("gain > 1e-9")
            best = go.groupBy("u").agg(F.min(F.struct((-F.round("gain", 9)).alias("g"), "c")).getField("c").alias("to"))
            wish = cut(label.join(best.hint("merge"), "u", "left"))
            if not wish.where("to is not null").limit(1).count():
                free(wish)
                break
            moved_any = True
            half = F.pmod(F.xxhash64("u", F.lit(level * rounds + turn)), F.lit(2)) == 0
            new = cut(wish.select("u", F.when(F.col("to").isNotNull() & half, F.col("to")).otherwise(F.col("c")).alias("c")))
            free(wish)
            free(label)
            label = new
        else:
            raise RuntimeError("communities did not settle")
        free(degree)
        if not moved_any:
            free(label)
            break
        at = label.select(F.col("u").alias("c"), F.col("c").alias("to"))
        merged = cut(member.join(at.hint("merge"), "c", "left").select("id", F.coalesce("to", "c").alias("c")))
        joined = links.join(label.select("u", F.col("c").alias("cu")).hint("merge"), "u").join(label.select(F.col("u").alias("v"), F.col("c").alias("cv")).hint("merge"), "v")
        next_links = cut(joined.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
        for old in (member, links, label):
            free(old)
        member, links = merged, next_links
    names = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(names.hint("merge"), "c").select("id", "community")


def labels(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """(community, label, rationale) of members(community, file) and symbols(file, name).

    The last telling segment of the longest folder that holds SHARE of the files; else the most frequent root of symbol
    names (without a leading verb); else `community-<number>`, numbered by smallest file.
    """
    m = members.select("community", "file").distinct()
    size = m.groupBy("community").agg(F.count("*").alias("n"), F.min("file").alias("first"))
    parts = F.split("file", "/")
    depth = F.size(parts) - 1
    ups = m.withColumn("parts", parts).where(depth >= 1).select("community", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("parts", F.lit(1), i), "/").alias("prefix")))).alias("x"))
    common = ups.groupBy("community", "x.depth", "x.prefix").agg(F.count("*").alias("k")).join(size, "community").where(F.col("k") >= F.ceil(F.col("n") * SHARE))
    best = common.groupBy("community").agg(F.max_by("prefix", F.struct("depth", "k")).alias("prefix"))
    telling = F.filter(F.split("prefix", "/"), lambda s: ~F.lower(s).isin(PLAIN_SEGMENTS))
    by_folder = best.select("community", "prefix", F.when(F.size(telling) > 0, F.element_at(telling, -1)).alias("folder"))
    tokens = camel_tokens(F.col("name"))
    root = F.when((F.size(tokens) > 1) & F.get(tokens, F.lit(0)).isin(PLAIN_VERBS), F.get(tokens, F.lit(1))).otherwise(F.get(tokens, F.lit(0)))
    roots = m.join(symbols.select("file", root.alias("root")).where("root is not null"), "file").groupBy("community", "root").agg(F.count("*").alias("k"))
    by_root = roots.groupBy("community").agg(F.min(F.struct((-F.col("k")).alias("k"), "root")).getField("root").alias("root"))
    left = size.join(by_folder, "community", "left").join(by_root, "community", "left")
    lost = ranked(left.where("folder is null and root is null").select("community", "first", F.lit(0).alias("all")), "all", ["first", "community"])
    unnamed = lost.select("community", F.concat(F.lit("community-"), F.col("rank") - 1).alias("other"))
    label = F.coalesce("folder", "root", "other")
    why = F.when(F.col("folder").isNotNull(), F.concat(F.lit(f"{round(SHARE * 100)}%+ share prefix "), "prefix")).when(F.col("root").isNotNull(), F.concat(F.lit("top symbol root: "), "root")).otherwise(F.lit("no common prefix or symbol root"))
    return left.join(unnamed, "community", "left").select("community", label.alias("label"), why.alias("rationale"))


def _slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stable_ids(labelled: DataFrame, members: DataFrame) -> DataFrame:
    """(community, stable_id): slug of the label, ~, slug of the smallest file's name without extension.

    Of communities with the same id the one with the smallest file keeps it, the next gets a hash of its file names
    appended, and where that is taken too also its number in the order of smallest files.
    """
    files = members.select("community", "file").distinct().groupBy("community").agg(F.min("file").alias("first"), F.array_join(F.sort_array(F.collect_list(basename(F.col("file")))), "|").alias("names"))
    base = F.when(F.col("label").rlike(r"^community-\d+$"), F.lit("community")).otherwise(_slug(F.col("label")))
    anchor = _slug(F.regexp_replace(basename(F.col("first")), r"\.[^.]+$", ""))
    orelse = lambda c, d: F.when(c == "", d).otherwise(c)
    x = labelled.join(files, "community").select("community", "first", F.concat_ws("~", orelse(base, F.lit("community")), orelse(anchor, F.lit("unnamed"))).alias("bare"), fnv1a8(F.col("names")).alias("hash"))
    order = ["first", "community"]
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy("bare").orderBy(*order)))
    x = ranked(x.withColumn("all", F.lit(0)), "all", order).withColumn("number", F.col("rank") - 1)
    later = F.row_number().over(Window.partitionBy("bare", "hash", F.col("turn") > 1).orderBy(*order))
    x = x.withColumn("later", later)
    return x.select("community", F.when(F.col("turn") == 1, F.col("bare")).when(F.col("later") == 1, F.concat_ws("~", "bare", "hash")).otherwise(F.concat_ws("~", "bare", "hash", F.col("number").cast("string"))).alias("stable_id"))


def layer_of(folder: Column, field: str = "name") -> Column:
    """Name (or rank) of the first layer whose words the folder has, else null."""
    out: Column | None = None
    for rank, name, pattern in LAYERS:
        value = F.lit(name if field == "name" else rank)
        out = F.when(folder.rlike(pattern), value) if out is None else out.when(folder.rlike(pattern), value)
    return out


def _most_common(df: DataFrame, value: Column, name: str) -> DataFrame:
    counted = df.select("community", value.alias(name)).where(f"{name} <> ''").groupBy("community", name).agg(F.count("*").alias("k"))
    return counted.groupBy("community").agg(F.min(F.struct((-F.col("k")).alias("k"), name)).getField(name).alias(name))


def listing(members: DataFrame, symbols: DataFrame, least: int = 2, sample: int = 5) -> DataFrame:
    """One row a community of at least `least` files: stable id, label, counts, samples, dominant folder and its layer."""
    m = members.select("community", "file").distinct()
    big = m.groupBy("community").agg(F.count("*").alias("file_count")).where(F.col("file_count") >= least)
    m = m.join(big.select("community"), "community")
    lab = labels(m, symbols)
    first = lambda c: F.slice(F.sort_array(F.collect_set(c)), 1, sample)
    files = m.groupBy("community").agg(first("file").alias("sample_files"))
    names = m.join(symbols.select("file", "name"), "file").groupBy("community").agg(F.count("*").alias("symbol_count"), first("name").alias("sample_symbols"))
    segs = F.split("file", "/")
    folder = _most_common(m, F.when(F.size(segs) >= 2, F.array_join(F.slice(segs, 1, 2), "/")).otherwise(segs[0]), "folder")
    out = big.join(lab, "community").join(stable_ids(lab, m), "community").join(files, "community").join(names, "community", "left").join(folder, "community", "left")
    return out.select(F.col("stable_id").alias("id"), "label", "rationale", "file_count", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), "sample_files", "sample_symbols", "folder", layer_of(F.col("folder")).alias("layer"))


def directed_links(file_edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, weight) between communities, from edges(src, dst) between files."""
    at = members.select("file", "community")
    both = file_edges.join(at.select(F.col("file").alias("src"), F.col("community").alias("a")), "src").join(at.select(F.col("file").alias("dst"), F.col("community").alias("b")), "dst")
    return both.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))


def insights(links: DataFrame, layers: DataFrame) -> DataFrame:
    """(finding, src, dst): cycle members, hubs and inversions of links(src, dst); layers(community, rank).

    `cycle`: src in the cycle named dst; `hub`: src with HUB or more dependents (dst: how many) outside of cycles;
    `inversion`: src depends on dst, GAP or more ranks nearer the surface.
    """
    cycles = sccs(links.select("src", "dst"))
    hubs = links.groupBy("dst").agg(F.countDistinct("src").alias("n")).where(F.col("n") >= HUB).join(cycles.select(F.col("id").alias("dst")), "dst", "left_anti")
    at = layers.select("community", "rank")
    ranked = links.join(at.select(F.col("community").alias("src"), F.col("rank").alias("a")), "src").join(at.select(F.col("community").alias("dst"), F.col("rank").alias("b")), "dst")
    turned = ranked.where((F.col("a") != EXEMPT_RANK) & (F.col("a") - F.col("b") >= GAP))
    parts = [cycles.select(F.lit("cycle").alias("finding"), F.col("id").alias("src"), F.col("component").alias("dst")), hubs.select(F.lit("hub").alias("finding"), F.col("dst").alias("src"), F.col("n").cast("string").alias("dst")), turned.select(F.lit("inversion").alias("finding"), "src", "dst")]
    return reduce(DataFrame.unionByName, parts)


def links_of(links: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, weight, cyclic, violation) of undirected pairs of communities, flagged by insights()."""
    pair = lambda df: df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *[c for c in df.columns if c not in ("src", "dst")])
    cycle = found.where("finding = 'cycle'")
    inside = links.join(cycle.select("src", F.col("dst").alias("x")), "src").join(cycle.select(F.col("src").alias("dst"), F.col("dst").alias("y")), "dst").where("x = y").select("src", "dst")
    flag = lambda df, name: pair(df).select("a", "b").distinct().withColumn(name, F.lit(True))
    out = pair(links).groupBy("a", "b").agg(F.sum("weight").alias("weight")).join(flag(inside, "cyclic"), ["a", "b"], "left").join(flag(found.where("finding = 'inversion'").select("src", "dst"), "violation"), ["a", "b"], "left")
    return out.select("a", "b", "weight", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("violation", F.lit(False)).alias("violation"))
