"""URL filtering by rules and by trust propagated over the host graph, with DataFrame functions only.

Rules come first: a rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the
rule's; the longest wins. Every other url takes its host's verdict: personalised PageRank runs from trusted hosts along
host edges, and from blocked hosts against them; a host is blocked if distrust is over THRESHOLD of trust and distrust.
Host edges are absolute links in a page's HTML, and a host and its parent domain link each other, as a subdomain's
owner answers for both. A host's seed weights are its numbers of pages that rules allow and block.

Null urls and urls without :// have empty host and path, fit no rule and, being reached by nothing, are allowed, as is
any host that neither propagation reaches. Null html has no links. Repeated rows are judged each; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: The rules of the contract, as fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DAMPING, ITERATIONS, THRESHOLD, CHECKPOINT_EVERY = 0.85, 12, 0.5, 6
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    out: Column | None = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): host links, counted. pages has host and html."""
    links = pages.where("html is not null and host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?(\w+://[^\"'\s>]+)"), 1), host_of))).alias("dst"))
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    kin = hosts.where(F.size(F.split("host", "[.]")) > 2).select(F.col("host").alias("src"), parent.alias("dst"), F.col("n").alias("w"))
    linked = links.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    both = linked.unionByName(kin).unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust): PageRank personalised on seeds (host, good, bad), distrust over reversed edges.

    The mass of hosts without edges is not handed on. Every step is one join of the edges with the ranks at either end,
    pre-aggregated by host; lineage is cut every few steps by a table in the shared folder.
    """
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    g, b = float(total["g"] or 0) or 1.0, float(total["b"] or 0) or 1.0
    out = edges.groupBy("src").agg(F.sum("w").alias("t"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("t"))
    moves = edges.join(out, "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("w") / F.col("t")).alias("f"), F.lit(0.0).alias("r"))
    moves = moves.unionAll(edges.join(into, "dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("f"), (F.col("w") / F.col("t")).alias("r")))
    moves = written(moves.groupBy("at", "to").agg(F.sum("f").alias("f"), F.sum("r").alias("r")))
    start = written(seeds.select("host", (F.col("good") / g).alias("trust"), (F.col("bad") / b).alias("distrust")))
    rank = start
    for step in range(1, iterations + 1):
        moved = moves.join(rank, F.col("at") == F.col("host")).select(F.col("to").alias("host"), (damping * F.col("f") * F.col("trust")).alias("trust"), (damping * F.col("r") * F.col("distrust")).alias("distrust"))
        again = start.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
        rank = moved.unionAll(again).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if step % CHECKPOINT_EVERY == 0 or step == iterations:
            rank = written(rank)
    return rank


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    base = base.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    hit = F.col("_r.verdict")
    seeds = base.where("host <> ''").groupBy("host").agg(F.count(F.when(hit == "allow", 1)).alias("good"), F.count(F.when(hit == "block", 1)).alias("bad"))
    rank = propagate(host_edges(base), seeds)
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return base.drop("html").join(rank, "host", "left").select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(hit, F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
