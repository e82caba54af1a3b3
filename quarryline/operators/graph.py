"""Graph operators over symbols(id, name, kind, repo, file, complexity, parent_id) and edges(src, dst, kind)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at_exit(spark, path: str) -> None:
    """Delete a table that is still there; a session that has ended takes its folder along."""
    if spark.sparkContext._jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_dir(spark) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs in this process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quarryline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read back: cuts the lineage of a loop."""
    spark = df.sparkSession
    base = shared_dir(spark)
    path = f"{base}/quarryline-loops/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarryline_path = path
    return out


def free(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quarryline_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def of_kinds(edges: DataFrame, kinds: tuple[str, ...] = ("calls", "imports")) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds))


def reach(edges: DataFrame, start: str, depth: int = 3, upstream: bool = True) -> DataFrame:
    """(id, depth) of what is within `depth` steps of start, each in its first tier; start itself is left out.

    The edges are written once, in the direction of the search, and repeated ones stay: a hop takes its new nodes once. Each
    hop is a table of its own, so a later one does not compute it again, and a small one is broadcast by its size.
    """
    a, b = ("dst", "src") if upstream else ("src", "dst")
    steps = cut(edges.select(F.col(a).alias("at"), F.col(b).alias("id")))
    frontier = edges.sparkSession.createDataFrame([(start,)], "id string")
    seen = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        nxt = cut(steps.join(frontier.withColumnRenamed("id", "at"), "at").select("id").distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        frontier, seen = nxt.select("id"), seen.unionByName(nxt)
        if d < depth and not nxt.limit(1).count():
            break
    free(steps)
    return seen.where("depth > 0")


def blast_radius(symbols: DataFrame, edges: DataFrame, start: str, depth: int = 3, upstream: bool = True) -> DataFrame:
    """Reached symbols with file, kind and depth; ids that are no symbols carry the search but are not shown."""
    return reach(edges, start, depth, upstream).join(symbols.select("id", "name", "file", "kind"), "id")


def entries(symbols: DataFrame, asked: list[str]) -> DataFrame:
    """(entry, id, n, first): the symbols that each asked entry of a trace may mean, how many, and whether a trace starts here.

    Those of that name; else the symbol of that id; else those whose id ends so. The smallest id is first. One pass over
    the symbols for all that is asked.
    """
    each = F.explode(F.filter(F.array(*[F.lit(a) for a in dict.fromkeys(asked)]).cast("array<string>"), lambda a: (F.col("name") == a) | F.col("id").endswith(a)))
    hit = symbols.select("id", "name", each.alias("entry"))
    tier = F.when(F.col("name") == F.col("entry"), 0).when(F.col("id") == F.col("entry"), 1).otherwise(2)
    hit = hit.select("entry", "id", tier.alias("tier")).distinct()
    best = hit.groupBy("entry").agg(F.min("tier").alias("best"))
    kept = hit.join(best, "entry").where("tier = best")
    first = kept.groupBy("entry").agg(F.min("id").alias("_first"), F.count("*").alias("n"))
    return kept.join(first, "entry").select("entry", "id", "n", (F.col("id") == F.col("_first")).alias("first"))


def trace(symbols: DataFrame, edges: DataFrame, start: str, depth: int = 8, most: int = 200) -> DataFrame:
    """Downstream steps in order (depth, id), at most `most`, with whether a step calls nothing."""
    calls = of_kinds(edges, ("calls",)).where("src <> dst").join(symbols.select(F.col("id").alias("src")), "src", "left_semi").join(symbols.select(F.col("id").alias("dst")), "dst", "left_semi")
    got = reach(calls, start, depth, upstream=False).unionByName(edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int"))
    busy = calls.select(F.col("src").alias("id")).distinct().withColumn("_busy", F.lit(True))
    return got.join(busy, "id", "left").select("id", "depth", F.col("_busy").isNull().alias("terminal")).orderBy("depth", "id").limit(most)


class _Ranks:
    """The power steps of PageRank over distinct links; tables of links and ids are written once.

    Nodes are numbered, so that a step shuffles numbers rather than names; names come back with the ranks. A step reads the
    ranks twice, so its plan doubles; every `every` steps they are written. Links to what is no node count for their source only.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, alpha: float, every: int):
        self.names = cut(nodes.select("id").distinct().withColumn("node", F.monotonically_increasing_id()))
        at = self.names.hint("merge")
        links = edges.select("src", "dst").repartition("src").distinct().join(at.select(F.col("id").alias("src"), F.col("node").alias("from")), "src").select("from", "dst")
        links = links.join(at.select(F.col("id").alias("dst"), F.col("node").alias("to")), "dst", "left").select("from", "to")
        # Kept on the executors' disks by source, so that a step shuffles ranks and gains but no links.
        self.links = links.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "from").persist(StorageLevel.DISK_ONLY)
        self.sources = cut(self.links.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("deg")))
        self.ids = self.names.select(F.col("node").alias("id"))
        self.n, self.alpha, self.every = self.ids.count(), alpha, every

    def start(self) -> DataFrame:
        return self.ids.withColumn("rank", F.lit(1.0 / max(1, self.n)))

    def step(self, rank: DataFrame) -> DataFrame:
        share = rank.join(self.sources.hint("merge"), "id").select(F.col("id").alias("from"), (F.col("rank") / F.col("deg")).alias("share"))
        gained = self.links.join(share.hint("merge"), "from").where("to is not null").groupBy(F.col("to").alias("id")).agg(F.sum("share").alias("got"))
        loose = rank.join(self.sources.hint("merge"), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))  # one row
        given = (1 - self.alpha) / self.n
        return self.ids.join(gained.hint("merge"), "id", "left").join(F.broadcast(loose)).select("id", (F.lit(given) + self.alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / self.n)).alias("rank"))

    def steps(self, rank: DataFrame, n: int) -> DataFrame:
        last = None
        for k in range(1, n + 1):
            rank = self.step(rank)
            if k % self.every == 0:
                rank = cut(rank)
                if last is not None:
                    free(last)
                last = rank
        return rank

    def named(self, rank: DataFrame) -> DataFrame:
        """(id, rank) by the nodes' own ids."""
        return self.names.join(rank.withColumnRenamed("id", "node").hint("merge"), "node").select("id", "rank")

    def free(self) -> None:
        self.links.unpersist()
        for table in (self.sources, self.names):
            free(table)


def pagerank_top(nodes: DataFrame, edges: DataFrame, top: int = 50, tol: float = 1e-6, most: int = 1000, alpha: float = 0.85) -> DataFrame:
    """The `top` (id, rank) once a step changes the ranks by less than tol a node; no rows if `most` steps do not get there.

    Edges from file: sources do not count. The change is looked at after every tenth step.
    """
    ranks = _Ranks(nodes, edges.where(~F.col("src").startswith("file:")), alpha, 3)
    old, done = ranks.start(), 0
    while done < most and ranks.n:
        before = ranks.steps(old, 9)
        new = cut(ranks.step(before))
        done += 10
        change = new.join(before.select("id", F.col("rank").alias("before")).hint("merge"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
        free(before)
        if done > 10:
            free(old)
        old = new
        if change < tol * ranks.n:
            found = cut(ranks.named(old).orderBy(F.desc("rank"), "id").limit(top))
            free(old)
            ranks.free()
            return found.orderBy(F.desc("rank"), "id")
    ranks.free()
    return nodes.sparkSession.createDataFrame([], "id string, rank double")


def pagerank(nodes: DataFrame, edges: DataFrame, steps: int = 20, alpha: float = 0.85, every: int = 1) -> DataFrame:
    """(id, rank) after a fixed number of power steps; multiple edges count once, rank of nodes without out-edges is spread."""
    ranks = _Ranks(nodes, edges, alpha, every)
    found = cut(ranks.named(ranks.steps(ranks.start(), steps)))
    ranks.free()
    return found


def sccs(edges: DataFrame, least: int = 2, most_steps: int = 200) -> DataFrame:
    """(id, component, size): strongly connected components of at least `least` nodes, named by their smallest id.

    Forward-backward colouring: every node takes the largest id that reaches it; within a colour, what reaches the root
    backwards is a component, is removed, and the rest goes on. Nodes without in- or out-edges are trimmed first.
    """
    rest = cut(edges.select("src", "dst").where("src <> dst").distinct())
    found: DataFrame | None = None
    for _ in range(most_steps):
        while True:
            n = rest.count()
            rest2 = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
            rest2 = cut(rest2.join(rest2.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if rest2.count() == n:
                break
            rest = rest2
        if not n:
            rest = None
            break
        colour = rest.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id"))
        while True:
            got = rest.join(colour, rest["src"] == colour["id"]).select(F.col("dst").alias("id"), "c")
            new = cut(colour.select("id", "c").unionByName(got).groupBy("id").agg(F.max("c").alias("c")))
            same = new.join(colour, ["id", "c"], "left_anti").limit(1).count() == 0
            colour = new
            if same:
                break
        inside = rest.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        back = cut(colour.where("id = c"))
        while True:
            more = inside.join(back.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").unionByName(back).distinct()
            more = cut(more)
            if more.count() == back.count():
                break
            back = more
        found = back if found is None else found.unionByName(back)
        rest = cut(rest.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if rest is not None:
        raise RuntimeError("components are left after the last step")
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    groups = found.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("size")).where(F.col("size") >= least)
    return found.join(groups, "c").select("id", "component", "size")


#: Largest number of nodes of a subgraph and of a full graph.
SUBGRAPH_CEILING, FULL_CEILING = 1000, 8000


def subgraph(edges: DataFrame, centre: str | None = None, depth: int = 2, most: int = 200, seeds: DataFrame | None = None, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) around a centre, or around a community's seeds (id), by undirected search under a budget of nodes,
    and the edges among them. allowed(id): what may be entered, if not all.

    Each hop ranks its new nodes by their smallest neighbour in the frontier, then by id, and is cut at what is left.
    """
    if (centre is None) == (seeds is None):
        raise ValueError("exactly one of a centre and seeds")
    spark = edges.sparkSession
    most = max(1, min(most, SUBGRAPH_CEILING))
    both = edges.where("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("id")).unionAll(edges.where("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("id"))).distinct()
    if allowed is not None:
        both = both.join(allowed.select("id"), "id", "left_semi").select("at", "id")
    seen = spark.createDataFrame([(centre, 0)], "id string, depth int") if seeds is None else cut(seeds.select("id").distinct().orderBy("id").limit(most).withColumn("depth", F.lit(0)))
    frontier, left = seen.select("id"), most - (1 if seeds is None else seen.count())
    for d in range(1, depth + 1):
        if left <= 0:
            break
        new = both.join(frontier.withColumnRenamed("id", "at"), "at").join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("at").alias("by"))
        new = cut(new.orderBy("by", "id").limit(left).select("id", F.lit(d).alias("depth")))
        left -= new.count()
        frontier, seen = new.select("id"), seen.unionByName(new)
    return seen, induced(edges, seen)


def truncated(edges: DataFrame, nodes: DataFrame, depth: int) -> bool:
    """Whether nodes(id, depth) of a subgraph have neighbours within its depth that the budget left out."""
    inner = nodes.where(F.col("depth") < depth).select("id")
    out = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).unionAll(edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")))
    return out.join(nodes.select("id"), "id", "left_anti").limit(1).count() > 0


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, kind): the edges among nodes, undirected, each once."""
    ids = nodes.select("id")
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inside.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind").distinct()


def full_graph(nodes: DataFrame, order: dict[str, int], most: int = 3000) -> DataFrame:
    """The first `most` nodes by priority of their type, then id."""
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("type")]
    return nodes.withColumn("priority", F.coalesce(rank, F.lit(99))).orderBy("priority", "id").limit(max(1, min(most, FULL_CEILING)))


def folders(files: DataFrame) -> DataFrame:
    """(parent, child, child_is_file): containment of all ancestor folders and files; the root is '.'."""
    parts = F.split("file", "/")
    n = F.size(parts)
    ups = files.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), parts.alias("p"), n.alias("n"))
    path = F.when(F.col("i") == 0, F.lit(".")).otherwise(F.array_join(F.slice("p", 1, F.col("i")), "/"))
    child = F.array_join(F.slice("p", 1, F.col("i") + 1), "/")
    return ups.select(path.alias("parent"), child.alias("child"), (F.col("i") == F.col("n") - 1).alias("child_is_file")).distinct()
