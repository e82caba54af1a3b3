"""The stored graph: staged two-phase writes, one manifest swap each, compaction into a generation.

A write goes to a folder of its own, nodes before edges; edges are checked against the nodes that are stored or staged.
Then one manifest, a small JSON file that is renamed into place, names the folders that count. A write that dies
before that leaves the old state and folders that nothing names. A manifest lists deltas over a base; reading keeps each
id's newest row. Compaction writes a new base; folders that no manifest younger than the cut-off names are removed, so a
reader that opened an older state before that still finds its files.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Landed writes between two folds, and the age in seconds after which unnamed folders go.
FOLD_EVERY, CUTOFF = 5, 900
NODES = "id string, type string, label string, content string, file string"
EDGES = "src string, dst string, kind string, file string"
_KEYS = {"nodes": ["id"], "edges": ["src", "dst", "kind", "file"], "gone": ["id"], "left": ["file"]}
_SCHEMAS = {"nodes": NODES, "edges": EDGES, "gone": "id string", "left": "file string"}


class Store:
    """A graph in a folder that the driver and all executors share. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifests"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifests(self) -> list[tuple[int, float]]:
        """(number, time in seconds) of all manifests, ascending."""
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._at("manifests"))]
        return sorted((int(name), at) for name, at in found if name.isdigit())

    def _manifest(self, number: int) -> list[dict]:
        stream = self._fs.open(self._at(f"manifests/{number:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def parts(self) -> list[dict]:
        """The folders that count, oldest first: {folder, at}."""
        known = self._manifests()
        return self._manifest(known[-1][0]) if known else []

    def _publish(self, parts: list[dict]) -> None:
        """Name the folders that count from now on; the rename fails if another writer has published meanwhile."""
        known = self._manifests()
        number = known[-1][0] + 1 if known else 1
        tmp = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        target = self._at(f"manifests/{number:012d}")
        if self._fs.exists(target) or not self._fs.rename(tmp, target):
            self._fs.delete(tmp, False)
            raise RuntimeError("another writer has published; write again")

    def _table(self, name: str, parts: list[dict] | None = None) -> DataFrame:
        """All rows of a table of the parts, with the number of their part as _gen."""
        schema = _SCHEMAS[name]
        out = self.spark.createDataFrame([], f"{schema}, _gen int")
        for gen, part in enumerate(self.parts() if parts is None else parts):
            if name in part["tables"]:
                out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{part['folder']}/{name}").withColumn("_gen", F.lit(gen)))
        return out

    def _newest(self, name: str, parts: list[dict] | None) -> DataFrame:
        columns = [x.split()[0] for x in _SCHEMAS[name].split(", ")]
        rest = [c for c in columns if c not in _KEYS[name]] + ["_gen"]
        rows = self._table(name, parts)
        return rows.groupBy(*_KEYS[name]).agg(F.max_by(F.struct(*rest), "_gen").alias("_x")).select(*_KEYS[name], "_x.*")

    def nodes(self, parts: list[dict] | None = None) -> DataFrame:
        """The newest row of each node that has not been removed since."""
        gone = self._newest("gone", parts).withColumnRenamed("_gen", "_gone")
        kept = self._newest("nodes", parts).join(gone, "id", "left").where("_gone is null or _gone < _gen")
        return kept.select(*[x.split()[0] for x in NODES.split(", ")])

    def edges(self, parts: list[dict] | None = None) -> DataFrame:
        """The newest row of each edge whose file was not written anew and whose ends were not removed since."""
        gone = self._newest("gone", parts).withColumnRenamed("_gen", "_gone")
        left = self._newest("left", parts).withColumnRenamed("_gen", "_left")
        e = self._newest("edges", parts).join(left, "file", "left").where("_left is null or _left <= _gen").drop("_left")
        for end in ("src", "dst"):
            e = e.join(gone.withColumnRenamed("id", end), end, "left").where("_gone is null or _gone < _gen").drop("_gone")
        return e.select(*[x.split()[0] for x in EDGES.split(", ")])

    def _save(self, folder: str, name: str, rows: DataFrame) -> DataFrame:
        columns = [f"cast({c} as {t}) as {c}" for c, t in (x.split() for x in _SCHEMAS[name].split(", "))]
        rows.selectExpr(*columns).write.parquet(f"{self.path}/{folder}/{name}")
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{folder}/{name}")

    def write(self, nodes: DataFrame, edges: DataFrame, gone: DataFrame | None = None, left: DataFrame | None = None, fail_before: str | None = None) -> DataFrame:
        """Upsert nodes and edges; rows (file, item, error) of what was rejected, which is not written.

        A node needs id, type and label; an edge two nodes, stored or in this write and not removed by it, and a kind. gone: ids to remove with
        their edges. left: files whose earlier edges no longer count. fail_before ('edges' or 'manifest') ends the write there, for tests.
        """
        from ..operators.graph import cut, free

        parts, folder = self.parts(), f"parts/{uuid.uuid4().hex}"
        missing = F.when(F.coalesce("id", F.lit("")) == "", "node without id").when(F.coalesce("type", F.lit("")) == "", "node without type").when(F.coalesce("label", F.lit("")) == "", "node without label")
        checked = nodes.withColumn("error", missing)
        bad = checked.where("error is not null").select("file", F.lit("node").alias("item"), "error")
        one = checked.where("error is null").groupBy("id").agg(F.max_by(F.struct("type", "label", "content", "file"), F.struct("file", "label", "content", "type")).alias("_x")).select("id", "_x.*")
        staged = self._save(folder, "nodes", one)
        if fail_before == "edges":
            raise RuntimeError("stopped before edges")
        known = self.nodes(parts).select("id")
        if gone is not None:
            known = known.join(self._save(folder, "gone", gone.join(staged, "id", "left_anti").distinct()), "id", "left_anti")
        if left is not None:
            self._save(folder, "left", left.distinct())
        ids = known.unionByName(staged.select("id")).distinct()
        ends = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
        wrong = F.when(F.coalesce("kind", F.lit("")) == "", "edge without kind").when(F.col("_s").isNull(), "source missing").when(F.col("_d").isNull(), "target missing")
        ends = cut(ends.select("src", "dst", "kind", "file", wrong.alias("error")))  # read twice, made once
        self._save(folder, "edges", ends.where("error is null").select("src", "dst", "kind", "file"))
        rejects = f"{self.path}/{folder}/rejects"
        bad.unionByName(ends.where("error is not null").select("file", F.lit("edge").alias("item"), "error")).selectExpr("cast(file as string) as file", "item", "error").write.parquet(rejects)
        free(ends)
        if fail_before == "manifest":
            raise RuntimeError("stopped before the manifest")
        tables = ["nodes", "edges", *(["gone"] if gone is not None else []), *(["left"] if left is not None else [])]
        self._publish([*parts, {"folder": folder, "at": time.time(), "tables": tables}])
        return self.spark.read.schema("file string, item string, error string").parquet(rejects)

    def compact(self, cutoff: float = CUTOFF) -> None:
        """Fold all parts into one base; remove folders that only manifests older than `cutoff` seconds name, and those manifests."""
        parts = self.parts()
        if len(parts) > 1 or (parts and "gone" in parts[0]["tables"]):
            folder = f"parts/{uuid.uuid4().hex}"
            self._save(folder, "nodes", self.nodes(parts))
            self._save(folder, "edges", self.edges(parts))
            self._publish([{"folder": folder, "at": time.time(), "tables": ["nodes", "edges"]}])
        known, now = self._manifests(), time.time()
        # A state counts for readers until `cutoff` after the next one replaced it.
        live = [n for (n, _), replaced in zip(known, [at for _, at in known[1:]] + [now], strict=True) if n == known[-1][0] or now - replaced < cutoff]
        named = {p["folder"].rpartition("/")[2] for n in live for p in self._manifest(n)}
        if self._fs.exists(self._at("parts")):
            for s in self._fs.listStatus(self._at("parts")):
                if s.getPath().getName() not in named and now - s.getModificationTime() / 1000 >= cutoff:
                    self._fs.delete(s.getPath(), True)
        for n, _ in known:
            if n not in live:
                self._fs.delete(self._at(f"manifests/{n:012d}"), False)

    def fold(self, every: int = FOLD_EVERY, cutoff: float = CUTOFF) -> bool:
        """Compact if `every` writes have landed since the last base; whether it did."""
        if len(self.parts()) <= every:
            return False
        self.compact(cutoff)
        return True


def landed(nodes: DataFrame, rejects: DataFrame) -> DataFrame:
    """The files of a write that lost neither a node nor an edge: what a later run may skip."""
    return nodes.where("file is not null").select("file").distinct().join(rejects.select("file"), "file", "left_anti")


def replace_files(store: Store, symbols: DataFrame, calls: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Index some files anew against the stored graph of the others; the rejects of the write.

    symbols(id, name, kind, scope, file, start_line), calls(call_id, caller, file, callee, receiver) and imports(file, target_file, name) are
    those of files(file). Peers are the stored symbols of all other files; a node's label is its qualified name and its content the
    symbol as JSON. The files' earlier edges go; symbols that a file no longer has go with all their edges.
    """
    from ..operators.resolve import resolve_calls

    shape = "id string, name string, kind string, scope string, file string, start_line int"
    stored = store.nodes().where("type = 'code_symbol'")
    peers = stored.join(files.select("file"), "file", "left_anti").select(F.from_json("content", shape).alias("s")).select("s.*")
    columns = [x.split()[0] for x in shape.split(", ")]
    fresh = symbols.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in (x.split() for x in shape.split(", "))])
    found = resolve_calls(calls, peers.unionByName(fresh), imports)
    edges = found.join(calls.select("call_id", "file"), "call_id").select("src", "dst", F.lit("calls").alias("kind"), "file").distinct()
    nodes = fresh.select("id", F.lit("code_symbol").alias("type"), F.concat_ws(".", "scope", "name").alias("label"), F.to_json(F.struct(*columns)).alias("content"), "file")
    stale = stored.join(files.select("file"), "file", "left_semi").join(fresh, "id", "left_anti").select("id")
    return store.write(nodes, edges, gone=stale, left=files.select("file"))


def index_stream(path: str, every: int = FOLD_EVERY):
    """A foreachBatch writer of parsed files (file, symbols, calls, imports): the last version of each file in the batch replaces the stored one.

    A batch that is run again writes the same rows over themselves.
    """

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.graph import cut

        store = Store(batch.sparkSession, path)
        last = cut(batch.groupBy("file").agg(F.max_by(F.struct("symbols", "calls", "imports"), "version").alias("x")).select("file", "x.*"))
        rows = lambda c: last.select("file", F.explode(c).alias("x")).select("file", "x.*")
        replace_files(store, rows("symbols"), rows("calls"), rows("imports"), last.select("file"))
        store.fold(every)

    return write
