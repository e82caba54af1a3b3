"""Small operators on small fixtures: ranks, truncation, cards, schema files, progress, verbatim contents, supersedes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import exprs as X
from quarryline.operators import graph, knowledge, ledger, views
from quarryline.sources import code
from quarryline.streaming import progress

EDGE = "src string, dst string, kind string"


def test_pagerank_top_converges_to_the_fixed_point(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (3, 2), (3, 4), (5, 2), (5, 2)]
    edges = [(f"n{a}", f"n{b}", "calls") for a, b in pairs] + [("file:x", "n4", "imports")]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(6)], "id string")
    got = {r["id"]: r["rank"] for r in graph.pagerank_top(nodes, spark.createDataFrame(edges, EDGE), tol=1e-7).collect()}
    m = np.zeros((6, 6))
    for a, b in set(pairs):
        m[b, a] = 1
    deg = m.sum(0)
    m = np.where(deg > 0, m / np.maximum(deg, 1), 1 / 6)
    want = np.linalg.solve(np.eye(6) - 0.85 * m, np.full(6, 0.15 / 6))
    assert all(abs(got[f"n{i}"] - want[i]) < 1e-6 for i in range(6))
    top = graph.pagerank_top(nodes, spark.createDataFrame(edges, EDGE), top=2, tol=1e-7)
    assert [r["id"] for r in top.collect()] == ["n2", "n0"]
    assert graph.pagerank_top(nodes, spark.createDataFrame(edges, EDGE), tol=0.0, most=10).count() == 0
    assert graph.pagerank_top(nodes.limit(0), spark.createDataFrame([], EDGE)).count() == 0


def test_truncated_subgraph(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("a", "d", "calls")], EDGE)
    nodes = lambda *rows: spark.createDataFrame(list(rows), "id string, depth int")
    assert not graph.truncated(edges, nodes(("a", 0), ("b", 1), ("d", 1)), 1)
    assert graph.truncated(edges, nodes(("a", 0), ("b", 1)), 1)
    assert graph.truncated(edges, nodes(("a", 0), ("b", 1), ("d", 1)), 2)


def test_trace_entries(spark):
    s = spark.createDataFrame([("r/a.ts#mount", "mount"), ("r/b.ts#Page.mount", "mount"), ("r/c.ts#x", "x"), (None, None)], "id string, name string")
    got = {(r["entry"], r["id"], r["n"], r["first"]) for r in graph.entries(s, ["mount", "Page.mount", "r/c.ts#x", "zzz", "x"]).collect()}
    assert got == {("mount", "r/a.ts#mount", 2, True), ("mount", "r/b.ts#Page.mount", 2, False), ("Page.mount", "r/b.ts#Page.mount", 1, True), ("r/c.ts#x", "r/c.ts#x", 1, True), ("x", "r/c.ts#x", 1, True)}
    assert graph.entries(s, []).count() == 0


def test_cards_and_modes(spark):
    files = spark.createDataFrame([("a.py", "import os\ndef big():\n    x = os.path\n    return x\n"), ("b.py", None)], "file string, content string")
    symbols = spark.createDataFrame([("s", "a.py", 2, 4), ("t", "a.py", 1, 2), ("u", "b.py", 1, 9)], "id string, file string, start_line int, end_line int")
    got = {r["id"]: r["card"] for r in views.symbol_cards(symbols, files).collect()}
    assert got == {"s": "def big os path return", "u": None} or got == {"s": "def big os path return x", "u": None} or got["s"].split()[:4] == ["def", "big", "os", "path"]
    assert [views.context_mode(*a) for a in ((1, 1), (20_000, 1), (1, 30_000), (1, 1, "off"), (1, 30_000, "file"))] == ["spans", "off", "file", "off", "file"]


def test_edge_exists_and_defined_names(spark):
    edges = spark.createDataFrame([("a", "b", "calls")], EDGE)
    assert knowledge.edge_exists(edges, "a", "b", "calls") and not knowledge.edge_exists(edges, "b", "a", "calls") and not knowledge.edge_exists(edges, "a", "b", "imports")
    texts = ["export function boot() {}", "class  Gate:", "no definition", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(knowledge.defined_name(F.col("t"))).collect()]
    assert got == ["boot", "Gate", None, None]


def test_schema_files(spark):
    rows = [("a.sql", "sql", "CREATE TABLE IF NOT EXISTS app.users (id int primary key, name varchar(10, 2), constraint c unique (id));\ncreate view v as select 1"), ("b.prisma", "prisma", "model Post {\n  id Int @id\n  title String\n}"), ("c.graphql", "graphql", "type User {\n  id: ID!\n  posts(n: Int): [Post]\n}\ntype Query {\n  x: Int\n}"), ("d.txt", None, "create table no (x int)"), ("e.sql", "sql", None)]
    got = {(r["file"], r["name"], r["kind"], tuple(r["columns"])) for r in code.schema_tables(spark.createDataFrame(rows, "file string, language string, content string")).collect()}
    assert got == {("a.sql", "users", "table", ("id", "name")), ("a.sql", "v", "view", ()), ("b.prisma", "Post", "table", ("id", "title")), ("c.graphql", "User", "table", ("id", "posts"))}


def test_expand_then_collapse(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("c", "a", "calls"), ("b", "d", "calls"), ("b", "a", "calls")], EDGE)
    shown = spark.createDataFrame([("a", None)], "id string, parent string")
    one = views.expand(shown, edges, "a")
    two = views.expand(one, edges, "b").cache()
    assert {tuple(r) for r in one.collect()} == {("a", None), ("b", "a"), ("c", "a")}
    assert ("d", "b") in {tuple(r) for r in two.collect()}
    assert {tuple(r) for r in views.collapse(two, "a").collect()} == {("a", None)}


def test_verbatim_contents(spark):
    df = spark.createDataFrame([("s", "t", "one\n\ntwo", None), ("s", "t", "abcdef", "plain"), ("s", "t", "", "SOURCE: x\nAT: y"), ("s", "t", "x", "SOURCE: x\nno\n\nbody\nmore")], "source string, at string, text string, other string")
    r = df.select(X.verbatim_parts(X.verbatim_content(F.col("source"), F.col("at"), F.col("text"), 5)).alias("p"), X.verbatim_parts(F.col("other")).alias("q")).collect()
    assert [tuple(x["p"]) for x in r] == [("s", "t", "one\n\n\n[truncated]"), ("s", "t", "abcde\n[truncated]"), ("s", "t", ""), ("s", "t", "x")]
    assert [tuple(x["q"]) for x in r[1:]] == [("", "", ""), ("x", "y", ""), ("x", "", "body\nmore")]
    heads = spark.createDataFrame([("\n" * 19 + "2024-01-02",), ("\n" * 20 + "2024-01-02",), (None,)], "t string").select(X.date_in_head(F.col("t")).alias("d")).collect()
    assert [h["d"] for h in heads] == ["2024-01-02", None, None]


def test_supersedes_are_restored_after_nodes(spark):
    line = lambda **x: (json.dumps({"kind": "node", "type": "decision", "label": "l", "content": "c", **x}),)
    lines = [line(id="a", supersededAt="t", supersededBy="b", supersededReason="why"), line(id="b"), line(id="c", supersededAt="t", supersededBy="gone"), line(id="d", supersededAt="t"), line(id="e", supersededBy="b"), line(id="f", supersededAt="t", supersededBy="old"), ("junk",)]
    got = ledger.restore_supersedes(ledger.parse_lines(spark.createDataFrame(lines, "line string")), spark.createDataFrame([("old",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {("a", "b", "why", "restored"), ("c", "gone", None, "error"), ("f", "old", None, "restored")}


def test_progress_merges_updates_and_follows_a_stream(spark, tmp_path):
    p = progress.Progress()
    assert p.get("w") == progress.IDLE
    p.update("w", filesTotal=9)
    p.update("w", phase="parsing", indexing=True)
    assert p.get("w") == {**progress.IDLE, "filesTotal": 9, "phase": "parsing", "indexing": True} and p.get("v") == progress.IDLE
    p.clear("w")
    assert p.get("w") == progress.IDLE
    spark.range(7).write.json(str(tmp_path / "in"))
    spark.streams.addListener(p)
    try:
        stream = spark.readStream.schema("id long").json(str(tmp_path / "in"))
        for name in ("index:w", "other"):
            q = stream.writeStream.format("noop").queryName(name).option("checkpointLocation", str(tmp_path / name.replace(":", "-"))).trigger(availableNow=True).start()
            q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if p.get("w")["phase"] == "done":
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(p)
    got = p.get("w")
    assert got["phase"] == "done" and not got["indexing"] and got["filesDone"] == 7 and p.get("other") == progress.IDLE


@pytest.mark.parametrize("field", ["filesDone", "phase"])
def test_progress_snapshots(spark, field):
    log = spark.createDataFrame([("w", 1, field, "1"), ("w", 3, field, "3"), ("w", 2, field, "2"), ("v", 1, "jobId", "j")], "workspace string, n int, field string, value string")
    got = {(r["workspace"], r["field"]): r["value"] for r in progress.snapshots(log).collect()}
    assert got["w", field] == "3" and got["v", "jobId"] == "j" and got["v", "edgesWritten"] == "0" and len(got) == 13


def test_fnv_of_utf16_units(spark):
    def fnv(s):
        h, b = 0x811C9DC5, s.encode("utf-16-be")
        for i in range(0, len(b), 2):
            h = (h ^ int.from_bytes(b[i : i + 2], "big")) * 0x01000193 % (1 << 32)
        return f"{h:08x}"

    texts = ["", "a", "index.ts|main.ts", "größe", "日本🙂", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.fnv1a8(F.col("t"))).collect()]
    assert got == [fnv(t) for t in texts]


def test_collapse_takes_each_level_along(spark):
    """Ten levels under the closed node go, rows under another parent stay, and so does a row that hangs on nothing shown."""
    deep = [(f"n{k}", f"n{k - 1}") for k in range(1, 11)]
    shown = spark.createDataFrame([("n0", None), ("x", "n0"), ("both", "n5"), ("both", "x"), ("under", "both"), ("loose", "unseen"), *deep], "id string, parent string")
    got = {tuple(r) for r in views.collapse(shown, "n0").collect()}
    assert got == {("n0", None), ("loose", "unseen")}
    assert {tuple(r) for r in views.collapse(shown, "n1").collect()} == {("n0", None), ("x", "n0"), ("both", "x"), ("under", "both"), ("loose", "unseen"), ("n1", "n0")}
