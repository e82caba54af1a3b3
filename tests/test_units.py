"""Goldens: scalar functions, parsers, ledgers, graphs and streams."""

import random

from pyspark.sql import functions as F

from quarryline.functions import exprs as X
from quarryline.operators import analytics, graph, knowledge, ledger, resolve
from quarryline.operators import communities as groups
from quarryline.sources import code
from quarryline.streaming import verbatim


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, X.fnv1a8(F.lit("foobar"))) == "bf9cf968"
    assert one(spark, X.camel_tokens(F.lit("getHTTPServer_name"))) == ["get", "http", "server", "name"]
    assert [one(spark, X.dirname(F.lit(p))) for p in ("a/b/c", "x")] == ["a/b", "."]
    assert [one(spark, X.slug(F.lit(p))) for p in ("a b::c", "///")] == ["a_b_c", "_"]
    assert [one(spark, X.package_root(F.lit(p))) for p in ("@s/p/x", "p/x", "./p")] == ["@s/p", "p", None]
    assert one(spark, X.occurrences(F.lit("aaaa"), "aa")) == 2


def test_redaction(spark):
    hide = ["me@example.com", "123-45-6789", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "(555) 123-4567", "555-123-4567", "api_key=abc123", "password: hunter2"]
    keep = ["2026-07-01", "1.22.333", "10.0.0.1:8080", "1767225600000", "const x = a - b;"]
    for t in hide:
        assert "[REDACTED]" in one(spark, X.redact(F.lit(t))), t
    for t in keep:
        assert one(spark, X.redact(F.lit(t))) == t


def test_globs():
    import re

    assert re.match(X.glob_regex("src/**/*.py"), "src/a/b/c.py") and re.match(X.glob_regex("src/**/*.py"), "src/c.py")
    assert not re.match(X.glob_regex("*.py"), "a/b.py") and not re.match(X.glob_regex("*" * 25), "x")


def test_python_parser(spark):
    src = "import os, sys\nfrom a.b import c as d\nMAX = 3\nclass G:\n    def open(self):\n        if 1:\n            helper(2)\n        self.x.close()\ndef helper(n):\n    return n\n"
    got = {(r.row, r.name, r.kind, r.parent) for r in code.parse(spark.createDataFrame([("m.py", "python", src), ("bad.py", "python", "def ("), ("x.go", "go", "func (r *T) Run() {}\ntype T struct {")], "file string, language string, content string")).collect()}
    assert {("symbol", "G", "class", None), ("symbol", "G.open", "method", "G"), ("symbol", "helper", "function", None), ("symbol", "MAX", "constant", None), ("import", "os", "module", None), ("import", "sys", "module", None), ("call", "helper", "function", "G.open"), ("call", "close", "method", "G.open"), ("symbol", "Run", "function", None), ("symbol", "T", "class", None)} <= got


def test_schema_parsers(spark):
    ddl = 'CREATE TABLE IF NOT EXISTS "s"."users" (id int primary key, name varchar(10), price decimal(10, 2), CONSTRAINT c UNIQUE (id));\nCREATE VIEW v AS SELECT 1;'
    assert code.ddl_tables(ddl) == [("users", "table", ["id", "name", "price"]), ("v", "view", [])]
    assert code.prisma_tables("model User {\n  id Int @id\n  name String\n}\n") == [("User", "table", ["id", "name"])]
    assert code.graphql_tables("type User {\n  id: ID!\n  posts(n: Int): [P]\n}\ntype Query {\n  a: Int\n}\n") == [("User", "table", ["id", "posts"])]


def test_git_text(spark):
    lines = spark.createDataFrame([("1\t2\ta.py",), ("-\t-\tb.png",), ("3\t0\ta.py",), ("commit x",)], "line string")
    assert [tuple(r) for r in code.numstat(lines).collect()] == [("a.py", 2, 4, 2)]
    diff = ["+++ b/a.py", "@@ -1,2 +3,4 @@", "@@ -9 +9,0 @@", "+++ b/c.py", "@@ -1 +7 @@"]
    got = code.diff_ranges(spark.createDataFrame([("d", i, x) for i, x in enumerate(diff)], "diff string, n int, line string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a.py", 3, 6), ("c.py", 7, 7)]


def test_file_source(spark, tmp_path):
    for p, t in {"a/x.py": "x = 1\n", "node_modules/y.js": "1", "b/z.go": "package z", "b/skip.tmp": "1"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.file: r.language for r in code.files(spark, str(tmp_path), ("**/*.tmp",)).collect()}
    assert got == {"a/x.py": "python", "b/z.go": "go"}


def test_ledger_lines(spark):
    lines = ['{"version":2,"exportedAt":"t"}', '{"kind":"node","id":"a","type":"decision"}', "junk", '{"kind":"odd"}', '{"kind":"edge","sourceId":"a","targetId":"zz","relation":"r"}', '{"kind":"edge","sourceId":"a","targetId":"a","relation":"r"}']
    parsed = ledger.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert sorted(r.status for r in parsed.collect()) == ["edge", "edge", "error", "header", "node", "skipped"]
    assert sorted((r.dst, r.outcome) for r in ledger.import_outcomes(parsed, spark.createDataFrame([], "id string")).collect()) == [("a", "ok"), ("zz", "deferred")]


def test_components_of_cycles(spark):
    rng = random.Random(3)
    pairs = sorted({(f"v{rng.randrange(25)}", f"v{rng.randrange(25)}") for _ in range(45)})
    reach = {v: {v} for p in pairs for v in p}
    for _ in reach:
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {v: min(u for u in reach if u in reach[v] and v in reach[u]) for v in reach}
    want = {v: c for v, c in want.items() if sum(x == c for x in want.values()) > 1}
    assert {r.id: r.component for r in graph.sccs(spark.createDataFrame(pairs, "src string, dst string")).collect()} == want


def cliques(*sets):
    return [(a, b) for files in sets for a in files for b in files if a < b]


def stable(spark, *sets):
    edges = spark.createDataFrame(cliques(*sets), "src string, dst string")
    members = groups.louvain(spark.createDataFrame([(f,) for s in sets for f in s], "id string"), edges).select("community", F.col("id").alias("file"))
    symbols = spark.createDataFrame([("none", "x")], "file string, name string")
    return sorted(r.stable_id for r in groups.stable_ids(groups.labels(members, symbols), members).collect())


def test_communities_and_stable_ids(spark):
    a, b = ["src/locale/format.ts", "src/locale/parse.ts", "src/locale/index.ts"], ["src/parser/ast.ts", "src/parser/lexer.ts", "src/parser/token.ts"]
    assert stable(spark, a, b) == ["locale~format", "parser~ast"]
    assert stable(spark, ["pkg/a/utils/str.ts", "pkg/a/utils/num.ts"], ["pkg/b/utils/date.ts", "pkg/b/utils/uuid.ts"]) == ["utils~date", "utils~num"]
    assert stable(spark, ["zeta.ts", "alpha.ts"]) == ["community~alpha"]


def test_louvain_of_bridged_cliques(spark):
    a, b, c = ([f"{x}{i}" for i in range(5)] for x in "abc")
    edges = [*cliques(a, b, c), ("a0", "b0"), ("b1", "c0"), ("a0", "a1"), ("a1", "a0"), ("a2", "a2"), ("a0", "gone")]
    got = {r.id: r.community for r in groups.louvain(spark.createDataFrame([(x,) for x in [*a, *b, *c, "z"]], "id string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {**dict.fromkeys(a, "a0"), **dict.fromkeys(b, "b0"), **dict.fromkeys(c, "c0"), "z": "z"}
    assert groups.louvain(spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_hubs_are_outside_of_cycles(spark):
    links = spark.createDataFrame([("a", "h", 1), ("b", "h", 2), ("c", "h", 1), ("a", "b", 1), ("b", "a", 3), ("d", "a", 1), ("c", "a", 1)], "src string, dst string, weight long")
    found = groups.insights(links, spark.createDataFrame([("a", 4), ("h", 1), ("b", 5), ("c", 2)], "community string, rank int"))
    assert sorted(tuple(r) for r in found.collect()) == [("cycle", "a", "a"), ("cycle", "b", "a"), ("hub", "h", "3"), ("inversion", "a", "h")]
    assert {(r.a, r.b): (r.weight, r.cyclic, r.violation) for r in groups.links_of(links, found).collect()}["a", "b"] == (4, True, False)


def test_resolution_across_files(spark):
    symbols = [("G", "Gateway", "class", None, "src/lib.ts", 1), ("G.open", "open", "method", "Gateway", "src/lib.ts", 2), ("G.close", "close", "method", "Gateway", "src/lib.ts", 5), ("helper", "helper", "function", None, "src/lib.ts", 9), ("boot", "boot", "function", None, "src/main.ts", 1), ("use", "useHelper", "function", None, "src/main.ts", 4), ("open2", "open", "variable", "boot", "src/main.ts", 2)]
    table = spark.createDataFrame(symbols, "id string, name string, kind string, scope string, file string, start_line int")
    calls = [(1, "boot", "src/main.ts", "open", "Gateway"), (2, "use", "src/main.ts", "helper", None), (3, "boot", "src/main.ts", "open", None), (4, "boot", "src/main.ts", "useHelper", "this"), (5, "x", "src/other.ts", "Gateway.close", None), (6, "x", "src/other.ts", "boot", "(await y)")]
    imports = [("src/main.ts", "src/lib.ts", "Gateway"), ("src/main.ts", "src/lib.ts", "helper")]
    got = resolve.resolve_calls(spark.createDataFrame(calls, "call_id int, caller string, file string, callee string, receiver string"), table, spark.createDataFrame(imports, "file string, target_file string, name string"))
    assert sorted((r.call_id, r.dst, r.confidence, r.reason) for r in got.collect()) == [(1, "G.open", 0.95, "receiver"), (2, "helper", 0.95, "named import"), (4, "use", 1.0, "same file"), (5, "G.close", 0.7, "qualified name"), (6, "boot", 0.7, "qualified name")]


def test_import_paths(spark):
    files = ["src/a/x.ts", "src/lib/index.ts", "src/b.d.ts", "py/pkg/__init__.py", "py/pkg/mod.py", "py/top.pyi"]
    tries = {("src/a/m.ts", "./x.js", "typescript"): "src/a/x.ts", ("src/a/c/m.ts", "../../lib", "tsx"): "src/lib/index.ts", ("src/m.ts", "@/a/x", "javascript"): "src/a/x.ts", ("src/m.ts", "react", "typescript"): None, ("src/a/m.ts", "../b", "typescript"): "src/b.d.ts", ("py/pkg/m.py", ".mod", "python"): "py/pkg/mod.py", ("py/pkg/m.py", ".", "python"): "py/pkg/__init__.py", ("py/pkg/m.py", "..top", "python"): "py/top.pyi", ("x.py", "py.pkg", "python"): "py/pkg/__init__.py", ("x.py", "os", "python"): None, ("x.go", "./a", "go"): None}
    got = resolve.resolve_paths(spark.createDataFrame(list(tries), "file string, specifier string, language string"), spark.createDataFrame([(f,) for f in files], "file string"), {"@": ["src"]})
    assert {(r.file, r.specifier, r.language): r.target_file for r in got.collect()} == tries


def test_dead_code_exemptions(spark):
    names = [("main", "a.ts"), ("setup", "a.ts"), ("Main", "a.ts"), ("listen", "a.ts"), ("x1", "a.test.ts"), ("x2", "a.spec.ts"), ("x3", "q/test/a.ts"), ("x4", "tests/a.ts"), ("registerAll", "a.ts"), ("inner", "a.ts"), ("used", "a.ts")]
    table = spark.createDataFrame([(n, n, "function", f, "setup" if n == "inner" else None) for n, f in names], "id string, name string, kind string, file string, parent_id string")
    edges = spark.createDataFrame([("setup", "used", "calls"), ("setup", "Main", "extends")], "src string, dst string, kind string")
    assert sorted(r.id for r in analytics.dead_code(table, edges).collect()) == ["Main", "setup", "x4"]


def test_verbatim_order(spark):
    entries = spark.createDataFrame([("t1", ["x"], 1), ("t2", ["x"], 2), ("t3", ["x"], 3), ("o", ["y"], 9)], "id string, topics array<string>, at int")
    none = spark.createDataFrame([("o", "t3")], "src string, dst string")
    got = [(r.id, r.status) for r in knowledge.verbatim_recall(entries, none.limit(0)).collect()]
    assert got == [("o", "current"), ("t3", "current"), ("t2", "outdated-by:t3 (by time)"), ("t1", "outdated-by:t3 (by time)")]
    assert {r.id: r.status for r in knowledge.verbatim_recall(entries, none).collect()}["t3"] == "superseded-by:o"


def test_paths_names_and_dates(spark):
    assert [one(spark, X.normalised(F.lit(p))) for p in ("a/./b/../c", "../x", "a/..", "a/b/../../../c")] == ["a/c", "../x", ".", "../c"]
    assert [one(spark, X.strip_generics(F.lit(p))) for p in ("ns.Map<K, V>[]", "std::vector<int>", "Foo(x)")] == ["Map", "vector", "Foo"]
    assert one(spark, X.first_date(F.lit("on 2026-01-02 or 2027-01-01"))) == "2026-01-02" and one(spark, X.first_date(F.lit("x"))) is None
    assert [one(spark, X.epoch_of(F.lit(p))) for p in ("1970-01-01 00:01:00", "junk")] == [60, 0]
    assert [one(spark, knowledge.asked_symbol(F.lit(p))) for p in ("what calls `a.b`?", "who uses 'foo'", "does Foo call Bar", "nothing")] == ["a.b", "foo", "Foo", None]


def test_ledger_append_and_fields(spark):
    nodes = spark.createDataFrame([("a", "decision", "l", 'x "y"\n', ["t", "u"], None, [0.5, 1.0]), ("b", "convention", "m", None, [], "2026-01-01", None)], "id string, type string, label string, content string, tags array<string>, superseded_at string, embedding array<double>")
    edges = spark.createDataFrame([("a", "b", "r")], "src string, dst string, kind string")
    lines = ledger.export_lines(nodes, edges, {"exported_at": "now", "workspace": "w"})
    back = {r.id or r.status: r for r in ledger.parse_lines(lines.select("line")).collect()}
    assert back["a"].content == 'x "y"\n' and back["a"].tags == "t,u" and back["a"].embedding == [0.5, 1.0] and back["b"].supersededAt == "2026-01-01" and back["b"].content is None and back["header"].version == 2 and back["edge"].targetId == "b"
    prior = ledger.parse_lines(lines.select("line")).where("status <> 'header'")
    added = prior.where("id = 'a'").withColumn("label", F.lit("new"))
    assert sorted((r.id or "", r.label or "") for r in ledger.append(prior, added).collect()) == [("", ""), ("a", "new"), ("b", "m")]


def test_arguments(spark):
    import pytest

    assert knowledge.check_arguments({"q": 3, "limit": "900"}, {"q": str}, {"limit": int}) == {"q": "3", "limit": 500}
    for bad in ({}, {"q": "x", "limit": "many"}):
        with pytest.raises(ValueError, match="invalid_arguments"):
            knowledge.check_arguments(bad, {"q": str}, {"limit": int})
    with pytest.raises(ValueError, match="unknown type"):
        knowledge.check_types(["decision", "odd"])
    assert [knowledge.path_allowed(p, ["/a/b"]) for p in ("/a/b", "/a/b/c", "/a/bc", "/a/b/../x")] == [True, True, False, False]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("same", "2026-01-01 00:00:00"), ("same", "2026-01-01 00:05:00"), ("other", "2026-01-01 00:01:00")], "text string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("text string, at timestamp").parquet(str(src))
    out = str(tmp_path / "out")
    verbatim.dedup(stream).writeStream.foreachBatch(verbatim.idempotent_sink(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["other", "same"]


def test_flush_batches_fill_in_order(spark):
    rng = random.Random(2)
    queues = {"a": [31, 31], "b": [32] + [1] * 9, "c": [40, 1, 50, 50, 1], "d": [rng.choice([1, 1, 2, 9, 20, 33]) for _ in range(60)], None: [1] * 6}
    data = [(w, at, f"{at:03}", "x" * (1200 + 1050 * (c - 1))) for w, q in queues.items() for at, c in enumerate(q)]
    want = {}
    for w, q in queues.items():
        batches = [[]]
        for at, c in enumerate(q):
            if batches[-1] and (len(batches[-1]) == 5 or sum(q[k] for k in batches[-1]) + c > 32):
                batches.append([])
            batches[-1].append(at)
            want[w, f"{at:03}"] = len(batches) - 1
    got = verbatim.flush_batches(spark.createDataFrame(data, "workspace string, at int, id string, text string")).collect()
    assert {(r["workspace"], r["id"]): r["batch"] for r in got} == want
