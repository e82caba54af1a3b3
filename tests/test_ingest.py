"""The write path: breaker, journal, staged writes, single-file index, crawl, ignore rules, containers, blame, capped reads."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryline.operators import intervals, scan
from quarryline.sources import blame, crawl, ignore, store
from quarryline.streaming import breaker, journal

T0 = datetime(2026, 1, 1)


def sequential_breaker(rows, threshold, cooldown):
    state, out = {}, {}
    for w, i, at, failed in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        n, until = state.get(w, (0, None))
        if n >= threshold and at < until:
            out[w, i] = "skipped"
        elif not failed:
            state.pop(w, None)
            out[w, i] = "landed"
        else:
            n += 1
            state[w] = (n, at + timedelta(seconds=cooldown) if n >= threshold else None)
            out[w, i] = "opened" if n >= threshold else "failed"
    return out


@pytest.mark.parametrize("block", [5, 60, 100_000])
def test_breaker_equals_sequential_model(spark, block):
    """Segments and blocks of any width give what one pass in order gives; one workspace has most of the rows."""
    rng = random.Random(block)
    rows = [(rng.choice("aaaab"), i, T0 + timedelta(seconds=rng.randint(0, 900)), rng.random() < 0.5) for i in range(600)]
    rows += [("c", 1000 + i, T0 + timedelta(seconds=i), True) for i in range(80)]
    df = spark.createDataFrame(rows, "workspace string, id long, at timestamp, failed boolean")
    got = {(r["workspace"], r["id"]): r["outcome"] for r in breaker.outcomes(df, cooldown=20, block=block).collect()}
    assert got == sequential_breaker(rows, 3, 20)
    assert breaker.outcomes(df.limit(0)).count() == 0


def test_breaker_stream(spark, tmp_path):
    """Three workspaces over several micro-batches: state is kept between them, and a timer tells that a cooldown is over."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = []
    for i in range(40):
        rows += [("bad", f"b{i}", T0 + timedelta(seconds=10 * i), True), ("good", f"g{i}", T0 + timedelta(seconds=10 * i), i % 3 != 2), ("mixed", f"m{i}", T0 + timedelta(seconds=10 * i), i < 3)]
    schema = "workspace string, id string, at timestamp, failed boolean"
    for k in range(4):
        spark.createDataFrame([r for r in rows if int(r[1][1:]) // 10 == k], schema).coalesce(1).write.json(str(tmp_path / "in" / f"part{k}"))
        for f in os.listdir(tmp_path / "in" / f"part{k}"):
            if f.startswith("part-"):
                os.makedirs(tmp_path / "files", exist_ok=True)
                os.rename(tmp_path / "in" / f"part{k}" / f, tmp_path / "files" / f"{k}.json")
                os.utime(tmp_path / "files" / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "files"))
    q = breaker.breaker(stream).writeStream.format("memory").queryName("breaker_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.table("breaker_out").collect()
    want = sequential_breaker(rows, 3, 60)
    assert {(r["workspace"], r["id"]): r["outcome"] for r in got if r["id"]} == want
    probes = [r["workspace"] for r in got if r["outcome"] == "half-open"]
    assert "bad" in probes and "good" not in probes


def sequential_queue(lines, cap):
    queue, good, bad = [], 0, 0
    for n, line in lines:
        if not line.strip():
            continue
        try:
            x = json.loads(line)
            node = x["node"]
            fields = [x["workspace"], node["id"], node["type"], node["label"], node["workspace"]]
            if not all(isinstance(f, str) and f for f in fields):
                raise ValueError
        except (ValueError, TypeError, KeyError):
            bad += 1
            continue
        good += 1
        queue = [q for q in queue if q[0] != node["id"]] + [(node["id"], n)]
        queue = queue[-cap:]
    return queue, good, bad


@pytest.mark.parametrize("cap", [5, 500])
def test_journal_replay_of_a_cut_journal(spark, cap):
    rng = random.Random(cap)
    lines = [(n, json.dumps({"workspace": f"w{n % 2}", "node": {"id": f"i{rng.randint(0, 30)}", "type": "verbatim", "label": "l", "workspace": "w"}, "enqueuedAt": n})) for n in range(120)]
    odd = ["", "  ", "null", "[1]", "7", '{"workspace":"w"}', '{"workspace":5,"node":{"id":"x","type":"t","label":"l","workspace":"w"}}', '{"workspace":"w","node":{"id":"","type":"t","label":"l","workspace":"w"}}', '{"workspace":"w","node":{"id":"y","type":"t","label":["l"],"workspace":"w"}}', '{"workspace":"w","node":{"id":"z","type":"t","label":"l","workspace":"w"},"enqueuedAt":"soon"}']
    lines += [(200 + i, x) for i, x in enumerate(odd)]
    lines.append((300, lines[5][1][:-7]))  # torn by the crash
    queue, report = journal.replay(spark.createDataFrame(lines, "n long, line string"), now=77, cap=cap)
    want, good, bad = sequential_queue(lines, cap)
    got = sorted(queue.collect(), key=lambda r: r["n"])
    assert [(r["id"], r["n"]) for r in got] == want
    assert report.first().asDict() == {"replayed": good, "malformed": bad}
    assert {r["id"]: r["enqueued_at"] for r in got}["z"] == 77


def test_enqueue_journals_before_it_applies(spark, tmp_path):
    """A batch whose apply dies is in the journal; run again, it is there once."""
    seen, path = [], str(tmp_path / "journal")

    def apply(queue, number):
        if number == 1 and not seen[1:]:
            seen.append("died")
            raise RuntimeError("killed")
        seen.append([r["id"] for r in sorted(queue.collect(), key=lambda r: r["n"])])

    write = journal.enqueue(path, apply, cap=3)
    batch = lambda rows: spark.createDataFrame([(n, "w", i, "verbatim", "l", "c", n) for n, i in rows], "n long, workspace string, id string, type string, label string, content string, enqueued_at long")
    write(batch([(1, "a"), (2, "b")]), 0)
    with pytest.raises(RuntimeError):
        write(batch([(1, "c"), (2, "a")]), 1)
    left, _ = journal.replay(journal.read(spark, path), cap=3)
    assert [r["id"] for r in sorted(left.collect(), key=lambda r: r["n"])] == ["b", "c", "a"]
    write(batch([(1, "c"), (2, "a")]), 1)
    write(batch([(1, "d")]), 2)
    assert seen == [["a", "b"], "died", ["b", "c", "a"], ["c", "a", "d"]]


def graph_rows(spark, nodes, edges):
    return spark.createDataFrame(nodes, store.NODES), spark.createDataFrame(edges, store.EDGES)


def test_a_killed_write_leaves_the_old_state(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "graph"))
    n, e = graph_rows(spark, [("a", "t", "A", "", "f1"), ("b", "t", "B", "", "f2"), ("c", "t", None, "", "f3"), ("", "t", "x", "", "f3")], [("a", "b", "calls", "f1"), ("a", "c", "calls", "f1"), ("z", "b", "calls", "f2"), ("b", "a", None, "f2")])
    rejects = s.write(n, e)
    assert sorted((r["file"], r["item"], r["error"]) for r in rejects.collect()) == [("f1", "edge", "target missing"), ("f2", "edge", "edge without kind"), ("f2", "edge", "source missing"), ("f3", "node", "node without id"), ("f3", "node", "node without label")]
    assert store.landed(n, rejects).count() == 0
    before = (sorted(map(tuple, s.nodes().collect())), sorted(map(tuple, s.edges().collect())))
    more = graph_rows(spark, [("a", "t", "new", "", "f1"), ("d", "t", "D", "", "f4")], [("d", "a", "calls", "f4")])
    for point in ("edges", "manifest"):
        with pytest.raises(RuntimeError):
            s.write(*more, fail_before=point)
        again = store.Store(spark, str(tmp_path / "graph"))
        assert (sorted(map(tuple, again.nodes().collect())), sorted(map(tuple, again.edges().collect()))) == before
    ok = s.write(*more)
    assert ok.count() == 0 and [r["file"] for r in store.landed(more[0], ok).orderBy("file").collect()] == ["f1", "f4"]
    assert {r["id"]: r["label"] for r in s.nodes().collect()} == {"a": "new", "b": "B", "d": "D"}
    assert sorted((r["src"], r["dst"]) for r in s.edges().collect()) == [("a", "b"), ("d", "a")]


def test_compaction_keeps_rows_and_readers(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "graph"))
    folded = []
    for k in range(7):
        gone = spark.createDataFrame([("n0",)], "id string") if k == 3 else None
        s.write(*graph_rows(spark, [(f"n{k}", "t", f"L{k}", "", f"f{k}"), ("both", "t", f"v{k}", "", "f")], [("both", f"n{k}", "calls", f"f{k}")]), gone)
        before = (sorted(map(tuple, s.nodes().collect())), sorted(map(tuple, s.edges().collect())))
        reader = s.nodes()  # opened before the fold
        folded.append(s.fold())
        assert (sorted(map(tuple, s.nodes().collect())), sorted(map(tuple, s.edges().collect()))) == before
        assert sorted(map(tuple, reader.collect())) == before[0]
    assert folded == [False] * 5 + [True, False]
    assert "n0" not in {r["id"] for r in s.nodes().collect()}
    parts = lambda: len(os.listdir(tmp_path / "graph" / "parts"))
    many = parts()
    s.compact(cutoff=0)
    assert parts() == 1 < many and sorted(map(tuple, s.nodes().collect())) == before[0]


LIB = [("lib:Gateway", "Gateway", "class", None, "src/lib.ts", 1), ("lib:Gateway.open", "open", "method", "Gateway", "src/lib.ts", 2), ("lib:Gateway.close", "close", "method", "Gateway", "src/lib.ts", 3), ("lib:helper", "helper", "function", None, "src/lib.ts", 5)]
MAIN = [("main:boot", "boot", "function", None, "src/main.ts", 2), ("main:useHelper", "useHelper", "function", None, "src/main.ts", 3)]
_SYMBOL = "id string, name string, kind string, scope string, file string, start_line int"
_CALL = "call_id long, caller string, file string, callee string, receiver string"
_IMPORT = "file string, target_file string, name string"


def parsed(spark, symbols, calls=(), imports=()):
    return spark.createDataFrame(list(symbols), _SYMBOL), spark.createDataFrame(list(calls), _CALL), spark.createDataFrame(list(imports), _IMPORT)


def test_single_file_index_resolves_against_stored_peers(spark, tmp_path):
    """The full index, then main.ts alone: the same cross-file edges; then with a renamed function: the old one is gone."""
    s = store.Store(spark, str(tmp_path / "graph"))
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    calls = [(1, "main:boot", "src/main.ts", "open", "Gateway"), (2, "main:useHelper", "src/main.ts", "helper", None)]
    imports = [("src/main.ts", "src/lib.ts", "Gateway"), ("src/main.ts", "src/lib.ts", "helper")]
    want = [("main:boot", "lib:Gateway.open"), ("main:useHelper", "lib:helper")]
    edges = lambda: sorted((r["src"], r["dst"]) for r in s.edges().collect())
    assert store.replace_files(s, *parsed(spark, LIB + MAIN, calls, imports), files("src/lib.ts", "src/main.ts")).count() == 0
    assert edges() == want
    assert store.replace_files(s, *parsed(spark, MAIN, calls, imports), files("src/main.ts")).count() == 0
    assert edges() == want
    renamed = [MAIN[0], ("main:viaHelper", "viaHelper", "function", None, "src/main.ts", 3)]
    store.replace_files(s, *parsed(spark, renamed, [calls[0], (2, "main:viaHelper", "src/main.ts", "helper", None)], imports), files("src/main.ts"))
    assert edges() == [("main:boot", "lib:Gateway.open"), ("main:viaHelper", "lib:helper")]
    assert "main:useHelper" not in {r["id"] for r in s.nodes().collect()}
    store.replace_files(s, *parsed(spark, LIB[:3]), files("src/lib.ts"))  # helper goes, and the edge to it
    assert edges() == [("main:boot", "lib:Gateway.open")]


def test_single_file_stream(spark, tmp_path):
    """Files that arrive one by one: each is resolved against those before it, and a batch run twice changes nothing."""
    path = str(tmp_path / "graph")
    write = store.index_stream(path, every=2)
    schema = f"file string, version int, symbols array<struct<{_SYMBOL.replace(' string', ':string').replace(' int', ':int').replace('file:string, ', '')}>>, calls array<struct<call_id:long,caller:string,callee:string,receiver:string>>, imports array<struct<target_file:string,name:string>>"
    symbols = lambda rows: [(r[0], r[1], r[2], r[3], r[5]) for r in rows]
    lib = ("src/lib.ts", 1, symbols(LIB), [], [])
    main = ("src/main.ts", 2, symbols(MAIN), [(1, "main:boot", "open", "Gateway"), (2, "main:useHelper", "helper", None)], [("src/lib.ts", "Gateway"), ("src/lib.ts", "helper")])
    for number, batch in enumerate([[lib], [("src/main.ts", 1, symbols(MAIN), [], []), main], [main]]):
        write(spark.createDataFrame(batch, schema), number)
    got = store.Store(spark, path)
    assert sorted((r["src"], r["dst"]) for r in got.edges().collect()) == [("main:boot", "lib:Gateway.open"), ("main:useHelper", "lib:helper")]
    assert got.nodes().count() == 6


def test_crawl_guards_links_and_caps(spark, tmp_path):
    root = tmp_path / "repo"
    for p in ("src/a.ts", "src/deep/b.py", "src/deep/c.txt", "node_modules/x/i.js", "gen/out.ts", "top.go", "my.venv/z.py"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "o.ts").write_text("x")
    (root / "src/loop").symlink_to(root / "src")
    (root / "src/up").symlink_to("..")
    (root / "src/out").symlink_to(tmp_path / "outside")
    (root / "src/gone").symlink_to(root / "nowhere")
    (root / "src/linked.ts").symlink_to(root / "src/a.ts")
    (root / "src/pkg").symlink_to(root / "node_modules/x")
    (root / ".gitignore").write_text("gen/\n# no\n!gen/out.ts\n")
    every = ["src/a.ts", "src/deep/b.py", "src/linked.ts", "src/pkg/i.js", "top.go"]
    for branches in (1, 3, 64):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(crawl.CrawlSource)
        got = spark.read.format("crawl").option("branches", branches).load(str(root)).where("language is not null")
        assert sorted(r["path"] for r in got.collect()) == every
    found, report = crawl.crawl(spark, str(root), max_files=2)
    assert [r["path"] for r in found.collect()] == every[:2] and report.first().asDict() == {"files": 5, "truncated": True}
    found, report = crawl.crawl(spark, str(root), ignore="*.py\n", languages=("python", "go", "typescript"))
    assert [r["path"] for r in found.collect()] == ["src/a.ts", "src/linked.ts", "top.go"] and not report.first()["truncated"]
    assert [r["path"] for r in spark.read.format("crawl").load(str(root)).where("path like 'src/deep/%'").orderBy("path").collect()] == ["src/deep/b.py", "src/deep/c.txt"]


@pytest.mark.parametrize(
    ("rule", "fits", "not_"),
    [
        ("*.log", ["a.log", "x/y/a.log"], ["a.log/b", "log"]),
        ("build/", ["build", "build/x", "x/build"], ["x/build/y", "rebuild"]),
        ("src/*.ts", ["src/a.ts", "x/src/a.ts"], ["src/a/b.ts"]),
        ("**/tmp", ["a/tmp", "a/b/tmp", "tmp"], ["tmp/x"]),
        ("a**z", ["az", "a/b/z", "x/a/z"], ["a/y"]),
        ("?.c", ["a.c", "x/b.c"], ["ab.c"]),
        ("[ab].c", ["a.c", "x/b.c"], ["c.c"]),
        ("a.b", ["a.b"], ["axb"]),
        ("[z", ["[z"], ["z"]),
        ("*" * 30 + "x", ["x"], ["y"]),
        ("*a" * 25, [], ["a" * 25]),
        ("x" * 513, [], ["x" * 513]),
    ],
)
def test_ignore_rules(rule, fits, not_):
    import re

    pattern = re.compile(ignore.compiled([rule]) or "(?!)")
    assert all(pattern.search(p) for p in fits) and not any(pattern.search(p) for p in not_)


def test_ignore_files_by_folder(spark):
    assert ignore.rules_of("a\n\n # no\n  b \n!c\r\n") == ["a", "b"] and ignore.rules_of(None) == [] and ignore.compiled([]) is None
    paths = ["a/x.ts", "a/sub/x.ts", "b/x.ts", "a/gen/deep/y.ts", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["i"] for r in df.select("path", ignore.ignored(F.col("path"), {"a": ["gen", "/x.ts"], "a/sub": ["*.ts"]}).alias("i")).collect()}
    assert got == {"a/x.ts": False, "a/sub/x.ts": True, "b/x.ts": False, "a/gen/deep/y.ts": True, None: False}


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_innermost_equals_brute_force(spark, width):
    """Intervals of any shape, nested or not, with ties, other kinds and points that nothing covers."""
    rng = random.Random(width)
    spans = []
    for i in range(80):
        a = rng.randint(0, 60)
        spans.append((rng.choice(["f", "f", "f", "g"]), f"s{i:02}", rng.choice(["function", "method", "class"]), a, a + rng.randint(-1, 30)))
    points = [(rng.choice(["f", "g", "h", None]), f"p{i % 50}", a, a + rng.choice([0, 0, 3, 9, -1])) for i in range(150) for a in [rng.randint(0, 70)]]
    got = intervals.innermost(spark.createDataFrame(points, "file string, id string, start int, end int"), spark.createDataFrame(spans, "file string, id string, kind string, start int, end int"), width=width)

    def owner(file, a, b):
        inside = [(t - s, s, i) for f, i, k, s, t in spans if f == file and k != "class" and s <= t and s <= a <= b <= t]
        return min(inside)[2] if inside else None

    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((f, i, a, b, owner(f, a, b))) for f, i, a, b in points)


def test_blame_porcelain(spark):
    text = ["junk", "abcdef1 1 1 2", "author Ann B", "author-mail <a@x>", "author-time 1700000000", "summary s", "filename f", "\tlet x = 1", "abcdef2 9 2", "author ", "author-time soon", "\t", "abcdef3 1 3", "author Cy", "abcdef4 1 4", "author-time 5", "\tauthor not me", "0123456 1 5", "author Ann B", "\tz"]
    rows = blame.blame_lines(spark.createDataFrame([("f", n, t) for n, t in enumerate(text)], "file string, n long, text string"))
    got = {r["line"]: (r["sha"], r["author"], r["at"], r["content"]) for r in rows.collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1][0] == "abcdef1" and got[1][1] == "Ann B" and got[1][2].year == 2023 and got[1][3] == "let x = 1"
    assert got[2][1:] == ("", None, "") and got[4][1] is None and got[4][3] == "author not me"
    symbols = spark.createDataFrame([("s", "f", 1, 5), ("t", "f", 2, 4), ("u", "g", 1, 9)], "id string, file string, start int, end int")
    assert {r["id"]: r["authors"] for r in blame.symbol_authors(rows, symbols).collect()} == {"s": ["Ann B"]}


def test_ranks_of_a_group_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [("hot", i % 97, i) for i in range(3000)] + [("cold", 1, -1), (None, 2, -2), (None, 1, -3)]
        df = spark.createDataFrame(rows, "g string, k int, id int").repartition(7)
        got = {(r["g"], r["id"]): (r["rank"], r["of"]) for r in scan.ranked(df, "g", ["k", "id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for g in ("hot", "cold", None):
        mine = sorted(r[1:] for r in rows if r[0] == g)
        want |= {(g, i): (n + 1, len(mine)) for n, (_, i) in enumerate(mine)}
    assert got == want
    kept, report = scan.capped(df, "g", ["k", "id"], 2)
    assert kept.count() == 5 and {r["g"]: r["truncated"] for r in report.collect()} == {"hot": True, "cold": False, None: False}
