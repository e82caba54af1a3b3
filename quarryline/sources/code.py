"""Sources: files of a repository, parsers to rows, git text logs, schema files, JSONL ledgers."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import glob_regex, language_of, skip_dir

MAX_BYTES = 8 << 20


def files(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(file, content, size_bytes, language) of the files under root, without skipped directories and ignored globs."""
    base = root if "://" in root else f"file://{root}"
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(re.sub("^file:/+", "/", base).rstrip("/")) + "/", "")
    out = got.select(path.alias("file"), F.col("length").alias("size_bytes"), F.when(F.col("length") <= MAX_BYTES, F.col("content").cast("string")).alias("content"))
    out = out.where(~skip_dir(F.col("file")))
    for g in ignore:
        out = out.where(~F.col("file").rlike(glob_regex(g)))
    return out.withColumn("language", language_of(F.col("file")))


def python_rows(text: str) -> list[tuple]:
    """(row, name, kind, start_line, end_line, complexity, parent, extra) of a Python source: symbols, imports and calls."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    branch = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Assert, ast.AsyncFor, ast.AsyncWith)
    out: list[tuple] = []

    def walk(node, owner, scope):
        for child in ast.iter_child_nodes(node):
            here, inner = owner, scope
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                here, inner = f"{scope}.{child.name}" if scope else child.name, f"{scope}.{child.name}" if scope else child.name
                out.append(("symbol", here, kind, child.lineno, child.end_lineno, 1 + sum(isinstance(x, branch) for x in ast.walk(child)), scope or None, None))
            elif isinstance(child, ast.Assign) and isinstance(node, ast.Module):
                out.extend(("symbol", t.id, "constant", child.lineno, child.end_lineno, 1, None, None) for t in child.targets if isinstance(t, ast.Name) and t.id.isupper())
            elif isinstance(child, ast.Import):
                out.extend(("import", a.name, "module", child.lineno, child.end_lineno, 0, owner, a.asname) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend(("import", "." * child.level + (child.module or ""), "name", child.lineno, child.end_lineno, 0, owner, a.name) for a in child.names)
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    out.append(("call", f.id, "function", child.lineno, child.end_lineno, 0, owner, None))
                elif isinstance(f, ast.Attribute):
                    out.append(("call", f.attr, "method", child.lineno, child.end_lineno, 0, owner, ast.unparse(f.value)[:200]))
            walk(child, here, inner)

    walk(tree, None, "")
    return out


#: Declarations of languages parsed by pattern: language, kind, pattern whose group 1 is the name.
PATTERNS = [
    ("graphql", "type", r"(?m)^\s*(?:type|input|interface|union|scalar)\s+(\w+)"), ("graphql", "enum", r"(?m)^\s*enum\s+(\w+)"), ("prisma", "table", r"(?m)^\s*(?:model|view)\s+(\w+)"), ("prisma", "enum", r"(?m)^\s*enum\s+(\w+)"),
    ("sql", "table", r"(?im)^\s*create\s+(?:table|view)\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)"), ("sql", "query", r"(?im)^\s*create\s+(?:or\s+replace\s+)?function\s+([\w.]+)"), ("aql", "query", r"(?i)\bfor\s+\w+\s+in\s+(\w+)"),
    ("typescript", "function", r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("typescript", "class", r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("typescript", "interface", r"(?m)^\s*(?:export\s+)?interface\s+(\w+)"),
    ("typescript", "function", r"(?m)^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("javascript", "function", r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("javascript", "class", r"(?m)^\s*(?:export\s+)?class\s+(\w+)"),
    ("go", "function", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("go", "class", r"(?m)^type\s+(\w+)\s+struct"), ("rust", "function", r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("rust", "class", r"(?m)^\s*(?:pub\s+)?(?:struct|enum)\s+(\w+)"), ("rust", "interface", r"(?m)^\s*(?:pub\s+)?trait\s+(\w+)"),
    ("java", "class", r"(?m)\bclass\s+(\w+)"), ("java", "interface", r"(?m)\binterface\s+(\w+)"), ("csharp", "class", r"(?m)\bclass\s+(\w+)"), ("csharp", "interface", r"(?m)\binterface\s+(\w+)"), ("cpp", "class", r"(?m)^\s*(?:class|struct)\s+(\w+)"), ("ruby", "class", r"(?m)^\s*class\s+(\w+)"),
    ("ruby", "method", r"(?m)^\s*def\s+(\w+)"), ("php", "class", r"(?m)\bclass\s+(\w+)"), ("php", "function", r"(?m)\bfunction\s+(\w+)"), ("kotlin", "class", r"(?m)\bclass\s+(\w+)"), ("kotlin", "function", r"(?m)\bfun\s+(\w+)"), ("swift", "class", r"(?m)\b(?:class|struct)\s+(\w+)"), ("swift", "function", r"(?m)\bfunc\s+(\w+)"),
]
ROWS = "file string, row string, name string, kind string, start_line int, end_line int, complexity int, parent string, extra string"


def parse(sources: DataFrame) -> DataFrame:
    """Symbols, imports and calls of sources (file, language, content): Python by its grammar, the others by patterns (symbols only)."""

    def run(frames):
        for pdf in frames:
            out = []
            for file, language, text in zip(pdf["file"], pdf["language"], pdf["content"], strict=True):
                if not text:
                    continue
                if language == "python":
                    out += [(file, *r) for r in python_rows(text)]
                for lang, kind, pattern in PATTERNS:
                    if lang == language or (lang == "typescript" and language == "tsx"):
                        for m in re.finditer(pattern, text):
                            line = text.count("\n", 0, m.start(1)) + 1
                            out.append((file, "symbol", m[1], kind, line, line, 1, None, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return sources.select("file", "language", "content").mapInPandas(run, ROWS)


def numstat(lines: DataFrame) -> DataFrame:
    """(file, commits, additions, deletions) from `git log --numstat` lines (line); binary files ('-') are skipped."""
    p = F.split("line", "\t")
    rows = lines.where(F.col("line").rlike("^[0-9]+\t[0-9]+\t.+")).select(F.get(p, F.lit(2)).alias("file"), F.get(p, F.lit(0)).cast("long").alias("a"), F.get(p, F.lit(1)).cast("long").alias("d"))
    return rows.groupBy("file").agg(F.count("*").alias("commits"), F.sum("a").alias("additions"), F.sum("d").alias("deletions"))


def diff_ranges(lines: DataFrame, part: str = "diff") -> DataFrame:
    """(file, range_start, range_end) of the new side from diff lines (diff, n, line): the file is carried forward over hunks."""
    w = Window.partitionBy(part).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("file", F.last(F.when(F.col("line").startswith("+++ b/"), F.expr("substring(line, 7)")), ignorenulls=True).over(w))
    start = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1).cast("int")
    size = F.regexp_extract("line", r"^@@ -\S+ \+\d+,(\d+)", 1)
    n = F.when(size == "", F.lit(1)).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -\\\\S+ \\\\+\\\\d+,(\\\\d+)', 1) as int)"))
    hunks = named.where(F.col("line").rlike(r"^@@ -\S+ \+\d+")).select("file", start.alias("range_start"), n.alias("size"))
    return hunks.where("size > 0").select("file", "range_start", (F.col("range_start") + F.col("size") - 1).alias("range_end"))


_SKIP = {"constraint", "primary", "foreign", "unique", "check", "key", "index", "exclude"}


def ddl_tables(text: str) -> list[tuple[str, str, list[str]]]:
    """(name, kind, columns) of CREATE TABLE and CREATE VIEW statements."""
    out = []
    for m in re.finditer(r"(?i)create\s+(?:or\s+replace\s+)?(table|view)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*(\()?", text):
        name = re.sub(r"[\"`\[\]]", "", m[2]).split(".")[-1]
        cols: list[str] = []
        if m[1].lower() == "table" and m[3]:
            depth, start, parts = 1, m.end(), []
            for i in range(m.end(), len(text)):
                c = text[i]
                depth += (c == "(") - (c == ")")
                if depth == 0 or (c == "," and depth == 1):
                    parts.append(text[start:i])
                    start = i + 1
                    if depth == 0:
                        break
            for p in parts:
                first = re.match(r"\s*[\"`\[]?(\w+)", p)
                if first and first[1].lower() not in _SKIP:
                    cols.append(first[1])
        out.append((name, m[1].lower(), cols))
    return out


def prisma_tables(text: str) -> list[tuple[str, str, list[str]]]:
    return [(m[2], "view" if m[1] == "view" else "table", re.findall(r"(?m)^\s+(\w+)\s+\w", m[3])) for m in re.finditer(r"(?m)^(model|view)\s+(\w+)\s*\{([^}]*)\}", text)]


def graphql_tables(text: str) -> list[tuple[str, str, list[str]]]:
    return [(m[1], "table", re.findall(r"(?m)^\s+(\w+)\s*(?:\([^)]*\))?\s*:", m[2])) for m in re.finditer(r"(?m)^(?:type|interface)\s+(\w+)[^{]*\{([^}]*)\}", text) if m[1] not in ("Query", "Mutation", "Subscription")]


def schema_tables(sources: DataFrame) -> DataFrame:
    """(file, name, kind, columns) of schema files (file, language, content)."""
    readers = {"sql": ddl_tables, "prisma": prisma_tables, "graphql": graphql_tables}

    def run(frames):
        for pdf in frames:
            out = [(f, *t) for f, lang, c in zip(pdf["file"], pdf["language"], pdf["content"], strict=True) if lang in readers and c for t in readers[lang](c)]
            yield pd.DataFrame(out, columns=["file", "name", "kind", "columns"])

    return sources.select("file", "language", "content").mapInPandas(run, "file string, name string, kind string, columns array<string>")


def source_slice(sources: DataFrame, start: int, end: int, margin: int = 5) -> DataFrame:
    """Lines start-margin to end+margin of each content (file, content)."""
    lines = F.split("content", "\n")
    lo = max(1, start - margin)
    return sources.select("file", F.lit(lo).alias("from_line"), F.array_join(F.slice(lines, lo, end + margin - lo + 1), "\n").alias("slice"))
