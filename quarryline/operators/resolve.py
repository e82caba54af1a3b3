"""Resolution of imports, calls, inheritance and data links to edges: prioritised joins, the first candidate by a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import dirname, normalised, package_root, relation

SCRIPT_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts"]
PYTHON_EXTENSIONS = [".py", ".pyi"]
#: Kinds that a call can reach.
CALLABLE = ("function", "method", "class")
_IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def symbol_table(symbols: DataFrame) -> dict[str, DataFrame]:
    """First candidate (by file, start line, id) and number of candidates for each way that a name is looked up.

    `local`: callable ones by (file, name); `exported`: any by (file, name); `qualified` by qualified name;
    `qualified_in` by (qualified name, file); `bare`: callable ones without a scope by name.
    """
    s = symbols.select("id", "name", "kind", "file", "start_line", F.concat_ws(".", "scope", "name").alias("qualified"))
    can = s.where(F.col("kind").isin(*CALLABLE))

    def firsts(df, *keys):
        return df.groupBy(*keys).agg(F.min(F.struct("file", "start_line", "id")).getField("id").alias("dst"), F.count("*").alias("n"))

    return {"local": firsts(can, "file", "name"), "exported": firsts(s, "file", "name"), "qualified": firsts(s, "qualified"), "qualified_in": firsts(s, "qualified", "file"), "bare": firsts(can.where("qualified = name"), "name")}


def import_targets(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, name, target_file) of named imports, the smallest file of a name, and (file, target_file) of wildcards."""
    named = imports.where("name <> '*'").groupBy("file", "name").agg(F.min("target_file").alias("target_file"))
    return named, imports.where("name = '*'").select("file", "target_file").distinct()


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """calls(call_id, caller, file, callee, receiver) to (call_id, src, dst, confidence, reason).

    In order: `receiver.callee` as a qualified name, preferring the caller's file and then the file that the receiver is
    imported from, 0.95 (the receiver being a plain identifier other than `this`); a callable symbol of the same file 1.0,
    or 0.85 if there are several; named import 0.95; wildcard import 0.8; qualified name 0.7; callable module-level name
    0.5. imports(file, target_file, name; name '*' for a wildcard). Every tier looks up one first candidate for each
    distinct (file, receiver, callee), so common names are not joined with all their bearers.
    """
    t = symbol_table(symbols)
    named, wild = import_targets(imports)
    sites = calls.select("file", "receiver", "callee").distinct()
    plain = F.col("receiver").rlike(_IDENTIFIER) & (F.col("receiver") != "this")
    x = sites.withColumn("q", F.when(plain, F.concat_ws(".", "receiver", "callee"))).withColumn("r", F.when(plain, F.col("receiver")))
    x = x.join(t["qualified_in"].select(F.col("qualified").alias("q"), "file", F.col("dst").alias("own")), ["q", "file"], "left")
    x = x.join(named.select("file", F.col("name").alias("r"), F.col("target_file").alias("via")), ["file", "r"], "left")
    x = x.join(t["qualified_in"].select(F.col("qualified").alias("q"), F.col("file").alias("via"), F.col("dst").alias("other")), ["q", "via"], "left")
    x = x.join(t["qualified"].select(F.col("qualified").alias("q"), F.col("dst").alias("any")), "q", "left")
    x = x.join(t["local"].select("file", F.col("name").alias("callee"), F.col("dst").alias("local"), "n"), ["file", "callee"], "left")
    by_name = named.join(t["exported"].select(F.col("file").alias("target_file"), "name", "dst"), ["target_file", "name"]).select("file", F.col("name").alias("callee"), F.col("dst").alias("named"))
    x = x.join(by_name, ["file", "callee"], "left")
    far = sites.select("file", "callee").distinct().join(wild, "file").join(t["exported"].select(F.col("file").alias("target_file"), F.col("name").alias("callee"), "dst"), ["target_file", "callee"])
    x = x.join(far.groupBy("file", "callee").agg(F.min_by("dst", "target_file").alias("wild")), ["file", "callee"], "left")
    x = x.join(t["qualified"].select(F.col("qualified").alias("callee"), F.col("dst").alias("whole")), "callee", "left")
    x = x.join(t["bare"].select(F.col("name").alias("callee"), F.col("dst").alias("bare")), "callee", "left")
    found = None
    for dst, confidence, reason in ((F.coalesce("own", "other", "any"), F.lit(0.95), "receiver"), (F.col("local"), F.when(F.col("n") > 1, 0.85).otherwise(1.0), "same file"), (F.col("named"), F.lit(0.95), "named import"), (F.col("wild"), F.lit(0.8), "wildcard import"), (F.col("whole"), F.lit(0.7), "qualified name"), (F.col("bare"), F.lit(0.5), "bare name")):
        value = F.struct(dst.alias("dst"), confidence.cast("double").alias("confidence"), F.lit(reason).alias("reason"))
        found = F.when(dst.isNotNull(), value) if found is None else found.when(dst.isNotNull(), value)
    x = x.select("file", "receiver", "callee", found.alias("found")).where("found is not null")
    c, y = calls.select("call_id", "caller", "file", "receiver", "callee").alias("c"), x.alias("y")
    both = c.join(y, (F.col("c.file") == F.col("y.file")) & (F.col("c.callee") == F.col("y.callee")) & F.col("c.receiver").eqNullSafe(F.col("y.receiver")))
    return both.select("call_id", F.col("c.caller").alias("src"), "found.dst", "found.confidence", "found.reason")


def resolve_paths(imports: DataFrame, files: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """imports(file, specifier[, language]) to (file, specifier, target_file), null for what is outside the repository.

    Scripts: relative specifiers against the file's folder and aliases (prefix to folders, in order), without a script
    suffix; Python (language python): leading dots climb, other dotted names start at the root. A base is tried as it is,
    with each extension, then as a folder with an index (or `__init__`) file; the first that exists wins.
    """
    here = dirname(F.col("file"))
    x = imports if "language" in imports.columns else imports.withColumn("language", F.lit("typescript"))
    bare = F.regexp_replace("specifier", r"\.(jsx?|mjs|cjs)$", "")
    bases = F.when(bare.startswith("./") | bare.startswith("../"), F.array(normalised(F.concat_ws("/", here, bare))))
    for prefix, targets in (aliases or {}).items():
        rest = F.regexp_replace(F.expr(f"substring(regexp_replace(specifier, '[.](jsx?|mjs|cjs)$', ''), {len(prefix) + 1})"), "^/", "")
        bases = bases.when((bare == prefix) | bare.startswith(prefix + "/"), F.array(*[normalised(F.concat_ws("/", F.lit(t), rest)) for t in targets]))
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    name = F.translate(F.regexp_replace("specifier", r"^\.+", ""), ".", "/")
    climbed = F.concat_ws("/", here, F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/"), F.when(name != "", name))
    python = F.array(F.when(dots > 0, normalised(climbed)).otherwise(name))
    scripts = ["", *SCRIPT_EXTENSIONS, *[f"/index{e}" for e in SCRIPT_EXTENSIONS]]
    pythons = ["", *PYTHON_EXTENSIONS, *[f"/index{e}" for e in PYTHON_EXTENSIONS], *[f"/__init__{e}" for e in PYTHON_EXTENSIONS]]
    tails = F.when(F.col("language") == "python", F.array(*map(F.lit, pythons))).otherwise(F.array(*map(F.lit, scripts)))
    tried = x.select("file", "specifier", F.when(F.col("language") == "python", python).when(F.col("language").isin("typescript", "tsx", "javascript"), bases).alias("bases"), tails.alias("tails"))
    each = tried.select("file", "specifier", "tails", F.posexplode("bases").alias("b", "base")).select("file", "specifier", "b", F.posexplode(F.transform("tails", lambda e: F.concat("base", e))).alias("t", "path"))
    hit = each.join(files.select(F.col("file").alias("path")).distinct(), "path").groupBy("file", "specifier").agg(F.min_by("path", F.struct("b", "t")).alias("target_file"))
    return imports.join(hit, ["file", "specifier"], "left").select(*imports.columns, "target_file")


def import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence) of imports(file, specifier, target_file, named, default_alias, namespace_alias).

    Named ones reach the symbols of that name 1.0; a default the symbols named `default`, else the file, 0.9; a namespace
    the file 0.9; an import of nothing the file 0.8; one without a target the external module 0.9.
    """
    src, file = F.concat(F.lit("file:"), "file"), F.concat(F.lit("file:"), "target_file")
    s = symbols.select(F.col("file").alias("target_file"), "name", "id")
    inside = imports.where("target_file is not null")

    def rows(df, dst, confidence):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit("imports").alias("kind"), F.lit(confidence).alias("confidence"))

    named = rows(inside.withColumn("name", F.explode("named")).join(s, ["target_file", "name"]), F.col("id"), 1.0)
    default = inside.where("default_alias is not null").join(s.where("name = 'default'").select("target_file", "id"), "target_file", "left")
    nothing = inside.where("coalesce(size(named), 0) <= 0 and default_alias is null and namespace_alias is null")
    parts = [named, rows(default, F.coalesce("id", file), 0.9), rows(inside.where("namespace_alias is not null"), file, 0.9), rows(nothing, file, 0.8), rows(imports.where("target_file is null and specifier <> ''"), F.concat(F.lit("import:"), "specifier"), 0.9)]
    return reduce(DataFrame.unionByName, parts).distinct()


def code_relations(edges: DataFrame) -> DataFrame:
    """(src, dst, kind) recovered from stored edges(src, dst, kind): symbol to symbol, and file to symbol where it imports."""
    symbol, of_file = "code-symbol:", "code-file:"
    kind = relation(F.col("kind"))
    keep = edges.where(F.col("dst").startswith(symbol) & (F.col("src").startswith(symbol) | (F.col("src").startswith(of_file) & (kind == "imports"))))
    dst = F.regexp_replace("dst", f"^{symbol}", "")
    repo = F.when(dst.contains("/"), F.substring_index(dst, "/", 1)).otherwise(F.lit(""))
    file = F.regexp_replace("src", f"^{of_file}", "")
    own = F.when((repo != "") & file.startswith(F.concat(repo, F.lit("/"))), F.substring(file, F.length(repo) + 2, F.length(file))).otherwise(file)
    src = F.when(F.col("src").startswith(symbol), F.regexp_replace("src", f"^{symbol}", "")).otherwise(F.concat(F.lit("file:"), own))
    return keep.select(src.alias("src"), dst.alias("dst"), kind.alias("kind")).distinct()


def inheritance(symbols: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence) from signatures: `extends X` and `implements X, Y`; unique qualified name 1.0, bare name 0.7."""
    ext = F.regexp_extract_all("signature", F.lit(r"extends\s+([A-Za-z0-9_.]+)"), 1)
    imp = F.split(F.regexp_extract("signature", r"implements\s+([A-Za-z0-9_., ]+)", 1), r",\s*")
    both = symbols.select("id", F.explode(F.concat(F.transform(ext, lambda x: F.struct(F.lit("extends").alias("kind"), x.alias("target"))), F.transform(imp, lambda x: F.struct(F.lit("implements").alias("kind"), F.trim(x).alias("target"))))).alias("x")).select("id", "x.kind", "x.target").where("target <> ''")
    s = symbols.where(F.col("kind").isin("class", "interface")).select(F.col("id").alias("dst"), "name", F.concat_ws(".", "scope", "name").alias("qualified"), "file", "start_line")
    exact = both.join(s, F.col("target") == F.col("qualified")).select("id", both["kind"], "target", "dst", F.lit(0).alias("p"), F.lit(1.0).alias("confidence"), "file", "start_line")
    bare = both.join(s, F.col("target") == F.col("name")).select("id", both["kind"], "target", "dst", F.lit(1).alias("p"), F.lit(0.7).alias("confidence"), "file", "start_line")
    best = first_by(exact.unionByName(bare), ["id", "kind", "target"], ["p", "file", "start_line", "dst"])
    return best.where("id <> dst").select(F.col("id").alias("src"), "dst", "kind", "confidence")


def contains(symbols: DataFrame) -> DataFrame:
    return symbols.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))


WRITES = r"(?i)\b(insert|update|delete|merge|upsert|create|save|write)\b"


def data_links(bodies: DataFrame, tables: DataFrame) -> DataFrame:
    """bodies(id, body), tables(table): (src, table, kind) where the body names the table; writes if it has a write word."""
    marked = bodies.select("id", F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"(\w+)"), 1)).alias("words"), F.when(F.col("body").rlike(WRITES), "writes").otherwise("queries").alias("kind"))
    words = marked.select("id", "kind", F.explode("words").alias("word"))
    named = tables.where(F.length("table") >= 3).select(F.lower("table").alias("word"), "table").distinct()
    return words.join(named, "word").select(F.col("id").alias("src"), "table", "kind").distinct()


def find_symbol(symbols: DataFrame, query: str) -> DataFrame:
    """The best tier (id, qualified name, bare name) that fits, each with whether several repositories have it."""
    tier = F.when(F.col("id") == query, 0).when(F.concat_ws(".", "scope", "name") == query, 1).when(F.col("name") == query, 2)
    hit = symbols.withColumn("tier", tier).where("tier is not null")
    best = hit.agg(F.min("tier").alias("tier"))
    hit = hit.join(F.broadcast(best), "tier")  # one row
    many = hit.agg((F.countDistinct("repo") > 1).alias("ambiguous"))
    return hit.join(F.broadcast(many)).select("id", "tier", "ambiguous")  # one row


def package_bridge(imports: DataFrame, members: DataFrame) -> DataFrame:
    """imports(repo, module), members(member, package): links from a repository to another member that owns the package."""
    return imports.select("repo", package_root(F.col("module")).alias("package")).distinct().join(members, "package").where("repo <> member").select("repo", "member", "package").distinct()


def workspace_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest registered root above each path (ties: the earliest added): ancestors are exploded and equi-joined."""
    parts = F.split("path", "/")
    ups = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    best = ups.join(roots, "root").groupBy("path").agg(F.min(F.struct((-F.length("root")).alias("l"), "added", "workspace")).alias("b"))
    return paths.join(best, "path", "left").select("path", F.col("b.workspace").alias("workspace"))
