"""Scalar column expressions: paths, identifiers, tags, text and redaction. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """Everything before the last slash; '.' for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def slug(name: Column) -> Column:
    """Symbol slug: other characters than letters, digits, dot, underscore, dash become one underscore; trimmed; never empty."""
    s = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", F.lit("_")).otherwise(s)


def fnv1a8(text: Column) -> Column:
    """FNV-1a, 32 bits, 8 hex digits, over a string's UTF-16 code units."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    each = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.length(units) / 4)), lambda i: F.substring(units, (4 * i + 1).cast("int"), F.lit(4))), lambda u: u != "")
    codes = F.transform(each, lambda u: F.conv(u, 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def normalise_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def has_tags(tags: Column, wanted: list[str]) -> Column:
    """Every wanted tag is present, whatever the case."""
    have = F.transform(tags, F.lower)
    out = F.lit(True)
    for t in wanted:
        out = out & F.array_contains(have, t.lower())
    return out


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a token in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


def snippet(text: Column, most: int = 280) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def camel_tokens(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def package_root(module: Column) -> Column:
    """The package a module specifier belongs to: two segments of a scoped one, else the first; none for relative ones."""
    return F.when(module.startswith(".") | module.startswith("/"), F.lit(None)).when(module.startswith("@"), F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))


def relation(kind: Column) -> Column:
    known = ["calls", "imports", "extends", "implements", "contains", "queries", "writes", "references"]
    return F.when(kind.isin(known), kind).when(kind == "called_by", "calls").when(kind == "refers_to", "imports").otherwise(F.lit("calls"))


def node_class(node: Column) -> Column:
    out = None
    for prefix, name in (("code-file:", "file"), ("code-symbol:", "symbol"), ("code-context:", "context"), ("code-folder:", "folder"), ("code-import:", "import"), ("knowledge:", "knowledge")):
        out = F.when(node.startswith(prefix), name) if out is None else out.when(node.startswith(prefix), name)
    return out.otherwise(F.lit("other"))


def loc(content: Column) -> Column:
    """Lines with a character other than white space."""
    return F.size(F.filter(F.split(content, "\n"), lambda line: F.trim(F.translate(line, "\t\r", "  ")) != ""))


def verbatim_id(text: Column) -> Column:
    return F.concat(F.lit("verbatim:"), F.substring(F.sha2(text, 256), 1, 12))


def chunk_estimate(text: Column) -> Column:
    return (F.lit(1) + F.ceil(F.greatest(F.lit(0), F.length(text) - 1200) / 1050)).cast("long")


#: Folders that are never entered, as fixed values; besides them any with venv in its name.
SKIP_DIRS = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "coverage", ".next", ".nuxt", ".cache", "__pycache__", ".venv", "venv", "site-packages", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "env", ".eggs",
    ".turbo", ".parcel-cache", "bower_components", ".gradle", "Pods", ".terraform", ".serverless",
)


def skip_dir(path: Column, names: tuple[str, ...] = SKIP_DIRS) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.isin(list(names)) | F.lower(s).contains("venv"))


#: Paths of tests, mocks, fixtures and snapshots, as fixed values.
TEST_PATHS = (r"\.(test|spec)\.[cm]?[jt]sx?$", r"(^|/)(__tests__|__mocks__|__fixtures__|__snapshots__)(/|$)", r"(^|/)e2e(/|$)", r"\.snap$")


def is_test_file(path: Column) -> Column:
    return path.rlike("|".join(TEST_PATHS))


#: What is redacted, in order: secrets by their label, e-mail addresses, card numbers, social security and phone numbers.
REDACTIONS = (
    r"(?i)\b(password|passwd|api[_-]?key|secret|token)\s*[:=]\s*\S+",
    r"\bsk-[A-Za-z0-9]{16,}\b",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b|\b\d{4}[ -]?\d{6}[ -]?\d{5}\b|\b\d{16}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"(\+\d{1,2} )?\(\d{3}\) ?\d{3}-\d{4}|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
)


#: Cheap signs without which a text has nothing to redact: @, a label of a secret, sk-, or a run of three digits.
_SIGNS = r"[@]|\d{3}|sk-|(?i:passw|api[_-]?key|secret|token)"


def redact(text: Column) -> Column:
    """text with what REDACTIONS finds replaced; texts without any sign of it are read once."""
    out = text
    for pattern in REDACTIONS:
        out = F.regexp_replace(out, pattern, "[REDACTED]")
    return F.when(text.rlike(_SIGNS), out).otherwise(text)


def glob_regex(glob: str) -> str:
    """Regular expression of a glob: ** any path, * within a segment, ? one character; too long or too many stars: nothing."""
    if len(glob) > 512 or glob.count("*") > 24:
        return "(?!)"
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + glob[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + ("\\" + c if c in r"\.^$+{}()|[]" else c), i + 1
    return f"^{out}$"


#: File extension to language, as fixed values.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "pyi": "python", "go": "go", "rs": "rust",
    "java": "java", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "rb": "ruby", "php": "php", "phtml": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift",
    "sql": "sql", "ddl": "sql", "dml": "sql", "graphql": "graphql", "gql": "graphql", "prisma": "prisma", "aql": "aql",
}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def strip_generics(name: Column) -> Column:
    """A type's name without its arguments, array marks and qualifier: `ns.Map<K, V>[]` is `Map`."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"[<\[(].*$", ""), r"^.*(\.|::)", "")


#: Characters of a verbatim entry's text, and lines of a file in which its date is looked for.
VERBATIM_CAP, DATE_LINES = 100_000, 20


def verbatim_content(source: Column, at: Column, text: Column, cap: int = VERBATIM_CAP) -> Column:
    """A verbatim entry's content: its source and time as a header, an empty line, its text; a text over the cap ends in a mark."""
    body = F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("\n[truncated]"))).otherwise(text)
    return F.concat(F.lit("SOURCE: "), source, F.lit("\nAT: "), at, F.lit("\n\n"), body)


def verbatim_parts(content: Column) -> Column:
    """struct(source, at, text) of a verbatim entry's content; what the header lacks is empty."""
    lines = F.split(content, "\n")
    field = lambda k, mark: F.when(F.get(lines, F.lit(k)).startswith(mark), F.substring(F.get(lines, F.lit(k)), len(mark) + 1, 1 << 30)).otherwise("")
    rest = F.array_join(F.slice(lines, F.lit(4), F.greatest(F.size(lines) - 3, F.lit(0))), "\n")
    return F.struct(field(0, "SOURCE: ").alias("source"), field(1, "AT: ").alias("at"), rest.alias("text"))


def date_in_head(text: Column) -> Column:
    """The first ISO date in a text's first lines, else null."""
    return first_date(F.array_join(F.slice(F.split(text, "\n"), 1, DATE_LINES), "\n"))


def first_date(text: Column) -> Column:
    """The first ISO date in a text, else null."""
    found = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def epoch_of(text: Column) -> Column:
    """Seconds since 1970 of an ISO timestamp; 0 for what is none."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text)), F.lit(0))


def normalised(path: Column) -> Column:
    """A path without `.` and `x/..` segments; leading `..` stay; the empty path is `.`."""

    def step(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("..")) != "..")
        return F.when((s == ".") | (s == ""), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)
