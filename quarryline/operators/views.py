"""Small read-only views over the graph, the ledger and file tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import loc, slug
from .graph import cut, free

#: Identifiers and characters of a file's card, and of a symbol's.
FILE_CARD, SYMBOL_CARD = (160, 2000), (40, 600)
_IDENTIFIER = r"([A-Za-z_][A-Za-z0-9_]+)"


def authors(lines: DataFrame, key: str, author: str) -> DataFrame:
    """(key, authors): the distinct authors of a symbol's lines, sorted and joined by commas."""
    return lines.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(author)), ",").alias("authors"))


def import_nodes(modules: DataFrame) -> DataFrame:
    """(id) of a node for each imported module (module)."""
    return modules.select(F.concat(F.lit("code-import:"), slug(F.col("module"))).alias("id")).distinct()


def card(text: Column, most: int, length: int) -> Column:
    """The distinct identifiers of a text in order, at most `most` of them and `length` characters."""
    return F.substring(F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(_IDENTIFIER), 1)), 1, most), " "), 1, length)


def file_cards(files: DataFrame) -> DataFrame:
    """(file, card): path and identifiers of files(file, content)."""
    return files.select("file", F.concat_ws(" ", "file", card(F.col("content"), *FILE_CARD)).alias("card"))


def symbol_cards(symbols: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """(id, card) of the symbols (id, file, start_line, end_line) that span `least` lines or more."""
    big = symbols.where(F.col("end_line") - F.col("start_line") + 1 >= least)
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return big.join(files.select("file", "content"), "file").select("id", card(body, *SYMBOL_CARD).alias("card"))


def context_mode(files: int, symbols: int, wanted: str = "spans", most_files: int = 10_000, most_symbols: int = 20_000) -> str:
    """off, file or spans: what cards are affordable."""
    if wanted == "off" or files > most_files:
        return "off"
    return "file" if wanted == "spans" and symbols > most_symbols else wanted


def skipped_summary(skipped: DataFrame, sample: int = 5) -> DataFrame:
    """(reason, n, sample) of skipped(file, reason)."""
    return skipped.groupBy("reason").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("file")), 1, sample).alias("sample"))


def callers(edges: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """(id, callers, files, more): who calls a symbol, the first files by name and how many more there are."""
    c = edges.where("kind = 'calls'").join(symbols.select(F.col("id").alias("src"), "file"), "src")
    files = F.sort_array(F.collect_set("file"))
    return c.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"), F.array_join(F.slice(files, 1, most), ",").alias("files"), F.greatest(F.countDistinct("file") - most, F.lit(0)).alias("more"))


def degrees(edges: DataFrame, largest: float = 1.8) -> DataFrame:
    """(id, degree, size): distinct neighbours and the size to draw a node at."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("o")).unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("o"))).distinct()
    return both.groupBy("id").agg(F.count("*").alias("degree")).withColumn("size", F.round(F.least(F.lit(largest), 1 + F.log2(1 + F.col("degree")) / 10), 6))


def expand(shown: DataFrame, edges: DataFrame, node: str, most: int = 200) -> DataFrame:
    """shown(id, parent) with the neighbours of a node, at most `most` by id, that are not shown yet."""
    near = edges.where(F.col("src") == node).select(F.col("dst").alias("id")).unionAll(edges.where(F.col("dst") == node).select(F.col("src").alias("id"))).distinct()
    new = near.where(F.col("id") != node).orderBy("id").limit(most).select("id", F.lit(node).alias("parent"))
    return shown.select("id", "parent").unionByName(new).distinct()


def collapse(shown: DataFrame, node: str) -> DataFrame:
    """shown(id, parent) without the rows that the node opened, and all that hung on nothing else, level by level.

    Every level is a table of its own: the ids that lost their last row take the rows under them along. Rows are merged, not
    broadcast, as a level may be as large as what is shown.
    """
    rows = cut(shown.select("id", "parent"))
    rest = cut(rows.where((F.col("parent") != node) | F.col("parent").isNull()))
    lost = cut(rows.where(F.col("parent") == node).select("id").distinct())
    free(rows)
    while True:
        gone = cut(lost.join(rest.select("id").hint("merge"), "id", "left_anti"))
        free(lost)
        if not gone.limit(1).count():
            free(gone)
            return rest
        under = gone.withColumnRenamed("id", "parent").hint("merge")
        lost = cut(rest.join(under, "parent", "left_semi").select("id").distinct())
        fewer = cut(rest.join(under, "parent", "left_anti").select("id", "parent"))
        for done in (rest, gone):
            free(done)
        rest = fewer


def visible(nodes: DataFrame, hidden_types: list[str], projects: list[str]) -> DataFrame:
    """(type, visible) counts of the nodes that the filters leave."""
    return nodes.where(~F.col("type").isin(hidden_types) & F.col("project").isin(projects)).groupBy("type").agg(F.count("*").alias("visible"))


def citations(lists: list[DataFrame]) -> DataFrame:
    """Distinct ids of several results."""
    return reduce(DataFrame.unionByName, [df.select("id") for df in lists]).where("id is not null").distinct()


def file_nodes(files: DataFrame, repo: str) -> DataFrame:
    """(id, type, label, language, loc, size_bytes) of files(file, content, language, size_bytes)."""
    return files.select(F.concat(F.lit(f"code-file:{repo}/"), "file").alias("id"), F.lit("code_file").alias("type"), F.col("file").alias("label"), "language", loc(F.col("content")).alias("loc"), "size_bytes")


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """(id, type, label, ...) of symbols(uid, name, ...)."""
    return symbols.select(F.concat(F.lit("code-symbol:"), "uid").alias("id"), F.lit("code_symbol").alias("type"), F.col("name").alias("label"), *[c for c in symbols.columns if c != "name"])


def stored_edges(symbols: DataFrame, relations: DataFrame, repo: str) -> DataFrame:
    """(src, dst, kind): file to symbol containment and relations between uids (file: and import: ends become their nodes)."""
    contains = symbols.select(F.concat(F.lit(f"code-file:{repo}/"), "file").alias("src"), F.concat(F.lit("code-symbol:"), "uid").alias("dst"), F.lit("contains").alias("kind"))

    def node(c: str) -> Column:
        rest = F.regexp_replace(c, "^[a-z]+:", "")
        return F.when(F.col(c).startswith("file:"), F.concat(F.lit(f"code-file:{repo}/"), rest)).when(F.col(c).startswith("import:"), F.concat(F.lit("code-import:"), slug(rest))).otherwise(F.concat(F.lit("code-symbol:"), c))

    return contains.unionByName(relations.select(node("src").alias("src"), node("dst").alias("dst"), "kind")).distinct()


def relations_by_file(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """relations with the file that owns their source: a symbol's file or a file: source itself."""
    at = symbols.select(F.col("id").alias("src"), "file")
    return relations.join(at, "src", "left").withColumn("file", F.coalesce("file", F.when(F.col("src").startswith("file:"), F.expr("substring(src, 6)")))).where("file is not null")
