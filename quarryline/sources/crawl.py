"""A Spark source of a folder's files: spark.read.format("crawl").load(root), one partition for each of its branches.

The folder is one that the driver and all executors mount. Options: `ignore` (rules, one a line), `branches` (how
many folders to deal out at least, 64). Filters on path and language are applied before a file is stat-ed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..functions.exprs import LANGUAGES, SKIP_DIRS
from .ignore import IGNORE_FILES, compiled, rules_of


class Branch(InputPartition):
    """A folder, by its path from the root; whole: with all that is below it, else its own files only."""

    def __init__(self, folder: str, whole: bool):
        self.folder, self.whole = folder, whole


class CrawlReader(DataSourceReader):
    def __init__(self, root: str, ignore: str, branches: int):
        self.root, self.branches = os.path.realpath(root), branches
        lines = rules_of(ignore)
        for name in IGNORE_FILES:
            try:
                with open(os.path.join(self.root, name), encoding="utf-8", errors="replace") as f:
                    lines += rules_of(f.read())
            except OSError:
                continue
        self.pattern = compiled(lines, below=True)
        self.languages: set[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("language",):
                self.languages = {f.value} if self.languages is None else self.languages & {f.value}
            elif isinstance(f, In) and f.attribute == ("language",):
                self.languages = set(f.value) if self.languages is None else self.languages & set(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                yield f

    def _skipped(self, name: str) -> bool:
        return name in SKIP_DIRS or "venv" in name.lower()

    def _entries(self, folder: str, ignored) -> Iterator[tuple[str, bool, bool]]:
        """(path from the root, is a folder, is a link) of what a folder holds and no rule excludes.

        Links out of the root and dangling links are left out. A linked folder that the crawl enters by its own path is, too:
        so no folder is entered twice and no loop of links is followed.
        """
        try:
            found = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in found:
            path = f"{folder}/{e.name}" if folder else e.name
            if ignored and ignored.search(path):
                continue
            link = e.is_symlink()
            if link:
                real = os.path.realpath(e.path)
                if not os.path.exists(real) or not f"{real}/".startswith(f"{self.root}/"):
                    continue
                if os.path.isdir(real):
                    inside = os.path.relpath(real, self.root)
                    if inside == "." or not any(self._skipped(x) for x in inside.split(os.sep)):
                        continue
            is_dir = e.is_dir()
            if is_dir and self._skipped(e.name):
                continue
            if is_dir or e.is_file():
                yield path, is_dir, link

    def _wanted(self, folder: str) -> bool:
        """Whether files under a folder can have the prefixes that are asked for."""
        return all(f"{folder}/".startswith(p) or p.startswith(f"{folder}/") or not folder for p in self.prefixes)

    def partitions(self) -> list[Branch]:
        ignored = re.compile(self.pattern) if self.pattern else None
        done, open_ = [], [""]
        while open_ and len(done) + len(open_) < self.branches:
            folder = open_.pop(0)
            done.append(Branch(folder, False))
            open_ += [p for p, is_dir, link in self._entries(folder, ignored) if is_dir and not link and self._wanted(p)]
        return done + [Branch(p, True) for p in open_]

    def read(self, branch: Branch) -> Iterator[tuple]:
        ignored = re.compile(self.pattern) if self.pattern else None
        stack, entered = [branch.folder], set()
        while stack:
            folder = stack.pop()
            real = os.path.realpath(os.path.join(self.root, folder))
            if real in entered:
                continue
            entered.add(real)
            for path, is_dir, link in self._entries(folder, ignored):
                if is_dir:
                    if (branch.whole or link) and self._wanted(path):
                        stack.append(path)
                    continue
                language = LANGUAGES.get(os.path.splitext(path)[1].lstrip(".").lower())
                if (self.languages is not None and language not in self.languages) or not all(path.startswith(p) for p in self.prefixes):
                    continue
                try:
                    st = os.stat(os.path.join(self.root, path))
                except OSError:
                    continue
                yield path, language, st.st_size, int(st.st_mtime)


class CrawlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "path string, language string, size_bytes long, modified long"

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(self.options["path"], self.options.get("ignore", ""), int(self.options.get("branches", "64")))


def crawl(spark: SparkSession, root: str, ignore: str = "", languages: tuple[str, ...] = (), max_files: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(path, language, size_bytes, modified) of the first max_files source files by path, and (files, truncated).

    languages: only these; otherwise all that have one. The cap is a top-n over the whole crawl, not a stop at some branch.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CrawlSource)
    found = spark.read.format("crawl").option("ignore", ignore).load(root)
    found = found.where(F.col("language").isin(*languages)) if languages else found.where("language is not null")
    return found.orderBy("path").limit(max_files), found.agg(F.count("*").alias("files"), (F.count("*") > max_files).alias("truncated"))
