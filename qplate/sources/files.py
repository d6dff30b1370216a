"""Files named by a caller (files, folders, patterns, or a list of them): listed, numbered and read by Spark.

The order of files is by the first entry of the list that holds them, then by full path.  Neither the list of files nor their
numbers pass through the driver's Python; only the caller's own entries do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qplate.operators._util import number_rows

PLACE = ("_path", "_block", "_id")  # of a row that was read: its file, its block's start, its place among the task's rows
_PATTERN = re.compile(r"[*?\[{]")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Spark itself resolves it: with scheme, absolute, without repeated slashes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def plain_path(uri: Column) -> Column:
    """A path out of Spark's metadata as :func:`qualified` spells it (decoded, one slash behind the scheme)."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^([A-Za-z][A-Za-z0-9+.-]*):/+(?=[^/])", "$1:/")


def pattern_regex(pattern: str) -> str:
    """The regular expression of a file pattern with ``* ? [..] {a,b}``; none of them spans a slash."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i + 2:]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1:end]
            out += "[" + re.sub(r"^[!^]", "^/", inside).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def _holders(path: Column) -> Column:
    """What an entry has to name so that Spark reads ``path`` for it: the file, its folder, or one above it that only
    folders of the form ``key=value`` part from it."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.filter(above, lambda a: F.substr(path, F.length(a) + 1).rlike(r"^((/[^/=]+=[^/]*)*/[^/]*)?$"))


def _read_with(spark: SparkSession, path: str, entries: set[str]) -> bool:
    """Whether Spark reads ``path`` with another entry: a file of its folder, or either in a ``key=value`` folder of it."""
    above, name = path.rsplit("/", 1)
    inside = "=" in name
    while above in entries or "=" in above.rsplit("/", 1)[-1]:
        if above in entries:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            return inside or not p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
        above = above.rsplit("/", 1)[0]
    return False


class Entries:
    """A caller's entries, qualified and each once, in their order."""

    def __init__(self, spark: SparkSession, paths: str | Sequence[str]):
        given = [paths] if isinstance(paths, str) else list(paths)
        if not given:
            raise ValueError("no paths given")
        self.given = list(dict.fromkeys(qualified(spark, p) for p in given))
        exact = [p for p in self.given if not _PATTERN.search(p)]
        self.patterns = [p for p in self.given if _PATTERN.search(p)]
        self.exact = [p for p in exact if not _read_with(spark, p, set(exact))]

    def reads(self, apart: bool = False) -> list[tuple[list[str], list[str]]]:
        """(what one scan reads, the entries whose files it leaves out since an earlier scan has them).

        All files and folders make one scan, each pattern another; with ``apart`` every entry has its own.
        """
        groups = [[p] for p in (self.given if apart else self.patterns)]
        if not apart and self.exact:
            groups.insert(0, self.exact)
        return [(g, [p for h in groups[:i] for p in h]) for i, g in enumerate(groups)]

    def rank(self, path: Column) -> Column:
        """Place of the first entry that holds the file."""
        if len(self.given) == 1:
            return F.lit(0)
        holders = _holders(path)
        exact = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for i, p in enumerate(self.given) if p not in self.patterns])
        least = F.array_min(F.transform(F.filter(exact, lambda e: F.array_contains(holders, e["p"])), lambda e: e["i"]))
        by_pattern = [F.when(_matches(holders, p), F.lit(self.given.index(p))) for p in self.patterns]
        return F.least(F.lit(len(self.given)), *([least] if len(self.patterns) < len(self.given) else []), *by_pattern)

    def holds(self, path: Column, entries: list[str]) -> Column:
        holders = _holders(path)
        plain = [p for p in entries if p not in self.patterns]
        found = F.arrays_overlap(holders, F.array(*[F.lit(p) for p in plain])) if plain else F.lit(False)
        for p in entries:
            if p in self.patterns:
                found = found | _matches(holders, p)
        return found


def _matches(holders: Column, pattern: str) -> Column:
    regex = pattern_regex(pattern)
    return F.exists(holders, lambda a: a.rlike(regex))


def scans(spark: SparkSession, paths: str | Sequence[str], load: Callable[[list[str]], DataFrame], apart: bool = False) -> DataFrame:
    """The rows of all files, each file once, with the columns of ``PLACE``.

    (``_path``, ``_block``, ``_id``) orders the rows of a file as they stand in it: a block is read by one task, row by row.
    """
    entries = Entries(spark, paths)
    out = None
    for read, before in entries.reads(apart):
        rows = load(read)
        rows = rows.select("*", plain_path(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                           F.monotonically_increasing_id().alias("_id"))
        if before:
            rows = rows.filter(~entries.holds(F.col("_path"), before))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def numbered_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Pinned (path, name, _row): the files of ``paths`` (without their bytes), ``name`` without ``.txt``, densely numbered from 0."""
    listed = scans(spark, paths, lambda given: spark.read.format("binaryFile").load(given).select("length", "_metadata")) \
        .select(F.col("_path").alias("path"))
    files = listed.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "").alias("name"),
                          Entries(spark, paths).rank(F.col("path")).alias("_entry"))
    return number_rows(files, [F.col("_entry"), F.col("path")]).drop("_entry")
