"""Predicates over file tables: kinds, sizes, dates, folder segments, path ranges, skip rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import effective_date


@dataclass
class FileFilter:
    """Conditions that all must hold; an unset one doesn't filter. Dates are epoch seconds, half open."""

    kinds: Sequence[str] = ()
    min_size: int | None = None
    max_size: int | None = None
    after: float | None = None
    before: float | None = None
    folders: Sequence[str] = ()
    scope: Sequence[str] | None = None

    def condition(self) -> Column | None:
        parts = []
        if self.scope:
            parts.append(under_any(F.col("path"), self.scope))
        if self.kinds:
            parts.append(F.col("kind").isin(list(self.kinds)))
        if self.min_size is not None:
            parts.append(F.col("size") >= self.min_size)
        if self.max_size is not None:
            parts += [~F.col("is_dir"), F.col("size") <= self.max_size]
        when = effective_date(F.col("taken"), F.col("mtime"))
        if self.after is not None:
            parts.append(when >= self.after)
        if self.before is not None:
            parts.append(when < self.before)
        parts += [has_segment(F.col("folder"), w) for w in self.folders]
        parts = [p for p in parts if p is not None]
        return reduce(and_, parts) if parts else None

    def apply(self, files: DataFrame) -> DataFrame:
        condition = self.condition()
        return files if condition is None else files.where(condition)


def has_segment(folder: Column, word: str) -> Column:
    """Whether a folder path has a segment equal to word, in any case."""
    return F.contains(F.concat(F.lower(folder), F.lit("/")), F.lit(f"/{word.lower()}/"))


def path_ranges(roots: Sequence[str]) -> list[tuple[str, str]] | None:
    """Open ranges of the paths below roots; None if a root is / (all paths). '0' is the sign after '/'."""
    if any(r.rstrip("/") == "" for r in roots):
        return None
    return [(f"{r.rstrip('/')}/", f"{r.rstrip('/')}0") for r in roots]


def under_any(path: Column, roots: Sequence[str]) -> Column | None:
    """Whether a path lies below one of the roots, as comparisons that Parquet statistics can use. No root: false."""
    ranges = path_ranges(roots)
    if ranges is None:
        return None
    return reduce(or_, [(path > low) & (path < high) for low, high in ranges], F.lit(False)) if ranges else F.lit(False)


def in_subtree(path: Column, root: str) -> Column:
    """Root itself or anything below it."""
    below = under_any(path, [root])
    return F.lit(True) if below is None else (path == root.rstrip("/")) | below


def top_roots(roots: DataFrame) -> DataFrame:
    """roots(path) without those inside another: each path asks for its own ancestors, an equi join."""
    clean = roots.select(F.when(F.rtrim("path", F.lit("/")) == "", "/").otherwise(F.rtrim("path", F.lit("/"))).alias("path")).distinct()
    parts = F.split("path", "/")
    # ancestors of /a/b/c: /, /a, /a/b
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.when(k == 1, "/").otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    asked = clean.where("path <> '/'").select("path", F.explode(above).alias("above"))
    inner = asked.join(clean.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return clean.join(inner, "path", "left_anti")


def skipped(path: Column, name: Column, is_dir: Column, exclude_names: Sequence[str] = (), exclude: Sequence[str] = (), mounts: Sequence[str] = (), skip_hidden: bool = True) -> Column:
    """Whether a scan leaves an entry out: hidden, an excluded folder name, a skipped mount, an excluded path or what is below one."""
    tests = [F.lit(False)]
    if skip_hidden:
        tests.append(name.startswith("."))
    if exclude_names:
        tests.append(is_dir & name.isin(list(exclude_names)))
    if mounts:
        tests.append(is_dir & path.isin(list(mounts)))
    tests += [(path == p) | path.startswith(f"{p}/") for p in exclude]
    return reduce(or_, tests)


def needs_extraction(extensions: Sequence[str], deep_roots: Sequence[str]) -> Column:
    """Files of wanted kinds below deep roots whose content was read at another time than they changed."""
    below = under_any(F.col("path"), deep_roots)
    fresh = ~F.col("is_dir") & (F.col("content_mtime") != F.col("mtime")) & F.col("ext").isin(list(extensions))
    return fresh if below is None else fresh & below


def newest(files: DataFrame, limit: int, by_taken: bool = True) -> DataFrame:
    """The most recent files; ties by id."""
    when = effective_date(F.col("taken"), F.col("mtime")) if by_taken else F.col("mtime")
    return files.orderBy(when.desc(), "id").limit(limit)


def nearby(files: DataFrame, path: str, limit: int = 200) -> DataFrame:
    """Other files of the same folder by time of change."""
    folder = path.rpartition("/")[0] or "/"
    return newest(files.where((F.col("folder") == folder) & (F.col("path") != path)), limit, by_taken=False)


def existing_folders(words: DataFrame, files: DataFrame) -> DataFrame:
    """words(word) with exists: whether a folder of that name is there, in any case."""
    names = files.where("is_dir").select(F.lower("name").alias("word")).distinct().withColumn("exists", F.lit(True))
    return words.join(names, F.lower(words["word"]) == names["word"], "left").select(words["word"], F.coalesce("exists", F.lit(False)).alias("exists"))
