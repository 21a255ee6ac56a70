"""Snapshots of a file catalogue: difference, deletion, last-writer-wins upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import in_subtree

#: Changes of the time stamp below this are none.
SAME_MTIME = 1e-6


def snapshot_diff(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, state) with state added, changed, removed or unchanged, from path, size and mtime; one shuffle by path."""
    a, b = stored.select("path", "size", "mtime").alias("a"), scanned.select("path", "size", "mtime").alias("b")
    same = (F.col("a.size") == F.col("b.size")) & (F.abs(F.col("a.mtime") - F.col("b.mtime")) < SAME_MTIME)
    state = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))


def apply_scan(stored: DataFrame, scanned: DataFrame, unreadable: Sequence[str] = ()) -> DataFrame:
    """The next snapshot: scanned rows, learned columns kept where nothing changed, rows below unreadable folders carried over.

    Both have path, size, mtime; columns that only stored has are null for added and changed files.
    """
    learned = [c for c in stored.columns if c not in scanned.columns]
    s = stored.select(*[F.col(c).alias(f"__{c}") for c in ("path", "size", "mtime", *learned)])
    same = (F.col("__size") == F.col("size")) & (F.abs(F.col("__mtime") - F.col("mtime")) < SAME_MTIME)
    out = scanned.join(s, F.col("path") == F.col("__path"), "left").select(*scanned.columns, *[F.when(same, F.col(f"__{c}")).alias(c) for c in learned])
    for root in unreadable:
        missed = stored.where(in_subtree(F.col("path"), root)).join(scanned.select("path"), "path", "left_anti")
        out = out.unionByName(missed.select(*out.columns))
    return out


def delete_subtrees(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Files without the given paths and all below them; the comparisons reach Parquet statistics."""
    for root in roots:
        files = files.where(~in_subtree(F.col("path"), root))
    return files


def ancestors(path: Column, itself: bool = True) -> Column:
    """The folders above a path, from the top, and the path itself."""
    parts = F.split(path, "/")
    last = F.size(parts) if itself else F.size(parts) - 1
    return F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.when(k == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))


def without_subtrees(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Files that neither are a path of gone(path) nor lie below one: each asks for its ancestors, an equi join."""
    asked = files.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    hit = asked.join(gone.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def removed_rows(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key isn't in gone."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def upsert_latest(stored: DataFrame, changes: DataFrame, key: str = "path", order: str = "seq", deleted: str = "deleted") -> DataFrame:
    """Stored rows with changes applied: of each key the change of greatest order counts, and removes it if deleted.

    changes has the columns of stored plus order and deleted; max_by keeps one row per key before the shuffle.
    """
    columns = stored.columns
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns, deleted), order).alias("x"))
    untouched = stored.join(last.select(key), key, "left_anti").select(*columns)
    return untouched.unionByName(last.where(~F.col(f"x.{deleted}")).select("x.*").select(*columns))


def latest_events(events: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """Of each key the event of greatest order, with all its columns."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*events.columns), order).alias("x"))  # one row a key before the shuffle
    return last.select("x.*")
