"""Scan of folder trees as a Spark data source: one partition for each first-level folder."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.filters import path_ranges
from ..schema import RAW_FILES


def clean_roots(paths: list[str]) -> list[str]:
    """Absolute existing folders, without those inside another."""
    real = sorted({os.path.abspath(os.path.expanduser(p)) for p in paths if os.path.isdir(os.path.expanduser(p))})
    return [p for p in real if not any(o != p and (o == "/" or p.startswith(f"{o}/")) for o in real)]


def is_deep(path: str, roots: list[str]) -> bool:
    return path_ranges(roots) is None or any(path == r.rstrip("/") or path.startswith(f"{r.rstrip('/')}/") for r in roots)


class _Folder(InputPartition):
    def __init__(self, top: str, walk: bool) -> None:
        self.top, self.walk = top, walk


class TreeSource(DataSource):
    """Format "tree": path, is_dir, size, mtime, content of folders and regular files.

    Options: path (roots, comma separated), excludeNames, exclude, mounts (comma separated), skipHidden (true),
    contentBytes (0 reads no content). Links are not followed; unreadable folders and undecodable names are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self):
        return RAW_FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        listed = lambda key: [x for x in options.get(key.lower(), options.get(key, "")).split(",") if x]
        self.roots, self.exclude_names = clean_roots(listed("path")), set(listed("excludeNames"))
        self.exclude, self.mounts = listed("exclude"), set(listed("mounts"))
        self.skip_hidden = str(options.get("skiphidden", options.get("skipHidden", "true"))).lower() != "false"
        self.content_bytes = int(options.get("contentbytes", options.get("contentBytes", 0)))

    def _skips(self, path: str, name: str, is_dir: bool) -> bool:
        if self.skip_hidden and name.startswith(".") or is_dir and (name in self.exclude_names or path in self.mounts):
            return True
        return any(path == p or path.startswith(f"{p}/") for p in self.exclude)

    def _entries(self, folder: str) -> Iterator[os.DirEntry]:
        try:
            with os.scandir(folder) as found:
                for e in sorted(found, key=lambda e: e.name):
                    try:
                        e.path.encode()
                        wanted = e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)
                    except (UnicodeEncodeError, OSError):
                        continue
                    if wanted and not self._skips(e.path, e.name, e.is_dir(follow_symlinks=False)):
                        yield e
        except OSError:
            return

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            out.append(_Folder(root, False))
            out += [_Folder(e.path, True) for e in self._entries(root) if e.is_dir(follow_symlinks=False)]
        return out or [_Folder("", False)]

    def _row(self, path: str, is_dir: bool) -> tuple | None:
        try:
            s = os.lstat(path)
        except OSError:
            return None
        return path, is_dir, 0 if is_dir else s.st_size, s.st_mtime, None if is_dir or not self.content_bytes else read_head(path, self.content_bytes)

    def read(self, partition: _Folder) -> Iterator[tuple]:
        """A root's own files, or a first-level folder with all below it."""
        stack = [partition.top] if partition.top else []
        while stack:
            folder = stack.pop()
            if partition.walk and (row := self._row(folder, True)):
                yield row
            for e in self._entries(folder):
                if e.is_dir(follow_symlinks=False):
                    if partition.walk:
                        stack.append(e.path)
                elif row := self._row(e.path, False):
                    yield row


def read_head(path: str, limit: int) -> bytes | None:
    """The first bytes of a regular file; null for links, pipes and what can't be opened."""
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except OSError:
        return None
    try:
        return os.read(fd, limit) if stat.S_ISREG(os.fstat(fd).st_mode) else None
    except OSError:
        return None
    finally:
        os.close(fd)


def scan(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(path=",".join(roots), **options).load()
