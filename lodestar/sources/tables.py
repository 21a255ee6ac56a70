"""Small sources: mount tables, application entries, gazetteers, settings; and the documents table as a file corpus."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import kind_of, split_ext
from ..schema import COUNTRIES, PLACES

# File systems that hold no files of one's own, and folders that are never searched.
SKIP_TYPES = (
    "proc sysfs devtmpfs devpts tmpfs ramfs cgroup cgroup2 securityfs debugfs tracefs configfs fusectl pstore bpf mqueue hugetlbfs "
    "autofs binfmt_misc overlay squashfs efivarfs nsfs rpc_pipefs fuse.portal fuse.gvfsd-fuse fuse.snapfuse "
    "nfs nfs4 cifs smb3 smbfs 9p ceph glusterfs afs fuse.sshfs fuse.rclone fuse.davfs davfs"
).split()
EXCLUDE_NAMES = ["node_modules", "__pycache__", "site-packages", "venv", ".venv", "lost+found"]
ALWAYS_SKIP = ["/proc", "/sys", "/dev", "/run", "/snap", "/var/lib/snapd", "/var/lib/docker", "/var/cache", "/var/lib/flatpak/repo"]


def unescape_octal(text: Column) -> Column:
    r"""\040 and the like as the signs they stand for."""
    parts = F.split(text, r"\\(?=[0-7]{3})")
    sign = lambda p: F.concat(F.char(F.conv(F.substring(p, 1, 3), 8, 10).cast("long")), F.substr(p, F.lit(4)))
    return F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(sign(p))), "")


def skipped_mounts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(mount_point) to skip, from lines of a mount table; the root never, lines out of shape neither."""
    halves = F.split(column, " - ", 2)
    left, right = F.filter(F.split(F.get(halves, 0), r"\s+"), lambda x: x != ""), F.filter(F.split(F.get(halves, 1), r"\s+"), lambda x: x != "")
    parsed = lines.where(F.size(halves) == 2).select(F.get(left, 4).alias("at"), F.get(right, 0).alias("type"))
    parsed = parsed.where(F.col("at").isNotNull()).select(unescape_octal(F.col("at")).alias("mount_point"), "type")
    return parsed.where((F.col("mount_point") != "/") & F.col("type").isin(SKIP_TYPES)).select("mount_point").distinct()


def read_mounts(spark: SparkSession, path: str = "/proc/self/mountinfo") -> list[str]:
    """Mount points to skip on the driver's machine; none if the table can't be read."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            lines = [(x,) for x in f.read().splitlines()]
    except OSError:
        return []
    return [r[0] for r in skipped_mounts(spark.createDataFrame(lines, "value string")).collect()]


def desktop_entries(spark: SparkSession, folders: list[str], languages: list[str] = ()) -> DataFrame:
    """(id, name, exec_line, icon, mime_types, path, dir_rank, flags) of .desktop files; earlier folders have lower ranks.

    Only the [Desktop Entry] section of applications that have a command counts. Names in the given languages come first.
    """
    out = None
    for rank, folder in enumerate(folders):
        if not os.path.isdir(folder):
            continue
        found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.desktop").select(F.col("value"), F.input_file_name().alias("path"), F.lit(rank).alias("dir_rank"))
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "value string, path string, dir_rank int")
    section = F.regexp_extract("value", r"(?s)(?:^|\n)\[Desktop Entry\][^\n]*\n(.*?)(?=\n\[|$)", 1)
    value = lambda key: F.nullif(F.trim(F.regexp_extract(section, rf"(?m)^{key}\s*=([^\r\n]*)", 1)), F.lit(""))
    flag = lambda key: F.lower(F.coalesce(value(key), F.lit("false"))) == "true"
    listed = lambda key: F.filter(F.split(F.coalesce(value(key), F.lit("")), ";"), lambda x: x != "")
    names = [value(rf"Name\[{x}\]") for x in languages] + [value("Name")]
    return out.where((value("Type") == "Application") & value("Exec").isNotNull()).select(
        F.regexp_extract("path", r"[^/]*$", 0).alias("id"), F.coalesce(*names).alias("name"), value("Exec").alias("exec_line"), F.coalesce(value("Icon"), F.lit("")).alias("icon"),
        listed("MimeType").alias("mime_types"), "path", "dir_rank", flag("NoDisplay").alias("no_display"), flag("Hidden").alias("hidden"), flag("Terminal").alias("terminal"),
        listed("OnlyShowIn").alias("only_show_in"), listed("NotShowIn").alias("not_show_in"), value("TryExec").alias("try_exec"),
    )


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer of lat, lon, city, state, code as CSV, plain or gzipped."""
    return spark.read.csv(path, schema=PLACES)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=COUNTRIES)


@dataclass
class Settings:
    """What to index. An unknown key of a settings file is dropped; a broken file gives none."""

    whole_system: bool = True
    include: list[str] = field(default_factory=list)
    deep_folders: list[str] = field(default_factory=lambda: [os.path.expanduser("~"), "/media", "/mnt"])
    exclude: list[str] = field(default_factory=list)
    exclude_names: list[str] = field(default_factory=lambda: list(EXCLUDE_NAMES))
    skip_hidden: bool = True
    index_text: bool = True
    index_photos: bool = True

    @property
    def roots(self) -> list[str]:
        return ["/"] if self.whole_system else list(self.include)

    @classmethod
    def load(cls, path: str) -> Settings | None:
        try:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
            names = {f.name for f in fields(cls)}
            return cls(**{k: v for k, v in data.items() if k in names})
        except (OSError, ValueError, AttributeError):
            return None

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1)


EXTENSIONS_OF_CORPUS = ("txt", "md", "pdf", "csv", "jpg")


def corpus(documents: DataFrame, most_chars: int | None = None) -> DataFrame:
    """The documents table as files: (id, path, name, folder, ext, kind, is_dir, size, mtime, taken, content).

    Extensions take turns, folders follow source and language, photos have been taken thirty days before their change,
    and the content is the whole text, or its first most_chars characters.
    """
    content = F.col("text") if most_chars is None else F.substring("text", 1, most_chars)
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS_OF_CORPUS]), F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    name = F.concat_ws(".", F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")), ext)
    folder = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"))
    mtime = (F.lit(1704067200) + F.col("doc_id") * 3600).cast("double")
    out = documents.select(F.col("doc_id").alias("id"), name.alias("name"), folder.alias("folder"), F.col("n_chars").alias("size"), mtime.alias("mtime"), content.alias("content"))
    out = out.withColumns({"path": F.concat("folder", F.lit("/"), "name"), "ext": split_ext(F.col("name")), "is_dir": F.lit(False)})
    out = out.withColumns({"kind": kind_of(F.col("ext"), F.col("is_dir")), "taken": F.when(F.col("ext") == "jpg", F.col("mtime") - 30 * 86400)})
    return out.select("id", "path", "name", "folder", "ext", "kind", "is_dir", "size", "mtime", "taken", "content")


def corpus_docs(files: DataFrame) -> DataFrame:
    """Texts to index of corpus(): photos have words of their date in extra."""
    when = F.timestamp_seconds("taken")
    extra = F.when(F.col("taken").isNotNull(), F.concat_ws(" ", F.date_format(when, "yyyy"), F.lower(F.date_format(when, "MMMM")))).otherwise("")
    return files.select("id", "name", "folder", "content", extra.alias("extra"))

