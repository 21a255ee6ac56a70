"""Names, kinds, labels, sizes and times of files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each kind.
KIND_EXTENSIONS = {
    "pdf": "pdf",
    "image": "jpg jpeg png gif webp heic heif bmp svg tif tiff raw cr2 nef arw orf rw2 dng avif",
    "video": "mp4 mkv avi mov webm flv wmv m4v",
    "audio": "mp3 flac wav ogg m4a opus aac",
    "document": "doc docx odt rtf txt md epub tex rst",
    "spreadsheet": "xls xlsx ods csv tsv",
    "presentation": "ppt pptx odp",
    "archive": "zip tar gz xz bz2 7z rar zst tgz",
    "code": "py js ts c h cpp rs go java sh html css json yaml yml toml sql php rb",
}
TEXT_EXTENSIONS = "txt md rst csv tsv json yaml yml toml ini cfg conf log py js ts c h cpp rs go java sh html css xml tex sql org php rb".split()
ZIP_EXTENSIONS = "docx xlsx pptx odt ods odp epub".split()
OLE_EXTENSIONS = "doc xls ppt".split()
RTF_EXTENSIONS = ["rtf"]
PHOTO_EXTENSIONS = "jpg jpeg tif tiff png webp heic heif avif dng cr2 nef arw orf rw2".split()
# Kinds of files that may start a program.
RUNNABLE_EXTENSIONS = "desktop sh run appimage bin exe bat jar py pl rb command flatpakref deb rpm".split()

_KINDS = {ext: kind for kind, exts in KIND_EXTENSIONS.items() for ext in exts.split()}


def split_ext(name: Column) -> Column:
    """Lower-case text after the last dot, if a dot is left once the outer dots are off; else empty."""
    return F.when(F.instr(F.btrim(name, F.lit(".")), ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def kind_of(ext: Column, is_dir: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.when(is_dir, "folder").otherwise(F.coalesce(F.try_element_at(table, ext), F.lit("file")))


def type_label(kind: Column, ext: Column) -> Column:
    named = F.when(ext != "", F.concat(F.initcap(kind), F.lit(" ("), ext, F.lit(")"))).otherwise(F.initcap(kind))
    plain = F.when(ext != "", F.upper(ext)).otherwise("File")
    return F.when(kind == "folder", "Folder").when(kind == "pdf", "PDF").when(kind == "file", plain).otherwise(named)


def format_size(size: Column, kind: Column) -> Column:
    """Bytes in B, KB, MB or GB of 1024; folders have none."""
    s = size.cast("double")
    out = F.format_string("%.1f GB", F.bround(s / 1024**3, 1))
    for unit, power in (("MB", 2), ("KB", 1)):
        out = F.when(s < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(s / 1024**power, 1))).otherwise(out)
    return F.when(kind == "folder", "").when(s < 1024, F.format_string("%.0f B", s)).otherwise(out)


def format_time(seconds: Column) -> Column:
    """Minute precision in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def is_runnable(ext: Column) -> Column:
    """Whether opening a file of this extension may start a program."""
    return ext.isin(RUNNABLE_EXTENSIONS)


def wanted_extensions(index_text: bool = True, index_photos: bool = True, ole: bool = False, pdf: bool = False) -> list[str]:
    """Extensions whose content is read under these settings."""
    out = set(TEXT_EXTENSIONS + ZIP_EXTENSIONS + RTF_EXTENSIONS if index_text else [])
    out |= set(OLE_EXTENSIONS if index_text and ole else []) | set(["pdf"] if index_text and pdf else [])
    return sorted(out | set(PHOTO_EXTENSIONS if index_photos else []))


def effective_date(taken: Column, mtime: Column) -> Column:
    return F.coalesce(taken, mtime)


def folder_words(folder: Column, home: str) -> Column:
    """The part of a folder below the home folder, or all of it."""
    return F.when((folder == home) | folder.startswith(f"{home}/"), F.substr(folder, F.lit(len(home) + 1))).otherwise(folder)
