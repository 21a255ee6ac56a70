from conftest import rows
from pyspark.sql import functions as F

from lodestar.functions import files
from lodestar.operators import filters


def test_extensions_kinds_and_labels(spark):
    names = ["a.PDF", ".bashrc", ".tar.gz", "a.", "a.b.", "x.JPG", "noext", "y.xyz"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("ext", files.split_ext(F.col("name")))
    df = df.withColumn("kind", files.kind_of(F.col("ext"), F.lit(False)))
    out = {r.name: (r.ext, r.kind, r.label) for r in df.withColumn("label", files.type_label(F.col("kind"), F.col("ext"))).collect()}
    assert out["a.PDF"] == ("pdf", "pdf", "PDF") and out[".bashrc"] == ("", "file", "File") and out[".tar.gz"][0] == "gz"
    assert out["a."][0] == "" and out["x.JPG"] == ("jpg", "image", "Image (jpg)") and out["y.xyz"] == ("xyz", "file", "XYZ")


def test_sizes_and_times(spark):
    made = [(0, "file"), (1023, "file"), (1024, "file"), (1280, "file"), (5 << 20, "pdf"), (3 << 40, "video"), (7, "folder")]
    df = spark.createDataFrame(made, "size long, kind string").select("size", files.format_size(F.col("size"), F.col("kind")), files.format_time(F.lit(1704067200.0)))
    assert [tuple(r)[1:] for r in df.collect()] == [(s, "2024-01-01 00:00") for s in ("0 B", "1023 B", "1.0 KB", "1.2 KB", "5.0 MB", "3072.0 GB", "")]


def test_path_ranges():
    assert filters.path_ranges(["/"]) is None and filters.path_ranges([]) == []
    assert filters.path_ranges(["/home/a/", "/mnt"]) == [("/home/a/", "/home/a0"), ("/mnt/", "/mnt0")]


def test_scope_without_roots_is_empty_but_no_scope_is_all(spark):
    df = spark.createDataFrame([("/a/x",), ("/ab/y",), ("/a",)], "path string")
    assert rows(df.where(filters.under_any(F.col("path"), ["/a"]))) == [("/a/x",)]
    assert rows(df.where(filters.in_subtree(F.col("path"), "/a/"))) == [("/a",), ("/a/x",)]
    assert rows(df.where(filters.under_any(F.col("path"), []))) == []
    assert filters.FileFilter(scope=[]).condition() is None


def test_skips(spark):
    made = [("/h/.x", ".x", False), ("/h/venv", "venv", True), ("/h/venv2", "venv", False), ("/mnt/nas", "nas", True), ("/ex/in", "in", False), ("/exit", "exit", False)]
    df = spark.createDataFrame(made, "path string, name string, is_dir boolean")
    left = df.where(~filters.skipped(F.col("path"), F.col("name"), F.col("is_dir"), ["venv"], ["/ex"], ["/mnt/nas"]))
    assert rows(left, "path") == [("/exit",), ("/h/venv2",)]


def test_top_roots(spark):
    df = spark.createDataFrame([("/a/b",), ("/a",), ("/ab/c",), ("/a/",), ("/x/y/z",)], "path string")
    assert rows(filters.top_roots(df)) == [("/a",), ("/ab/c",), ("/x/y/z",)]
    assert rows(filters.top_roots(spark.createDataFrame([("/",), ("/q",)], "path string"))) == [("/",)]


def test_half_open_dates_and_folders(spark):
    made = [(1, "/d/Fr", "image", 5, 10.0, 4.0, False), (2, "/d/fr/x", "pdf", 5, 10.0, None, False), (3, "/d/friend", "pdf", 0, 10.0, None, True)]
    df = spark.createDataFrame(made, "id long, folder string, kind string, size long, mtime double, taken double, is_dir boolean")
    assert rows(filters.FileFilter(after=4.0, before=10.0).apply(df), "id") == [(1,)]
    assert rows(filters.FileFilter(folders=["FR"]).apply(df), "id") == [(1,), (2,)]
    assert rows(filters.FileFilter(max_size=9).apply(df), "id") == [(1,), (2,)]
