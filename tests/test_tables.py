import os
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestar.functions import exif, extract
from lodestar.operators import apps, geo, snapshot
from lodestar.queries import COUNTRIES, MOUNTS, PLACES, _photo_bytes
from lodestar.sources import tables, tree
from lodestar.streaming import events as stream

PLACE_SCHEMA = "lat double, lon double, city string, state string, code string"


def test_nearest_places(spark):
    places, countries = spark.createDataFrame(PLACES, PLACE_SCHEMA), spark.createDataFrame(COUNTRIES, "code string, name string")
    made = [(1, 52.5, 13.4), (2, -1.3, 36.8), (3, 69.6, 19.5), (4, 0.0, -30.0), (5, 78.22, 15.65), (6, -16.8, -179.9), (7, None, 1.0)]
    found = geo.place_words(geo.nearest_place(spark.createDataFrame(made, "id int, lat double, lon double"), places), countries)
    out = {r.id: (r.city, set(r.words)) for r in found.collect()}
    assert {"berlin", "germany"} <= out[1][1] and "nairobi" in out[2][1] and "tromso" in out[3][1]
    assert out[4][0] is None and out[5][0] is None and out[6][0] == "Labasa" and out[7][0] is None and "county" not in out[2][1]


def test_snapshots(spark):
    old = spark.createDataFrame([("/a", 1, 1.0, 5.0), ("/b", 1, 1.0, 5.0), ("/c/x", 1, 1.0, 5.0)], "path string, size long, mtime double, content_mtime double")
    new = spark.createDataFrame([("/a", 1, 1.0), ("/b", 2, 1.0), ("/d", 1, 1.0)], "path string, size long, mtime double")
    assert rows(snapshot.snapshot_diff(old, new)) == [("/a", "unchanged"), ("/b", "changed"), ("/c/x", "removed"), ("/d", "added")]
    assert rows(snapshot.apply_scan(old, new, ["/c"]), "path", "content_mtime") == [("/a", 5.0), ("/b", None), ("/c/x", 5.0), ("/d", None)]
    assert rows(snapshot.delete_subtrees(old, ["/c"]), "path") == [("/a",), ("/b",)]


def test_upserts_take_the_last_change(spark):
    stored = spark.createDataFrame([("/a", 1), ("/b", 1)], "path string, v int")
    changes = spark.createDataFrame([("/a", 2, 1, False), ("/a", 3, 3, False), ("/b", 9, 2, True), ("/c", 4, 1, True), ("/c", 5, 2, False)], "path string, v int, seq int, deleted boolean")
    assert rows(snapshot.upsert_latest(stored, changes)) == [("/a", 3), ("/c", 5)]


def test_mounts(spark):
    assert rows(tables.skipped_mounts(spark.createDataFrame([(m,) for m in MOUNTS], "value string"))) == [("/dev",), ("/home/dev/remote",), ("/mnt/my nas",), ("/proc",), ("/run",), ("/snap/core/1",), ("/sys",)]
    assert tables.read_mounts(spark, "/nowhere") == []


def test_desktop_entries_and_ranking(spark, tmp_path):
    for rank, (name, text) in enumerate([("e.desktop", "Name=Fancy Editor\nName[de]=Feiner Editor\nMimeType=text/markdown;text/plain;"), ("n.desktop", "Name=Basic Notes\nMimeType=text/plain;"), ("h.desktop", "Name=Hidden\nNoDisplay=true\nMimeType=text/plain;")]):
        folder = tmp_path / str(rank % 2)
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(f"[Desktop Entry]\nType=Application\nExec=x %f\n{text}\n[Desktop Action y]\nName=No\n")
    found = tables.desktop_entries(spark, [str(tmp_path / "0"), str(tmp_path / "1"), "/none"], ["de"])
    ranked = apps.apps_for_mime(apps.offered_apps(found), ["text/markdown", "text/plain"])
    assert [(r.name, r.position) for r in ranked.collect()] == [("Feiner Editor", 0), ("Basic Notes", 1)]


def test_exif(spark):
    data = _photo_bytes(b"2024:07:13 14:22:05", 52.5, 13.4)
    assert exif.photo_info(data) == (1720880525.0, 52.5, 13.4)
    assert exif.photo_info(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data)[0] == 1720880525.0
    assert exif.photo_info(b"RIFF....WEBP" + b"Exif\0\0" + data)[1] == 52.5
    for cut in range(0, len(data), 3):
        exif.photo_info(data[:cut])
    assert exif.photo_info(_photo_bytes(b"1899:01:01 00:00:00", 100, 0)) is None


def test_texts():
    assert extract.rtf_text(rb"{\rtf1\ansi Hello \b bold\b0  w\'f6rld}") == "Hello bold w rld"
    assert extract.rough_strings(b"\0\1Quarterly report\0\1" + "wide letters".encode("utf-16-le") + b"\x00#$%^&*()") == "Quarterly report wide letters"
    assert extract.text_of("txt", b"a\0b") == "" and extract.text_of("docx", b"PK") == "" and extract.text_of("txt", b"\xffok") == "ok"
    assert len(extract.text_of("md", b"x" * 50_000)) == 20_000 and extract.text_of(None, None) == ""


def test_tree_scan(spark, tmp_path):
    for p in ("a/one.txt", "a/.hidden/two.txt", "b/venv/three.txt", "b/four_é.txt", "top.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("hello")
    os.symlink(tmp_path / "a", tmp_path / "link")
    found = tree.scan(spark, [str(tmp_path), str(tmp_path / "a")], excludeNames="venv", contentBytes="3")
    got = {r.path[len(str(tmp_path)) + 1 :]: (r.is_dir, r.size, r.content) for r in found.collect()}
    assert got == {"a": (True, 0, None), "b": (True, 0, None), "a/one.txt": (False, 5, b"hel"), "b/four_é.txt": (False, 5, b"hel"), "top.txt": (False, 5, b"hel")}
    assert tree.scan(spark, ["/nowhere"]).count() == 0
    assert tree.is_deep("/a/b", ["/a"]) and not tree.is_deep("/ab", ["/a"]) and tree.is_deep("/x", ["/"])


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    tables.Settings(whole_system=False, include=["/x"]).save(path)
    assert tables.Settings.load(path).roots == ["/x"] and tables.Settings().roots == ["/"]
    (tmp_path / "s.json").write_text('{"unknown": 1, "skip_hidden": false}')
    assert tables.Settings.load(path).skip_hidden is False
    (tmp_path / "s.json").write_text("{")
    assert tables.Settings.load(path) is None and tables.Settings.load("/none") is None


def test_stream(spark, tmp_path):
    made = [("click", "/f", None, "Tax Return", 1.0, 1), ("click", "/f", None, "Tax Return", 1.0, 1), ("changed", "/a", None, None, 2.0, 2), ("deleted", "/a", None, None, 3.0, 3), ("renamed", "/x", "/y", None, 4.0, 4), ("changed", "/b", None, None, 5.0, 5)]
    events = spark.createDataFrame(made, "kind string, path string, path2 string, query string, ts double, seq long")
    events.write.json(str(tmp_path / "in"))
    seen = []
    query = stream.follow(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "clicks"), str(tmp_path / "searches"), str(tmp_path / "cp"), lambda df, n: seen.extend(rows(df, "path", "kind")), True)
    assert query.awaitTermination(60)
    assert sorted(seen) == [("/a", "deleted"), ("/b", "changed"), ("/x", "deleted"), ("/y", "changed")]
    assert rows(spark.read.parquet(str(tmp_path / "clicks")), "term", "path", "ts") == [("return", "/f", 1.0), ("tax", "/f", 1.0)]
    assert rows(spark.read.parquet(str(tmp_path / "searches")), "query") == [("tax return",)]
    assert stream.distinct_events(events).count() == 5


def test_throttles():
    t = stream.Throttle()
    assert t.due(29, 0) is False and t.due(1, 1) is True and t.due(40, 60) is False and t.due(0, 200) is True
    assert stream.rescan_due(1000, 600, True, False) and not stream.rescan_due(1000, 600, False, True) and not stream.rescan_due(1e9, 0, False, False)


def test_windows_take_late_events(spark):
    df = spark.createDataFrame([("2024-01-01 23:59:59", "view", 1.0), ("2024-01-02 00:00:00", "view", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in stream.windowed_counts(df).collect()) == [1, 1]


def test_catalog_keeps_logs_and_survives_a_failed_write(spark, tmp_path):
    from lodestar.sources.catalog import Catalog

    c = Catalog(spark, str(tmp_path))
    assert c.read("files") is None and c.get_meta("scan", "0") == "0"
    for k in range(4):
        c.write("files", spark.range(k + 1), sort="id")
    assert c.read("files").count() == 4 and c.versions("files") == [3, 4]
    (tmp_path / "v2" / "files" / "9").mkdir()  # a write that never ended
    assert c.read("files").count() == 4
    c.append("clicks", spark.range(2))
    c.append("clicks", spark.range(3))
    c.set_meta("scan", "1")
    c.set_meta("scan", "2")
    assert c.get_meta("scan") == "2"
    c.reset()
    assert c.read("files") is None and c.read("clicks").count() == 5


def test_offers_and_runnables(spark):
    from lodestar.functions.files import is_runnable

    entries = spark.createDataFrame([("a", "A", ["x/y"], 0, "gone", ["KDE"]), ("b", "B", ["x/y"], 0, None, [])], "id string, name string, mime_types array<string>, dir_rank int, try_exec string, only_show_in array<string>")
    assert rows(apps.offered_apps(entries, installed=["sh"]), "id") == [("b",)] and rows(apps.offered_apps(entries, ["GNOME"]), "id") == [("b",)]
    assert rows(spark.createDataFrame([("sh",), ("txt",)], "e string").where(is_runnable(F.col("e")))) == [("sh",)]
    assert extract.text_of("pdf", b"%PDF") == ""


def test_stream_subtrees_scans_and_quarantine(spark, tmp_path):
    made = [("changed", "/a/x", None, None, 1.0, 1), ("changed", "/a/b/y", None, None, 2.0, 2), ("deleted", "/a", None, None, 3.0, 3), ("changed", "/a/new", None, None, 4.0, 4), ("changed", "/ab/z", None, None, 2.5, 2), ("rescan", None, None, None, 5.0, 5), ("rebuild", None, None, None, 6.0, 6)]
    events = spark.createDataFrame(made, "kind string, path string, path2 string, query string, ts double, seq long")
    assert rows(stream.batch_state(events), "path", "kind", "seq") == [("/a", "deleted", 3), ("/a/b/y", "deleted", 3), ("/a/new", "changed", 4), ("/a/x", "deleted", 3), ("/ab/z", "changed", 2)]
    events.write.json(str(tmp_path / "in"))
    scans = []

    def apply(df, n):
        raise ValueError("no such folder")

    query = stream.follow(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "c"), str(tmp_path / "s"), str(tmp_path / "cp"), apply, True, lambda rebuild, n: scans.append(rebuild), str(tmp_path / "bad"))
    assert query.awaitTermination(60) and query.exception() is None and scans == [True]
    left = spark.read.parquet(str(tmp_path / "bad"))
    assert left.count() == 7 and {(r.step, r.error) for r in left.collect()} == {("apply", "no such folder")}
    assert stream.learn_after_scan(200, True) and stream.learn_after_scan(0, False) and not stream.learn_after_scan(199, True)


def test_a_batch_changes_the_snapshot(spark):
    files = spark.createDataFrame([("/a/x", 1), ("/a/b/y", 1), ("/ab/z", 1), ("/c", 1), ("/d", 1)], "path string, size int")
    state = spark.createDataFrame([("/a", "deleted", 3), ("/a/new", "changed", 4), ("/c", "changed", 5), ("/d", "changed", 6)], "path string, kind string, seq long")
    fresh = spark.createDataFrame([("/a/new", 2), ("/c", 3)], "path string, size int")
    assert rows(stream.apply_state(files, state, fresh)) == [("/a/new", 2), ("/ab/z", 1), ("/c", 3)]


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    from lodestar.sources.catalog import Catalog

    class Late(Catalog):
        def versions(self, table, ended=True):
            return []

    Catalog(spark, str(tmp_path)).write("files", spark.range(2))
    with pytest.raises(Exception, match="(?i)exists"):
        Late(spark, str(tmp_path)).write("files", spark.range(3))
    assert Catalog(spark, str(tmp_path)).read("files").count() == 2


def test_commands_and_names(spark):
    line = lambda x: apps.command_line(x, "/a b/c.txt", "My App", "/x.desktop")
    assert line("edit %F") == ["edit", "/a b/c.txt"] and line("open --at=%u %i") == ["open", "--at=file:///a%20b/c.txt"]
    assert line("run --name %c %k 100%%") == ["run", "--name", "My App", "/x.desktop", "100%", "/a b/c.txt"] and line("x %d") == ["x", "/a b/c.txt"]
    with pytest.raises(ValueError):
        line('broken "quote')
    entries = spark.createDataFrame([("a", "Text Editor"), ("b", "Viewer")], "id string, name string")
    assert rows(apps.named_like(entries, " EDIT "), "id") == [("a",)] and apps.named_like(entries, "").count() == 2
