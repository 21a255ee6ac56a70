"""One query per operator over the test tables."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exif import exif_info
from .functions.extract import extract_text, markup_text
from .functions.files import KIND_EXTENSIONS, folder_words, format_size, format_time, is_runnable, type_label, wanted_extensions
from .functions.text import edit_distance, split_words, trigrams
from .operators import apps, association, feedback, geo, snapshot, spelling
from .operators.filters import FileFilter, existing_folders, nearby, needs_extraction, newest, skipped, top_roots
from .operators.index import corpus_stats, postings, vocabulary, vocabulary_trigrams
from .operators.ranking import Phrase, bm25, group_phrases, matches, top
from .plans.queryparse import query_columns
from .plans.search import Group, Index, score, sort_hits, suggest
from .sources.tables import corpus, corpus_docs, skipped_mounts
from .streaming import events as stream

#: 2024-02-01 00:00 UTC, after the last event of the test tables.
NOW = 1706745600.0
DAY = 86400.0
#: Misspelt words of part names.
TYPOS = ("smal", "wigdet", "galvn", "hamer", "grean", "colt", "blu")
PLACES = ((52.52, 13.405, "Berlin", "Berlin", "DE"), (48.8566, 2.3522, "Paris", "Île-de-France", "FR"), (-1.2864, 36.8172, "Nairobi", "Nairobi County", "KE"), (69.65, 18.96, "Tromsø", "Troms", "NO"), (52.39, 13.06, "Potsdam", "Brandenburg", "DE"), (-16.8, 179.99, "Labasa", "Northern", "FJ"))
COUNTRIES = (("DE", "Germany"), ("FR", "France"), ("KE", "Kenya"), ("NO", "Norway"))
MOUNTS = (
    "22 1 8:1 / / rw,relatime shared:1 - ext4 /dev/sda1 rw", "23 22 0:21 / /proc rw - proc proc rw", "24 22 0:22 / /sys rw - sysfs sysfs rw",
    "25 22 0:5 / /dev rw - devtmpfs udev rw", "26 22 0:23 / /run rw - tmpfs tmpfs rw", "27 22 7:0 / /snap/core/1 ro - squashfs /dev/loop0 ro",
    "28 22 0:40 / /mnt/my\\040nas rw - nfs4 server:/x rw", "29 22 8:17 / /media/dev/USB\\040STICK rw - vfat /dev/sdb1 rw", "30 22 0:50 / /home/dev/remote rw - fuse.sshfs host: rw", "broken line",
)
APPS = (("a.desktop", "Basic Notes", ["text/plain"], 0), ("b.desktop", "Fancy Editor", ["text/markdown", "text/plain"], 1), ("c.desktop", "Writer", ["text/plain"], 1), ("d.desktop", "Viewer", ["image/png"], 0), ("a.desktop", "Shadowed", ["text/markdown"], 1))
REQUESTS = ("large videos", "PDF I downloaded last month", "photos from Berlin", "backup over 2 GB", "PDFs in Downloads", "tax 2025", "notes under 500kb this week", "small images yesterday", "in the last week", "songs past 3 days")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(_table(spark, sf_dir, "documents"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_docs(_files(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str, phrases: list[Phrase], n_groups: int | None, limit: int = 100) -> DataFrame:
    docs = _docs(spark, sf_dir)
    scored = bm25(matches(postings(docs), phrases), corpus_stats(docs), n_groups=n_groups)
    best = top(scored.select("id", F.round("raw", 6).alias("raw")), limit)
    return best.join(_files(spark, sf_dir).select("id", "path"), "id").select("id", "path", "raw")


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frequent words and a rarer one, any of them."""
    return _ranked(spark, sf_dir, [Phrase(0, "the"), Phrase(1, "was"), Phrase(2, "eringble")], None, 20)


def bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, group_phrases([["that"], ["from"]]), 2)


def bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, group_phrases([["src3", "src4"], ["une"]]), None)


def bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, [Phrase(0, "einsch", True), Phrase(1, "src1", True)], None)


def split_words_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their number and that of their documents."""
    per = _table(spark, sf_dir, "documents").select("doc_id", F.explode(split_words(F.col("text"))).alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def ext_kind_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return f.select("id", "ext", "kind", type_label(F.col("kind"), F.col("ext")).alias("label"), format_size(F.col("size"), F.col("kind")).alias("size_text"), format_time(F.col("mtime")).alias("time_text"), F.array_join(split_words(folder_words(F.col("folder"), "/corpus/src1")), " ").alias("folder_words"))


def filter_kind_size_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = FileFilter(kinds=("image", "pdf"), min_size=500, max_size=5000, after=1704067200 + 20 * 3600, before=1704067200 + 900 * 3600)
    return where.apply(_files(spark, sf_dir)).select("id", "kind", "size", F.coalesce("taken", "mtime").alias("dated"))


def filter_folder_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FileFilter(folders=("FR", "src3")).apply(_files(spark, sf_dir)).select("id", "folder")


def scope_path_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FileFilter(scope=("/corpus/src1/", "/corpus/src2/de")).apply(_files(spark, sf_dir)).select("id", "path")


def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(FileFilter(kinds=("image", "document")).apply(_files(spark, sf_dir)), 50).select("id", F.coalesce("taken", "mtime").alias("dated"))


def nearby_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    own = files.where("id = 9").select("path").first()
    return nearby(files, own["path"] if own else "/", 200).select("id", "path", "mtime")


def existing_folder_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = _files(spark, sf_dir).select(F.col("folder").alias("path")).distinct().select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.lit(True).alias("is_dir"))
    return existing_folders(spark.createDataFrame([("DE",), ("fr",), ("src1",), ("downloads",)], "word string"), folders)


def scan_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).select("id", "path", F.when(F.col("id") % 7 == 0, F.concat(F.lit("."), F.col("name"))).otherwise(F.col("name")).alias("name"), (F.col("id") % 11 == 0).alias("is_dir"))
    return f.where(~skipped(F.col("path"), F.col("name"), F.col("is_dir"), exclude_names=("venv",), exclude=("/corpus/src2", "/corpus/src3/de"))).select("id", "name")


def to_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).withColumn("content_mtime", F.when(F.col("id") % 3 == 0, F.col("mtime")).otherwise(0.0))
    return f.where(needs_extraction(["txt", "md", "csv"], ["/corpus/src1", "/corpus/src5"])).select("id", "ext")


def root_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    paths = f.select(F.col("folder").alias("path")).union(f.where("id % 10 < 3").select(F.regexp_replace("folder", "/[a-z]*$", "")))
    return top_roots(paths)


def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(_docs(spark, sf_dir))


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(F.explode(split_words(F.col("p_name"))).alias("word"), F.lit(1).alias("src")).distinct().union(p.select(F.explode(split_words(F.col("p_type"))), F.lit(0)).distinct()).groupBy("word").agg(F.max("src").alias("src"))


def vocab_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_trigrams(_part_words(spark, sf_dir))


def trigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(trigrams(F.col("p_name"))), "|").alias("grams"))


def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    typos = spark.createDataFrame([(t,) for t in TYPOS], "term string")
    words = _part_words(spark, sf_dir).select("word")
    # lengths that may differ by three: an equi join on the length
    typos = typos.select("term", F.explode(F.sequence(F.greatest(F.length("term") - 3, F.lit(1)), F.length("term") + 3)).alias("size"))
    return words.join(F.broadcast(typos), F.length("word") == F.col("size")).select("term", "word", edit_distance(F.col("term"), F.col("word")).alias("distance"))


def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    typos = spark.createDataFrame([(t,) for t in TYPOS], "term string")
    return spelling.fuzzy_words(typos, _part_words(spark, sf_dir))


def related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.related_words(_docs(spark, sf_dir)).select("word", "other", F.round("score", 6).alias("score"))


def best_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    related = association.related_words(_docs(spark, sf_dir))
    return association.best_related(related.select(F.col("word").alias("term")), related).select("term", "other", F.round("score", 6).alias("score"), "place")


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(F.get_json_object("props", "$.k").alias("term"), F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").cast("double").alias("ts"))


def click_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.click_weights(_clicks(spark, sf_dir), NOW, [str(k) for k in range(20)]).select("path", F.round("weight", 6).alias("weight"))


def click_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.term_click_weights(_clicks(spark, sf_dir), NOW).select("term", "path", F.round("weight", 6).alias("weight"))


def click_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    renames = spark.createDataFrame([("1", "2", NOW - 10 * DAY), ("3", "new", NOW - 5 * DAY)], "old_path string, new_path string, ts double")
    moved = feedback.renamed_clicks(_clicks(spark, sf_dir), renames).where("path in ('1', '2', '3', 'new')")
    return feedback.term_click_weights(moved, NOW).select("term", "path", F.round("weight", 6).alias("weight"))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.array_join(F.slice(split_words(F.col("text")), 1, 1), " ").alias("query"), (F.col("conv_id") * 100 + F.col("turn")).cast("double").alias("ts")).where("query <> ''")


def history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.past_searches(_searches(spark, sf_dir), "th", 4)


def suggest_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.completions(vocabulary(_docs(spark, sf_dir)), "ein", 5)


def parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and dates of texts made from part names."""
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" over "), "p_size", F.lit(" MB last month in Downloads")).alias("text"))
    q = p.withColumn("q", query_columns(F.col("text"), F.timestamp_seconds(F.lit(NOW))))
    return q.select("p_partkey", "q.min_size", "q.max_size", "q.after", "q.before", F.array_join("q.folder_words", " ").alias("folder_words"), F.array_join("q.terms", " ").alias("terms"))


def parse_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(REQUESTS)], "id long, text string")
    said = _table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    q = said.union(made).withColumn("q", query_columns(F.col("text"), F.timestamp_seconds(F.lit(NOW))))
    return q.select("id", "q.min_size", "q.max_size", "q.after", "q.before", F.array_join("q.folder_words", " ").alias("folder_words"), F.array_join("q.kinds", " ").alias("kinds"), F.array_join("q.terms", " ").alias("terms"))


def search_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words, all of them: ranked, explained and boosted as a search does."""
    files, docs = _files(spark, sf_dir), _docs(spark, sf_dir)
    clicks = _clicks(spark, sf_dir).select(F.lit("src3").alias("term"), F.concat(F.lit("/corpus/src3/en/src3_en_"), "path", F.lit(".txt")).alias("path"), "ts")
    groups = [Group("src3", True), Group("en", True)]
    found = matches(postings(docs), group_phrases([g.words for g in groups]))
    rows = bm25(found, corpus_stats(docs), n_groups=2).join(files, "id")
    texts = docs.select("id", split_words(F.col("name")).alias("name_words"), F.array_distinct(split_words(F.col("folder"))).alias("folder_words"), F.array_distinct(split_words(F.col("extra"))).alias("extra_words"))
    best = score(rows.join(texts, "id"), groups, clicks, NOW, "/corpus/src3/en", True)
    return best.select("id", "path", "label", F.round("score", 6).alias("score"), "reason")


def search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with typo and second pass; results by the driver's plan."""
    from .plans.search import search

    files = _files(spark, sf_dir)
    index = Index.build(files, corpus_docs(files)).persist()
    return search(index, "src3 einschh in DE", NOW, home="/corpus/src3").hits


def _stored_and_scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = _files(spark, sf_dir).select("path", "size", "mtime", "id")
    scanned = f.where("id % 10 <> 3").select("path", F.when(F.col("id") % 10 == 5, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("id") % 10 == 7, F.col("mtime") + 1e-7).otherwise(F.col("mtime")).alias("mtime"))
    return f.where("id % 10 <> 4").select("path", "size", "mtime"), scanned


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.snapshot_diff(*_stored_and_scanned(spark, sf_dir))


def snapshot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, scanned = _stored_and_scanned(spark, sf_dir)
    return snapshot.apply_scan(stored.withColumn("content_mtime", F.col("mtime")), scanned, ["/corpus/src1"])


def delete_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.delete_subtrees(_files(spark, sf_dir), ["/corpus/src1", "/corpus/src2/en"]).select("id", "path")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of rows by user: errors delete."""
    changes = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.round("value", 6).alias("value"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"))
    stored = spark.range(0, 400).select(F.col("id").cast("string").alias("path"), F.lit(0.0).alias("value"))
    return snapshot.upsert_latest(stored, changes)


def event_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "deleted").otherwise("changed").alias("kind"), F.col("user_id").cast("string").alias("path"), F.lit(None).cast("string").alias("path2"), F.col("event_id").alias("seq"))
    return stream.batch_state(e)


def stream_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "conversations").where("role = 'user'").select(F.lit("click").alias("kind"), F.col("conv_id").cast("string").alias("path"), F.col("text").alias("query"), F.col("turn").cast("double").alias("ts"))
    return stream.clicks(e).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("first"))


def event_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of files below twenty folders; an error deletes the folder with all below it."""
    folder = F.concat(F.lit("/f"), (F.col("user_id") % 20).cast("string"))
    failed = F.col("event_type") == "error"
    path = F.when(failed, folder).otherwise(F.concat(folder, F.lit("/g/u"), F.col("user_id").cast("string")))
    e = _table(spark, sf_dir, "events").select(F.when(failed, "deleted").otherwise("changed").alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("path2"), F.col("event_id").alias("seq"))
    return stream.batch_state(e)


def event_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of which every third came twice."""
    c = _table(spark, sf_dir, "conversations").where("role = 'user'")
    e = c.select(F.lit("click").alias("kind"), F.col("conv_id").cast("string").alias("path"), F.lit(None).cast("string").alias("path2"), F.col("text").alias("query"), F.col("turn").cast("double").alias("ts"), F.col("conv_id").alias("seq"))
    return stream.distinct_events(e.union(e.where("seq % 3 = 0"))).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("total"))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is offered while "th" is typed: past searches, then completions."""
    index = Index(*[None] * 4, vocabulary(_docs(spark, sf_dir)), *[None] * 3, _searches(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(suggest(index, "th"))), "place int, text string")


def sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty files by name, backwards."""
    return sort_hits(_files(spark, sf_dir), "name", True).limit(50).select("id", "name")


def runnable_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = [e for names in KIND_EXTENSIONS.values() for e in names.split()] + ["desktop", "appimage", "deb", "", "exe"]
    return spark.createDataFrame([(e,) for e in exts], "ext string").select("ext", is_runnable(F.col("ext")).alias("runs"), F.col("ext").isin(wanted_extensions()).alias("wanted"))


def app_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(APPS, "id string, name string, mime_types array<string>, dir_rank int")
    return apps.named_like(apps.offered_apps(entries), " Edit ").select("id", "name")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: daily counts by event-time windows."""
    out = stream.windowed_counts(_table(spark, sf_dir, "events"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return e.select("id", (F.col("id") % 1800 / 10.0 - 90).alias("lat"), (F.col("id") * 7 % 3600 / 10.0 - 180).alias("lon"))


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _photos(spark, sf_dir).union(spark.createDataFrame([(-1 - k, p[0] + dy, p[1] + dx) for k, (p, dy, dx) in enumerate((p, dy, dx) for p in PLACES for dy in (-0.3, 0.0, 0.2) for dx in (-0.9, 0.0, 0.4) if p[1] + dx <= 180)], "id long, lat double, lon double"))
    places = spark.createDataFrame(PLACES, "lat double, lon double, city string, state string, code string")
    found = geo.place_words(geo.nearest_place(near, places).where("city is not null"), spark.createDataFrame(COUNTRIES, "code string, name string"))
    return found.select("id", "city", "country", F.round("km", 4).alias("km"), F.array_join(F.array_sort("words"), " ").alias("words"))


def photo_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).where("kind = 'image'")
    return f.select("id", F.array_join(geo.photo_words(F.col("taken"), F.array(F.lit("berlin"))), " ").alias("words"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", markup_text(F.col("html")).alias("text"))


def mounts_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipped_mounts(spark.createDataFrame([(m,) for m in MOUNTS], "value string"))


def mime_app_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(APPS, "id string, name string, mime_types array<string>, dir_rank int")
    return apps.apps_for_mime(apps.offered_apps(entries), ["text/markdown", "text/plain"])


def _photo_bytes(taken: bytes, lat: float, lon: float) -> bytes:
    """A little-endian TIFF with a date and a position."""
    parts = lambda v: struct.pack("<6I", int(abs(v)), 1, int(abs(v) * 60) % 60, 1, 0, 1)
    head = struct.pack("<2sHI", b"II", 42, 8)
    root = struct.pack("<HHHIIHHIII", 2, 0x8769, 4, 1, 38, 0x8825, 4, 1, 56, 0)
    exif = struct.pack("<HHHIII", 1, 0x9003, 2, 20, 110, 0)
    gps = struct.pack("<HHHI4sHHIIHHI4sHHIII", 4, 1, 2, 2, b"S\0\0\0" if lat < 0 else b"N\0\0\0", 2, 5, 3, 130, 3, 2, 2, b"W\0\0\0" if lon < 0 else b"E\0\0\0", 4, 5, 3, 154, 0)
    return (head + root + exif + gps + taken + b"\0").ljust(130, b"\0") + parts(lat) + parts(lon)


def exif_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [(1, _photo_bytes(b"2024:07:13 14:22:05", 52.5, 13.4)), (2, _photo_bytes(b"2023:12:24 10:00:00", -1.25, -36.75)), (3, b"\xff\xd8\xff\xe1broken"), (4, None)]
    return spark.createDataFrame(made, "id long, content binary").select("id", exif_info(F.col("content")).alias("x")).select("id", "x.*")


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w:p>kubernetes</w:p><w:p>migration &amp; roadmap</w:p>")
    rtf, rough = rb"{\rtf1\ansi Hello \b bold\b0  w\'f6rld}", b"\0\1Quarterly report draft\0\0" + "wide letters here".encode("utf-16-le")
    made = [(1, "docx", held.getvalue()), (2, "rtf", rtf), (3, "txt", b"plain text"), (4, "txt", b"bin\0ary"), (5, "docx", b"PK broken"), (6, "doc", rough), (7, None, None)]
    df = spark.createDataFrame(made, "id long, ext string, content binary")
    return df.select("id", extract_text(F.col("ext"), F.col("content"), F.length("content").cast("long")).alias("text"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    bm25_top, bm25_and, bm25_or, bm25_prefix, split_words_docs, ext_kind_label, filter_kind_size_date, filter_folder_segment, scope_path_range, newest_files,
    nearby_files, existing_folder_words, scan_skips, to_extract, root_folders, vocab_build, vocab_trigrams, trigram_pieces, edit_distances, fuzzy_candidates,
    related_pairs, best_related, click_decay, click_memory, click_rename, history_top, suggest_completions, parse_requests, parse_conversations, search_scored,
    search_full, snapshot_diff, snapshot_apply, delete_subtree, upsert_latest, event_latest, event_subtrees, event_distinct, stream_clicks, event_windows, nearest_place, photo_words,
    html_clean, mounts_skip, mime_app_rank, app_names, runnable_kinds, sorted_names, suggestions, exif_photos, file_texts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}
