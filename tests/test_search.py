import math
import sqlite3

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestar.functions.files import kind_of, split_ext
from lodestar.operators import association, feedback, spelling
from lodestar.operators.index import corpus_stats, postings
from lodestar.operators.ranking import bm25, group_phrases, matches
from lodestar.plans.search import Index, clicks_of, files_near, search, suggest

NOW, DAY = 1_780_000_000.0, 86400.0
HOME = "/home/dev"


@pytest.fixture(scope="module")
def home(spark):
    made = [("Documents/Invoice_Acme_2025.pdf", "", 0), ("Documents/invoice_old.txt", "payment due for the invoice", 0), ("Downloads/report_final.pdf", "", 2), ("Downloads/notes.txt", "meeting about the budget and the roadmap", 0)]
    made += [(f"Pictures/{p}.jpg", "", 1) for p in ("Berlin Trip/IMG_001", "Berlin Trip/IMG_002", "Paris/IMG_003")]
    made += [(f"Taxes/tax_return_{y}.pdf", "", 3) for y in range(2018, 2024)]
    made += [(f"Misc/holiday_photo_{i}_beach.jpg" if i % 2 else f"Misc/recipe_{i}_pasta.txt", "", 5) for i in range(60)]
    folders = [(p, "", 0) for p in ("Documents", "Downloads", "Pictures", "Taxes", "Misc")]
    table = [(k, f"{HOME}/{p}", t, NOW - age * DAY, len(p) * 100, p in dict((f[0], 1) for f in folders)) for k, (p, t, age) in enumerate(made + folders)]
    df = spark.createDataFrame(table, "id long, path string, content string, mtime double, size long, is_dir boolean")
    df = df.withColumns({"name": F.regexp_extract("path", "[^/]*$", 0), "folder": F.regexp_replace("path", "/[^/]*$", "")})
    df = df.withColumn("ext", F.when(F.col("is_dir"), "").otherwise(split_ext(F.col("name"))))
    df = df.withColumns({"kind": kind_of(F.col("ext"), F.col("is_dir")), "taken": F.lit(None).cast("double")})
    return df.cache()


@pytest.fixture(scope="module")
def index(home, tmp_path_factory):
    docs = home.select("id", "name", F.expr(f"substr(folder, {len(HOME) + 2})").alias("folder"), "content", F.lit("").alias("extra"))
    return Index.build(home, docs).save(str(tmp_path_factory.mktemp("index")))


def names(result):
    return [r.name for r in result.hits.collect()]


def test_exact_name_first_then_clicks_win(spark, index):
    assert names(search(index, "invoice", NOW, HOME))[0] == "Invoice_Acme_2025.pdf"
    clicks = index.clicks
    for k in range(4):
        clicks = clicks.union(clicks_of(spark, "invoice", f"{HOME}/Documents/invoice_old.txt", NOW - k)[0])
    learned = Index(**{**vars(index), "clicks": clicks})
    hits = search(learned, "invoice", NOW, HOME).hits.collect()
    assert hits[0].name == "invoice_old.txt" and "opened this before" in hits[0].reason


def test_typos_and_corrections(index):
    hits = search(index, "invoce", NOW, HOME)
    assert any("(typo)" in r.reason for r in hits.hits.collect()) and hits.did_you_mean == "invoice"
    assert search(index, "reprt", NOW, HOME).did_you_mean == "report"


def test_text_and_folder_filters(index):
    assert names(search(index, "roadmap", NOW, HOME)) == ["notes.txt"]
    assert names(search(index, "pdfs in downloads", NOW, HOME)) == ["report_final.pdf"]
    assert names(search(index, "budget", NOW, HOME, scope=[f"{HOME}/Documents"])) == []


def test_related(index):
    assert ("tax", "return") in {(r.word, r.other) for r in index.related.collect()}
    reasons = [r.reason for r in search(index, "pasta", NOW, HOME).hits.collect()]
    assert reasons and all('name has "pasta"' in r for r in reasons)


def test_nearby_and_suggestions(spark, index):
    assert names(files_near(index, f"{HOME}/Pictures/Berlin Trip/IMG_001.jpg")) == ["IMG_002.jpg"]
    log = index.searches.union(clicks_of(spark, "Invoice Acme", "/x", NOW)[1])
    assert suggest(Index(**{**vars(index), "searches": log}), "invoi") == ["invoice acme", "invoice"]
    assert suggest(index, "  ") == []


@pytest.mark.parametrize("text", ['"', "* OR", "((", "", "the of", "%", "\\", "a" * 300])
def test_hostile_searches(index, text):
    result = search(index, text, NOW, HOME)
    assert result.hits is None or result.hits.count() >= 0


def test_bm25_is_that_of_fts5(spark, home):
    docs = home.select("id", F.lower(F.regexp_replace("name", "[^A-Za-z0-9]+", " ")).alias("name"), F.lit("misc things").alias("folder"), "content", F.lit("").alias("extra"))
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table d using fts5(name, folder, content, extra)")
    for r in docs.collect():
        db.execute("insert into d(rowid, name, folder, content, extra) values (?, ?, ?, ?, ?)", (r.id + 1, r.name, r.folder, r.content, r.extra))
    groups = [["invoice", "report"], ["pdf"]]
    found = matches(postings(docs), group_phrases(groups))
    for joiner, n in (("AND", 2), ("OR", None)):
        text = f" {joiner} ".join("(" + " OR ".join([f'"{g[0]}"', f'"{g[0]}"*', *[f'"{w}"' for w in g[1:]]]) + ")" for g in groups)
        want = {r - 1: s for r, s in db.execute("select rowid, bm25(d, 10.0, 3.0, 1.0, 3.0) from d where d match ?", (text,))}
        got = {r.id: r.raw for r in bm25(found, corpus_stats(docs), n_groups=n).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_click_decay_is_the_step_by_step_one(spark):
    times = [NOW - 200 * DAY, NOW - 100 * DAY, NOW - 3 * DAY]
    weight, last = 0.0, times[0]
    for t in times:
        weight, last = weight * 0.5 ** ((t - last) / DAY / 60) + 1, t
    df = spark.createDataFrame([("t", "/p", t) for t in times], "term string, path string, ts double")
    assert math.isclose(feedback.click_weights(df, NOW).first().weight, weight * 0.5 ** (3 / 60), rel_tol=1e-12)


def test_rename_replaces_what_the_target_had(spark):
    log = spark.createDataFrame([("a", "/old", 1.0), ("a", "/new", 2.0), ("b", "/new", 2.0), ("a", "/new", 9.0)], "term string, path string, ts double")
    renames = spark.createDataFrame([("/old", "/new", 5.0)], "old_path string, new_path string, ts double")
    assert rows(feedback.renamed_clicks(log, renames)) == [("a", "/new", 1.0), ("a", "/new", 9.0), ("b", "/new", 2.0)]


def test_few_documents_teach_nothing(spark):
    docs = spark.createDataFrame([(k, "tax return", "x y", "") for k in range(19)], "id long, name string, folder string, content string")
    assert association.related_words(docs).count() == 0


def test_fuzzy_rules(spark):
    vocab = spark.createDataFrame([("invoice", 1), ("invoices", 0), ("voice", 1), ("report", 1)], "word string, src int")
    terms = spark.createDataFrame([("invoce",), ("1234",), ("abc",)], "term string")
    assert [(r.word, r.place) for r in spelling.fuzzy_words(terms, vocab).orderBy("place").collect()] == [("invoice", 1), ("invoices", 2)]


def test_sorting_hits(index):
    from lodestar.plans.search import sort_hits

    hits = search(index, "invoice", NOW, HOME).hits
    assert [r.name for r in sort_hits(hits, "name").collect()] == ["Invoice_Acme_2025.pdf", "invoice_old.txt"]
    assert [r.size for r in sort_hits(hits, "size", True).collect()] == sorted((r.size for r in hits.collect()), reverse=True)


def test_sampling(spark):
    docs = spark.range(1000)
    assert association.sampled(docs, 2000).count() == 1000 and 50 < association.sampled(docs, 100).count() < 200


def test_terms_reach_the_scan(index, capsys):
    matches(index.postings, group_phrases([["tax"]])).explain()
    plan = capsys.readouterr().out
    assert "StringStartsWith(term,tax)" in plan and "EqualTo(term,tax)" in plan
