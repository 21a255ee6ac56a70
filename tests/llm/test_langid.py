import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import registry
from lodestar.llm.langid import UNKNOWN, fit_languages, predict_languages, subwords, train_languages

ENGLISH, GERMAN = "the house is on the hill and the dog was there", "das haus ist auf dem berg und der hund war dort"


def small():
    return train_languages([ENGLISH, GERMAN] * 20, ["en", "de"] * 20, buckets=1 << 12)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in registry.op5_language(spark, sf).collect()}
    langs = duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall()
    held = [(i, lang) for i, lang in langs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out for i, _ in held) and len(out) == len(langs)
    assert sum(out[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)


def test_odd_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ² !!", "x"), (4, "the", "x"), (4, "the", "x"), (5, "und der " * 50_000, "x"), (6, "日本語", "x")]
    out = predict_languages(spark.createDataFrame(rows, "doc_id long, text string, score string"), small()).collect()
    got = {r.doc_id: r for r in out}
    assert [got[k].lang_pred for k in (1, 2, 3)] == [UNKNOWN] * 3 and got[1].score == 0.0 and got[1].rejected
    assert got[4].lang_pred == "en" and got[5].lang_pred == "de" and got[6].lang_pred in ("en", "de") and len(out) == 7


def test_whole_texts_count(spark):
    text = "the dog was there " * 10 + "und der hund war dort und das haus ist auf dem berg " * 2000
    assert predict_languages(spark.createDataFrame([(text,)], "text string"), small()).first().lang_pred == "de"


def test_no_languages_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = fit_languages(empty)
    assert predict_languages(empty, model).count() == 0
    assert predict_languages(spark.createDataFrame([("the",)], "text string"), model).first().lang_pred == UNKNOWN


def test_nulls_teach_nothing_and_runs_agree(spark):
    rows = [(k, t, lang) for k in range(30) for t, lang in ((ENGLISH, "en"), (GERMAN, "de"), (ENGLISH, None), (None, "fr"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = fit_languages(docs), fit_languages(docs.repartition(3))
    assert a.languages == ["de", "en"] and np.array_equal(a.table, b.table)
    assert fit_languages(docs, only=F.lit(False)).languages == []


def test_rejection_is_calibrated():
    model = small()
    assert 0 <= model.reject_below <= 1 and model.temperature > 0


def test_subwords():
    size = lambda t: len(subwords(t, 1 << 20)[0])
    assert size("12!") == 0 and size("") == 0 and size("ab") == 1 + 3 + 2 and size("a1b") == 2 * (1 + 2 + 1)
    same = lambda a, b: sorted(subwords(a, 1 << 20)[0]) == sorted(subwords(b, 1 << 20)[0])
    assert same("the cat", "cat, the!") and not same("the cat", "the act")


def plain_subwords(text):
    """Runs of letters, and pieces of two and three signs around them, one by one."""
    from collections import Counter

    out, marked = Counter(), f" {text} "
    letters = [c.isalpha() for c in marked]
    clean = "".join(c if ok else " " for c, ok in zip(marked, letters, strict=True))
    for k in range(len(marked) - 1):
        if letters[k] or letters[k + 1]:
            out[clean[k : k + 2]] += 1
        if letters[k]:
            out["3" + clean[k - 1 : k + 2]] += 1
    return out + Counter(f"word {w}" for w in clean.split())


def test_subwords_are_those_of_brute_force():
    texts = ["", "the cat", "a1b the the cat, the", "\u00e9t\u00e9 x", "averyveryverylongword that goes on 12", "ab" * 40, "a b c d e"]
    for text in texts:
        want, (ids, places) = plain_subwords(text), subwords(text, 1 << 40)
        assert sorted(np.unique(ids, return_counts=True)[1].tolist()) == sorted(want.values()) and len(ids) == sum(want.values())
        assert all(text[p - 1].isalpha() for p in places.tolist())


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 16])
def test_parts_change_nothing(monkeypatch, chunk):
    texts = ["some words of a text and averyveryverylongwordthatiscutanywhere end", "x", "", "12 34", "\u65e5\u672c\u8a9e " * 5, "ab" * 30]
    whole = [[np.sort(a) for a in subwords(t, 1 << 20)] for t in texts]
    monkeypatch.setattr("lodestar.llm.langid._CHUNK", chunk)
    for t, w in zip(texts, whole, strict=True):
        assert all(np.array_equal(np.sort(a), b) for a, b in zip(subwords(t, 1 << 20), w, strict=True))


def test_a_text_beyond_one_part_scores_as_a_whole(spark):
    """Without any space: the parts must not make two words of one."""
    df = spark.createDataFrame([("derhund" * 80_000,), ("und der " * 70_000,)], "text string")
    cut = [(r.lang_pred, r.score) for r in predict_languages(df.coalesce(1), small()).collect()]
    model = small()
    for (lang, score), (text,) in zip(cut, df.collect(), strict=True):
        ids = subwords(text, model.table.shape[0])[0]
        z = model.scores(model.table[ids].astype(float).mean(axis=0)) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert lang == model.languages[int(p.argmax())] and abs(p.max() - score) < 1e-6


def test_training_does_not_depend_on_the_hash_seed():
    import os
    import subprocess
    import sys

    code = "import zlib; from lodestar.llm.langid import train_languages as t; m = t(['the house\\nis on the hill\\nand'] * 30 + ['das haus\\nist auf dem\\nberg'] * 30, ['en'] * 30 + ['de'] * 30, buckets=1 << 12); print(zlib.crc32(m.table.tobytes()), m.temperature, m.reject_below)"
    seen = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": str(k)}, capture_output=True, text=True, check=True, timeout=120).stdout for k in (1, 2, 3)}
    assert len(seen) == 1


def test_learning_texts_are_bounded_and_no_language_is_lost(spark):
    rows = [(k, f"kurz {k}", "de") for k in range(30)] + [(100 + k, "long " * 50 + str(k), "en") for k in range(30)] + [(7, "kurz 7", "de")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit_languages(docs, most_chars=100).languages == ["de", "en"]


def test_many_languages_use_embeddings(spark):
    texts = [f"{chr(97 + k) * 3} {chr(98 + k) * 4} word" for k in range(20)]
    model = train_languages(texts * 15, [f"l{k:02}" for k in range(20)] * 15, buckets=1 << 12)
    assert model.out is not None
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    assert sum(r.lang_pred == f"l{r.k:02}" for r in predict_languages(df, model).collect()) >= 14


def test_neighbours_do_not_matter(spark):
    """A text's answer is the same alone and among others."""
    model, texts = small(), ["the dog", None, "12", "und der hund", "", "x", "das haus " * 300, "7", "hill"]
    together = [(r.lang_pred, r.score) for r in predict_languages(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1), model).orderBy("k").collect()]
    alone = [(r.lang_pred, r.score) for t in texts for r in predict_languages(spark.createDataFrame([(t,)], "text string"), model).collect()]
    assert [a[0] for a in together] == [a[0] for a in alone] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(together, alone, strict=True))


def test_every_language_is_learnt(spark):
    from lodestar.llm.langid import fit_languages

    name = lambda k: "".join(chr(97 + int(d)) * 3 for d in f"{k:03}")
    rows = [(k * 10 + n, f"{name(k)} q{name(k)} {name(k)}z", f"l{k:03}") for k in range(250) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs)
    answers = {r.lang_pred for r in predict_languages(docs, model).collect()}
    assert len(model.languages) == 250 and len(answers) == 250
