import zlib

import duckdb
from pyspark.sql import functions as F

from lodestar.llm import registry
from lodestar.llm.toxicity import Lexicon, density, drop_toxic, fit_toxicity, fold, learn_lexicon, score_toxicity


def test_folding():
    assert fold("You 1d10t, $tupid m0r0n! іdiot ＩＤＩＯＴ") == " you idiot stupid moron idiot idiot "
    assert fold("words*** and$$$ an!! 2024 a1") .split()[:3] == ["words", "and", "an"]
    assert fold("l053r 𝐢𝐝𝐢𝐨𝐭 ⓘdiot id\u200biot b!d hello!!world") == " loser idiot idiot idiot bid hello world "
    assert fold("") == "  " and fold("!!! 12") == "  "


def test_exceptions_and_boundaries():
    lexicon = Lexicon(weights={" trash ": 2.0, " idio": 3.0}, exceptions=("trash can",))
    m = lexicon.automaton()
    assert density(m, fold("a trash can"))[1] == 0 and density(m, fold("a trash"))[1] == 1
    assert density(m, fold("idiotic stuff"))[1] == 1 and density(m, fold("xidiot"))[1] == 0
    assert density(m, fold("trash can trash"))[1] == 1
    assert density(m, fold("trash " + "word " * 500))[0] < density(m, fold("trash word"))[0]


def test_learns_words_and_stems_not_copies():
    clean = [f"the day was fine number{k} and good" for k in range(200)]
    toxic = [f"you are {chr(97 + k % 26)}{chr(97 + k % 7)} grumble{x} here" for k, x in enumerate(["s", "d", "r", "n", "st"] * 8)]
    toxic += ["copied passage with uniqueword inside"] * 40  # one context, however often
    lexicon = learn_lexicon(clean + toxic, [0] * 200 + [1] * 80)
    assert any(p.startswith(" grum") for p in lexicon.weights) and " uniqueword " not in lexicon.weights
    m = lexicon.automaton()
    assert density(m, fold("the day was fine"))[0] == 0


def test_without_labels_the_seed_stays(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = fit_toxicity(docs, labels)
    out = {r.doc_id: r.predicted for r in score_toxicity(docs, lexicon).collect()}
    assert out == {1: 1, 2: 0}


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "stupid idiot moron", "c"), (3, "stupid idiot moron", "c"), (4, "x " * 60_000, "d"), (None, "fine", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = score_toxicity(docs, Lexicon()).collect()
    assert len(out) == 6 and all(isinstance(r.score, float) and 0 <= r.score <= 1 for r in out)
    assert sum(r.predicted for r in out) == 2
    kept = drop_toxic(docs, Lexicon())
    assert kept.columns == docs.columns and kept.count() == 4 and {r.score for r in kept.collect()} == {"a", "b", "d", "e"}
    assert score_toxicity(docs.limit(0), Lexicon()).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in registry.op2_toxicity(spark, sf).collect()}
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i, _ in held)
    assert sum(out[i].predicted == y for i, y in held) >= 0.98 * len(held)
    assert sum(out[i].predicted for i, y in held if not y) <= 0.005 * len(held)


def test_labels_are_not_read_from_held_out_rows(spark):
    docs = spark.createDataFrame([(k, f"t{k} zzgloop q{k} filler text") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert " zzgloop " not in fit_toxicity(docs, labels, only=F.lit(False)).weights


def test_scores_are_those_of_brute_force(spark):
    """Every place of every pattern looked up one by one; hits inside an exception don't count; weight per word."""
    import math
    import random

    lexicon = Lexicon(weights={" idiot ": 4.0, " trash ": 2.0, " stup": 3.0, " stupid ": 1.0}, exceptions=("trash can", "stupid simple"), slope=30.0, offset=-1.5)
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["idiot", "Trash", "can", "stupid", "simple", "stup1dly", "1d10t", "fine", "day,", "x"], k=rng.randint(0, 30))) for _ in range(300)]

    def brute(text):
        t = fold(text)
        free = [(k, k + len(p) + 2) for p in lexicon.exceptions for k in range(len(t)) if t.startswith(f" {p} ", k)]
        total = sum(w for p, w in lexicon.weights.items() for k in range(len(t)) if t.startswith(p, k) and not any(a <= k and k + len(p) <= b for a, b in free))
        return 1 / (1 + math.exp(-(lexicon.slope * total / (50 + len(t.split())) + lexicon.offset)))

    got = {r.k: r.score for r in score_toxicity(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), lexicon).collect()}
    assert all(abs(got[k] - brute(t)) < 1e-9 for k, t in enumerate(texts)) and len({round(s, 6) for s in got.values()}) > 50
