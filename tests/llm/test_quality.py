import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm.quality import RULES, Rule, measures, order_rules, quality_verdicts

LONG = "word%d " * 12 % tuple(range(12))
TEXTS = [None, "", " \t\n", "one", LONG, LONG * 2, "a b c d e " * 30, "\u00a0x\u2003y z", "é " * 11, "x\ny\nx\n\n \nx\r\ny", "a # b $ % & | < > *", "l\n" * 3000 + LONG, "q " * 20_000]


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, kept string")


def test_measures_are_those_of_brute_force(docs):
    for r in measures(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_order_changes_no_verdict(docs):
    a, b = quality_verdicts(docs), quality_verdicts(docs, tuple(reversed(RULES)))
    pick = lambda df: sorted((r.doc_id, r.kept) for r in df.collect())
    assert pick(a) == pick(b) and a.count() == len(TEXTS)
    assert all(r.failed_rule == "base" and not r.kept for r in a.where("base_failed").collect())


def test_rules_that_reject_come_before_those_that_do_not(docs):
    rules = (Rule("never", lambda m, t: F.lit(False)), Rule("often", lambda m, t: m["n_words"] < 1000))
    assert [r.rule.name for r in order_rules(measures(docs), rules)] == ["often", "never"]


def test_clean_text_is_kept_and_junk_is_not(spark):
    clean = "This is an ordinary piece of prose, with a sentence or two. It says nothing special; it only reads well."
    junk = " ".join(f"w{chr(97 + k)}rd###" for k in range(26))
    out = {r.doc_id: r.kept for r in quality_verdicts(spark.createDataFrame([(1, clean), (1, clean), (2, junk)], "doc_id long, text string")).collect()}
    assert out == {1: True, 2: False}


def test_empty_table(docs):
    assert quality_verdicts(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(docs, capsys):
    quality_verdicts(docs).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_the_order_is_that_of_brute_force_and_stays(docs):
    """Share rejected over mean work, both counted by hand over all rows (the sample holds them all)."""
    rules = (Rule("long", lambda m, t: F.length(t) > 100, lambda m, t: F.length(t) * 1.0), Rule("few", lambda m, t: m["n_words"] < 10), Rule("no", lambda m, t: F.lit(False), lambda m, t: F.lit(5.0)), Rule("none", lambda m, t: F.lit(False)))
    size = [len(t or "") for t in TEXTS]
    want = {"long": sum(s > 100 for s in size) / len(size) / (sum(size) / len(size)), "few": sum(brute(t)[0] < 10 for t in TEXTS) / len(size), "no": 0, "none": 0}
    found = [order_rules(measures(docs.repartition(k)), rules) for k in (1, 3, 5)]
    assert all([r.rule.name for r in f] == ["few", "long", "none", "no"] for f in found)
    assert all(abs(r.rejected / max(r.cost, 1e-6) - want[r.rule.name]) < 1e-9 for f in found for r in f)
    names = {tuple(r.rule.name for r in order_rules(measures(docs.repartition(k)))) for k in (1, 3, 5)}
    assert len(names) == 1
