import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing
from lodestar.llm.mixing import mix_sources, mixed_rows


def fill(sizes, weights=(3, 1, 2), budget=1.5, ceiling=2.0):
    """Targets by giving out and cutting until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left, total = budget * sum(sizes.values()) - sum(target.values()), sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > ceiling * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        target |= {s: ceiling * sizes[s] for s in over}
        open_ -= over
    return target


def made(spark, n=3000):
    rows = [(k, None if k % 97 == 0 else "w " * ((k * 7919) % 60), None if k % 50 == 0 else "hot" if k % 3 == 0 else f"s{k % 7}", "x") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_targets_and_taken_words(spark):
    docs = made(spark)
    out = mix_sources(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in out:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    want = fill(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 60
    assert all(r.source_size == sizes[r.source] for r in out) and len(out) == 3000


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = made(spark)
    a, b = (sorted((r.doc_id, r.taken) for r in mix_sources(d).collect()) for d in (docs, docs.repartition(7, "text")))
    assert a == b


def test_rounding_is_fair(spark):
    """Over seeds, each document is taken about as often as its fraction says."""
    docs = spark.createDataFrame([(k, "w " * (5 + k), "a" if k < 40 else "b") for k in range(80)], "doc_id long, text string, source string")
    n, rate = defaultdict(int), {}
    for seed in range(12):
        for r in mix_sources(docs, seed=seed).collect():
            n[r.doc_id] += r.copies
            rate[r.doc_id] = r.target / r.source_size
    for group in (range(40), range(40, 80)):
        assert sum(n[k] for k in group) / 12 / 40 == pytest.approx(rate[group[0]], abs=0.1)


def test_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    docs = made(spark, 400)
    out = mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 60 for r in out)


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    blank = mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a"), (2, "", "a")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 3
    twins = mix_sources(spark.createDataFrame([(1, "a b c", "s")] * 10 + [(None, "a b c", "t")], schema)).collect()
    assert len(twins) == 11 and sum(r.taken for r in twins) == pytest.approx(49.5, abs=3)


def test_mixed_rows_repeat_documents(spark):
    docs = made(spark, 500)
    copies = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    got = Counter(r.doc_id for r in mixed_rows(docs).collect())
    assert got == {k: c for k, c in copies.items() if c} and mixed_rows(docs).columns == docs.columns


def test_no_python_in_the_plan(spark, capsys):
    mix_sources(made(spark, 50)).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
