import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm.urls import build_cascade, filter_urls, hashed, in_cascade, mark_listed

CASES = {
    "http://Example.ORG/es/x?q": ("example.org", "/es/x", "example.org/es/", "block"),
    "https://www.example.org/en/12#t": ("www.example.org", "/en/12", "example.org/en/1", "block"),
    "https://www.example.org/en/2": ("www.example.org", "/en/2", "org/", "allow"),
    "x://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
    "x://a.com/fr/y": ("a.com", "/fr/y", "com/fr/", "allow"),
    "x://a.com/": ("a.com", "/", None, "allow"),
    "x://notexample.org": ("notexample.org", "", None, "allow"),
    "x://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
    "x://acom/fr/": ("acom", "/fr/", None, "allow"),
    "no scheme.org/": ("", "", None, "allow"),
    "a://b?c://d": ("b", "", None, "allow"),
    "x://m.net/a\nb": ("m.net", "/a\nb", None, "block"),
    "x://ÄB.NET/": ("Äb.net", "/", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_hosts_paths_rules_and_verdicts(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(CASES)] * 2, "page_id long, url string, host string")
    listed = spark.createDataFrame([("m.net",), ("m.net",), (None,), ("m.nowhere",), ("a.com.",)], "host string")
    out = filter_urls(df, listed).collect()
    assert len(out) == 2 * len(CASES)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.url]
    assert filter_urls(df.limit(0), listed).count() == 0 and filter_urls(df, listed.limit(0)).where("host = 'm.net' and verdict = 'block'").count() == 0


def test_cascades_are_exact():
    keys = hashed(f"key{k}" for k in range(20_000))
    for share in (0, 1, 137, 10_000, 20_000):
        levels = build_cascade(keys[:share], keys[share:])
        assert np.array_equal(in_cascade(levels, keys), np.arange(20_000) < share)


@pytest.mark.parametrize("shard, most", [(500_000, 64 << 20), (7, 64 << 20), (7, 0)])
def test_membership_is_exact_by_each_way(spark, monkeypatch, shard, most):
    monkeypatch.setattr("lodestar.llm.urls.SHARD_KEYS", shard)
    monkeypatch.setattr("lodestar.llm.urls.BROADCAST_BYTES", most)
    universe = spark.range(100).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    rows = spark.range(300).select("id", F.when(F.col("id") < 290, F.concat(F.lit("h"), F.col("id") % 100)).alias("k"))
    for r in mark_listed(rows, "k", universe).collect():
        assert r.listed == (r.k is not None and int(r.k[1:]) % 3 == 0)


def test_conflicting_keys_end_and_count_as_listed(spark):
    for inside, outside in (([1, 2], [2, 3]), ([5], [5]), ([], [1]), ([], []), (list(range(500)), list(range(250, 900)))):
        a, b = np.array(inside, np.uint64), np.array(outside, np.uint64)
        both = np.union1d(a, b)
        assert np.array_equal(in_cascade(build_cascade(a, b), both), np.isin(both, a))
    universe = spark.createDataFrame([("x", True), ("x", False), ("y", False), ("y", None), (None, True)], "key string, listed boolean")
    assert {r.key: r.listed for r in mark_listed(universe.select("key").distinct(), "key", universe).collect()} == {"x": True, "y": False, None: False}


def test_shared_hashes_take_another_seed(spark, monkeypatch):
    """With 4-bit hashes, listed and other keys collide under most seeds."""
    from lodestar.llm import urls

    monkeypatch.setattr(urls, "hashed", lambda keys, seed=0: hashed(keys, seed) & np.uint64(15))
    universe = spark.createDataFrame([(f"k{n}", n < 2) for n in range(5)], "key string, listed boolean")
    assert {r.key for r in mark_listed(universe.select("key"), "key", universe).collect() if r.listed} == {"k0", "k1"}
