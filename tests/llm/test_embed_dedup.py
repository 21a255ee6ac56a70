import numpy as np
import pytest

from lodestar.llm.embed_dedup import embedding_near_duplicates, near_pairs, principal_axes

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold):
    """Links and components of (id, vector, label) by all pairs."""
    ok = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x, lx), (j, y, ly) = ok[a], ok[b]
            if lx == ly and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                i, j = sorted((root(i), root(j)))
                up[j] = i
    return {i: (links[i], root(i)) for i in links}


def made(n=400, d=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    out = []
    for k in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=d) * rng.choice([0.02, 0.08, 0.15, 1.0])
        out.append((1000 - k, [float(x) for x in np.float32(v * rng.uniform(0.1, 9))], int(rng.integers(3))))
    return out


@pytest.mark.parametrize("threshold", [0.98, 0.9, 1.0, 0.5])
def test_is_the_brute_force_result(spark, threshold):
    rows = made()
    rows += [(2000 + k, rows[0][1], rows[0][2]) for k in range(5)]  # exact copies
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_duplicates(df, threshold).collect()}
    if threshold == 1.0:
        assert got.keys() == {r[0] for r in rows}
    else:
        assert got == brute(rows, threshold)


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 1.0], None), (8, [1.0, 1.0], None), (9, [1.0, 1.0], 1), (10, [2.0, 2.0], 1), (11, [1.0, 1.0, 0.0], 1), (12, [-0.0, 1.0], 1), (13, [0.0, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()}
    assert {i for i, g in got.items() if g[0]} == {9, 10, 12, 13} and got[10] == (1, 9, False) and got[13] == (1, 12, False) and got[1] == (0, 1, True)


def test_empty_table_and_repeated_rows(spark):
    assert embedding_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = embedding_near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1, "")] * 2, SCHEMA)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in twice] == [(1, 1, True)] * 2


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr("lodestar.llm.embed_dedup.BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in np.float32([1, 1, 1, 1] + rng.normal(size=4) * 0.12)], 1) for k in range(150)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_duplicates(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()}
    assert got == brute(rows, 0.98)


def test_stopping_early_loses_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 40)) * np.linspace(3, 0.1, 40)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = near_pairs(x, x, principal_axes(unit), 0.6, True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.6, 1)), strict=True)}
    assert set(zip(i, j, strict=True)) == want and want


def test_heads_and_strips_lose_no_pair(spark, monkeypatch):
    """Vectors longer than a head, with spread in the later dimensions too, in several blocks and strips."""
    from lodestar.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    monkeypatch.setattr(embed_dedup, "STRIP", 16)
    rows = made(500, 40, 8) + [(5000 + k, v, lab) for k, (_, v, lab) in enumerate(made(60, 40, 8))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_duplicates(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(6)).collect()}
    assert got == brute(rows, 0.98) and sum(n > 0 for n, _ in got.values()) > 100


def test_joining_by_strips_is_transitive():
    from lodestar.llm.embed_dedup import _join

    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 60, (50, 2))
    label, up = np.arange(60), list(range(60))
    for part in np.array_split(pairs, 7):
        _join(label, part[:, 0], part[:, 1])
    for a, b in pairs.tolist():
        x, y = up[a], up[b]
        up = [min(x, y) if u in (x, y) else u for u in up]
    assert label.tolist() == up


def test_repeated_ids_are_separate_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, ""), (1, [0.0, 1.0], 1, ""), (2, [1.0, 0.01], 1, ""), (3, [0.0, -0.0], 1, "")]
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
