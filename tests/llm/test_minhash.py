import random

import numpy as np
import pytest

from lodestar.llm import minhash
from lodestar.llm.minhash import Shingler, Signer, drop_near_duplicates, estimate, minhash_near_duplicates, most_differing


def brute(rows, percent, size=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                i, j = sorted((root(ids[a]), root(ids[b])))
                up[j] = i
    return {i: (len(sets[i]), root(i)) for i in ids}


def made(n=260, seed=7):
    """Families of edited copies, a passage that many share, exact copies and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    bases = [[word() for _ in range(rng.choice([4, 30, 120]))] for _ in range(12)]
    out = []
    for k in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        text = " ".join(w)
        out.append((5000 - 3 * k, f"{text}\n{passage}" if rng.random() < 0.3 else text.upper() if rng.random() < 0.1 else text))
    return out + [(9000 + k, out[0][1]) for k in range(20)]


@pytest.mark.parametrize("percent", [85, 80])
def test_is_the_brute_force_result(spark, percent):
    rows = made()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_near_duplicates(df, percent).collect()}
    assert got == brute(rows, percent)


def test_blocks_of_large_families(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PART", 8)
    rows = made(200, 11)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == brute(rows, 85)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, None), (5, "One two"), (6, "one TWO"), (7, "one\u00a0two"), (8, "É b c d e f"), (9, "é b c d e f"), (10, "w " * 30_000), (10, "w " * 30_000)]
    out = minhash_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert got[1] == (0, 1, True) and got[4] == (0, 4, True) and got[5] == (1, 5, True) and got[6] == (1, 5, False) and got[7] == (1, 7, True)
    assert got[9][1] == 9 and got[10] == (1, 10, True)
    assert minhash_near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 85).count() == 0


def test_one_of_each_class_stays(spark):
    rows = [(k, "a b c d e f g h i j" if k < 50 else f"other text number {k}", "x") for k in range(60)] + [(None, "null id", "x")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "None", *map(str, range(50, 60))]) and kept.columns == ["doc_id", "text", "component_id"]


def test_sketches_estimate_high_similarities():
    rng, sign, errors = np.random.default_rng(3), Signer(), []
    for same in (700, 850, 950) * 12:
        pool = rng.integers(0, 2**63, 2000 - same, dtype=np.uint64)
        a, b = pool[:1000], np.concatenate([pool[:same], pool[1000:]])
        truth = same / (2000 - same)
        x, y = (int.from_bytes(sign(s)[1], "big") for s in (a, b))
        errors.append(float(estimate((x ^ y).bit_count())) - truth)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert most_differing(0.85) < most_differing(0.8) < minhash.SKETCH_BITS / 2


def test_words_are_ascii_words():
    assert len(Shingler()("a b\x0bc\x1cd e f")) == 1 and len(Shingler()("")) == 0
    assert np.array_equal(Shingler()("A B C D E F"), Shingler()("a b\nc d e f"))


def chain(n, width=40, step=3):
    """Texts of which neighbours link and the ends don't: a window that moves on over a list of words."""
    return [(k, " ".join(f"w{x}" for x in range(k * step, k * step + width))) for k in range(n)]


def test_links_that_the_first_member_does_not_have(spark, monkeypatch):
    """Chains, and a large group of copies beside stragglers: what stars leave open is compared in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rows = chain(60, 60, 2) + [(1000 + i, t) for i, t in chain(40, 30, 1)]
    body = [f"c{x}" for x in range(120)]
    for k in range(300):
        w = list(body)
        w[k % 120] = f"x{k}"
        rows.append((5000 + k, " ".join(w)))
    rows += [(9000 + k, " ".join(body[: 108 - k] + [f"y{k}"])) for k in range(6)]
    rng = random.Random(4)
    rng.shuffle(rows)
    rows = [(i * 7919 % 100_003, t) for i, t in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 85).collect()}
    want = brute(rows, 85)
    assert got == want and len({c for _, c in want.values()}) < 60


def test_repeated_ids_with_different_texts(spark):
    """The text of least print stands for the id; every order of rows gives the same."""
    rows = [(1, "a b c d e f g h"), (1, "m n o p q r s t"), (2, "a b c d e f g h"), (3, "m n o p q r s t"), (4, None), (4, "x y z u v w")]
    found = []
    for k in (1, 2, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(k)
        found.append(sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash_near_duplicates(df, 85).collect()))
    assert found[0] == found[1] == found[2] and [f[2] for f in found[0]] == [1, 1, 1, 1, 4, 4]
