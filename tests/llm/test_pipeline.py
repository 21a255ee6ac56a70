from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest

from lodestar.llm import registry
from lodestar.llm.bpe import BytePairs, read_ranks

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's table, written and read again."""
    sf, out = "/root/testdata/sf0.01", tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], sf).write.parquet(f"{out}/{k}")
        made.append(spark.read.parquet(f"{out}/{k}"))
    return made


def test_columns_and_rows(steps):
    assert all(set(s.columns) == COLUMNS for s in steps[:-1]) and set(steps[-1].columns) == COLUMNS | {"token_ids", "n_tokens"}
    n = [s.count() for s in steps]
    assert n[0] > n[1] > n[2] == n[3] and n[4] == n[5]


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    left = {r.doc_id for r in steps[1].collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert sum(r.doc_id in left for r in labels if r.toxic == 0) >= 0.99 * sum(r.toxic == 0 for r in labels)
    assert sum(r.doc_id in left for r in labels if r.toxic) <= 0.1 * sum(r.toxic for r in labels)


def test_no_near_duplicates_are_left(steps):
    sets = {}
    for r in steps[2].collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    at = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    both = Counter((a, b) for ids in at.values() for a in ids for b in ids if a < b)
    assert all(100 * k < 80 * (len(sets[a]) + len(sets[b]) - k) for (a, b), k in both.items())


def test_personal_data_is_gone_and_lengths_follow(steps):
    rows = steps[3].collect()
    assert not any("@mail" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows) and any("[EMAIL]" in r.text for r in rows)


def test_ids_decode_to_the_texts(steps):
    pairs = BytePairs(read_ranks(public_tokenizers.path(registry.RANKS)), public_tokenizers.PATTERN)
    for r in steps[5].collect():
        assert pairs.decode([r.token_ids])[0].decode() == r.text and len(r.token_ids) == 4 * r.n_tokens


def test_run_is_the_stages_in_turn(spark, steps):
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect())
    assert got == Counter(r.doc_id for r in steps[5].collect())


def odd_documents(spark, empty=False):
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, "some plain words here", "en", None, 3, "x"), (3, "w " * 40_000, "en", "a", 1, None),
        (4, "you idiot moron stupid", "en", "b", 1, "x"), (5, "mail me at a.b@mail.example now", None, "b", 1, "x"), (5, "mail me at a.b@mail.example now", None, "b", 1, "x"), (6, "😀 é ß", "de", "", 1, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    df = spark.createDataFrame([] if empty else rows, schema)
    return df.withColumns({c: df.score for c in ("hits", "base", "more", "size", "copies", "id", "n", "label", "component_id", "kept")})


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tmp_path, stage, empty):
    spark.createDataFrame([(4, 1, 1), (2, None, None), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents(spark, empty)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and (not empty or rows == [])
    if not empty:
        ids = [r.doc_id for r in rows]
        want = {"toxicity": 7, "near_duplicates": 8, "personal_data": 8, "token_ids": 8}.get(stage)
        assert want in (None, len(ids))
        if stage == "toxicity":
            assert 4 not in ids and None in ids
        if stage == "personal_data":
            assert [r.text for r in rows if r.doc_id == 5] == ["mail me at [EMAIL] now"] * 2 and [r.text for r in rows if r.doc_id == 1] == [None]
