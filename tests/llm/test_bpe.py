import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodestar.llm import registry
from lodestar.llm.bpe import BytePairs, bpe_decode, bpe_encode, read_ranks

PATH, PATTERN = public_tokenizers.path(registry.RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(read_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def odd_texts():
    random.seed(0)
    signs = [chr(c) for c in range(260)] + [chr(c) for c in (0x1C, 0x85, 0x2028, 0x180E, 0x200B, 0x3000, 0xFEFF, 0x661, 0x1F600, 0x4E2D, 0x301, 0x10FFFF)]
    made = ["".join(random.choices(signs, k=random.randint(0, 60))) for _ in range(1500)]
    made += ["".join(random.choices("abcthe", k=700)) for _ in range(20)]
    return made + ["", "a" * 3000, " " * 900 + "x", "\n\n \t x" * 50, "€" * 500, "1" * 1000, "don't've" * 80, "<|endoftext|>"]


def test_is_the_librarys_encoding(pairs, library):
    texts = odd_texts()
    got = pairs.encode(texts)
    assert got == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert [b.decode() for b in pairs.decode(got)] == texts


def test_matrix_and_queue_agree(pairs):
    random.seed(4)
    pieces = [bytes(random.choices(b"abcdeth \xc3\xa9", k=random.randint(2, 200))) for _ in range(300)]
    assert [a.tolist() for a in pairs.merge_matrix(pieces)] == [pairs.merge_long(p).tolist() for p in pieces]


def test_lookup_of_pairs(pairs):
    ranks = pairs.ranks
    assert pairs.pair_ranks(np.array([ranks[b"t"], 50_000]), np.array([ranks[b"h"], 50_000])).tolist() == [ranks[b"th"], 2**31 - 1]


def test_small_store_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("lodestar.llm.bpe._KEPT", 3)
    fresh = BytePairs(read_ranks(PATH), PATTERN)
    for t in ("some words here", "other words there", "some words here"):
        assert fresh.encode([t])[0] == np.array(library.encode_ordinary(t), "<u4").tobytes()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "héllo wörld " * 20_000, 5), (3, "x", 5)], "doc_id long, text string, n_tokens int")
    out = bpe_decode(bpe_encode(df, PATH, PATTERN), PATH).collect()
    assert {(r.text or "") for r in out} == {bytes(r.decoded).decode() for r in out} and all(len(r.token_ids) == 4 * r.n_tokens for r in out)
    assert bpe_encode(df.limit(0), PATH, PATTERN).count() == 0
    assert bpe_encode(df, PATH, PATTERN).columns.count("n_tokens") == 1


def test_query_round_trip(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.op4_bpe(spark, sf_dir).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
