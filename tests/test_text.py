import random
import unicodedata

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.plans.queryparse import split_text


def plain_distance(a, b, limit):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return min(d[len(a), len(b)], limit + 1)


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "k int, x string")
    return [r[1] for r in df.select("k", f(F.col("x"))).orderBy("k").collect()]


@pytest.mark.parametrize("name, words", [("TaxReturn_2025.pdf", "tax return 2025 pdf"), ("Café-Menü", "cafe menu"), ("Tromsø Straße Łódź", "tromso strasse lodz"), ("TaxReturnPDFFile", "tax return pdf file"), ("", "")])
def test_split_words(spark, name, words):
    assert column(spark, [name], text.split_words) == [words.split()]


def test_fold_agrees_with_the_rule_over_the_basic_plane(spark):
    letters = [chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000]
    several = {c for c in letters if len(text.fold_text(c)) > 1 and ord(c) > 0x24F}
    plain = [c for c in letters if c not in several]
    assert column(spark, plain, text.fold) == [text.fold_text(c) for c in plain]


def test_fold_exact_takes_the_rest(spark):
    odd = ["한글", "㎏", "ǿ", "№", "ﬁn", "𝒜x", None]
    assert column(spark, odd, text.fold_exact) == [None if o is None else text.fold_text(o) for o in odd]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=20), min_size=1, max_size=30))
def test_split_words_is_the_drivers_twin(spark, texts):
    assert column(spark, texts, text.split_words) == [split_text(t) for t in texts]


def test_trigrams(spark):
    assert column(spark, ["invoice", "ab", "aaaa"], text.trigrams) == [["inv", "nvo", "voi", "oic", "ice"], [], ["aaa"]]


def test_edit_distance(spark):
    random.seed(5)
    pairs = [("invoice", "invoice"), ("invoce", "invoice"), ("recieve", "receive"), ("abcdef", "uvwxyz"), ("ca", "abc"), ("", "ab"), ("", "")]
    pairs += [tuple("".join(random.choices("abc", k=random.randint(0, 7))) for _ in "ab") for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.edit_distance(F.col("a"), F.col("b")))
    assert all(d == plain_distance(a, b, 3) for a, b, d in df.collect())


def test_index_tokens_keep_special_letters(spark):
    assert column(spark, ["TaxReturn_2025 Straße Łódź"], text.index_tokens) == [["taxreturn", "2025", "straße", "łodz"]]


def test_nulls(spark):
    assert column(spark, [None], text.split_words) == [[]]
    assert unicodedata.unidata_version and rows(spark.range(1).select(text.fold(F.lit(None).cast("string")))) == [(None,)]
