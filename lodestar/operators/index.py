"""Inverted index: postings, statistics, vocabulary and trigrams, all partial-aggregated before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_tokens, split_words, trigrams

#: Fields in the order of explanations, and their weights in the ranking.
FIELD_WEIGHTS = {"name": 10.0, "folder": 3.0, "content": 1.0, "extra": 3.0}


def _tokens(field: str) -> Column:
    return (index_tokens if field == "content" else split_words)(F.col(field))


def token_rows(docs: DataFrame) -> DataFrame:
    """(id, dl, field, term) for each token of docs(id, name, folder, content, extra), dl being their number in the
    document; one scan, no shuffle, each field is split once."""
    split = docs.select("id", *[_tokens(f).alias(f) for f in FIELD_WEIGHTS])
    made = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in FIELD_WEIGHTS])
    length = sum((F.size(f) for f in FIELD_WEIGHTS), F.lit(0)).cast("long")
    return split.select("id", length.alias("dl"), F.explode(made).alias("x")).select("id", "dl", "x.field", F.explode("x.terms").alias("term"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, field, id, tf, dl): what a ranking needs of a term and a document, length included. Documents without
    tokens have none."""
    return token_rows(docs).groupBy("term", "field", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n, mean): documents, those without tokens too, and tokens of one on average."""
    length = sum((F.size(_tokens(f)) for f in FIELD_WEIGHTS), F.lit(0)).cast("long")
    return docs.select(length.alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))


def admitted(word: Column) -> Column:
    return ~word.rlike(r"^\p{Nd}+$") & F.length(word).between(2, 30)


def vocabulary(docs: DataFrame, words_per_text: int | None = None) -> DataFrame:
    """(word, src): words of names, folders and photo places have src 1, words only seen in texts 0.

    Of each text all words of 4 to 20 letters count, or the first words_per_text distinct ones in alphabetical order.
    """
    named = docs.select(F.explode(F.array_distinct(F.concat(*[split_words(F.col(f)) for f in ("name", "folder", "extra")]))).alias("word"), F.lit(1).alias("src"))
    inside = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"\p{L}{4,20}"), F.lit(0)))
    if words_per_text is not None:
        inside = F.slice(F.array_sort(inside), 1, words_per_text)
    folded = F.filter(F.array_distinct(F.flatten(F.transform(inside, split_words))), lambda w: F.length(w) >= 2)
    texts = docs.select(F.explode(folded).alias("word"), F.lit(0).alias("src"))
    return named.union(texts).where(admitted(F.col("word"))).groupBy("word").agg(F.max("src").alias("src"))


def vocabulary_trigrams(vocab: DataFrame) -> DataFrame:
    """(gram, word, tf, n_grams): tf counts repeats of a piece inside the word."""
    all_grams = F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda k: F.substring(F.col("word"), k, F.lit(3)))
    made = vocab.where(F.length("word") >= 3).select("word", all_grams.alias("grams"), trigrams(F.col("word")).alias("each"))
    out = made.select("word", F.size("grams").alias("n_grams"), "grams", F.explode("each").alias("gram"))
    return out.select("gram", "word", F.size(F.filter("grams", lambda g: g == F.col("gram"))).alias("tf"), "n_grams")
