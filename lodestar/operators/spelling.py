"""Close spellings: trigram candidates, then edit distance; completions and past searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_distance, trigrams
from .index import vocabulary_trigrams
from .ranking import B, K1, LEAST_IDF

# Candidates that are measured, and spellings that are kept.
CANDIDATES, KEPT = 300, 4


def fuzzy_words(terms: DataFrame, vocab: DataFrame, grams: DataFrame | None = None, candidates: int = CANDIDATES, kept: int = KEPT) -> DataFrame:
    """(term, word, distance, src, place) for terms(term): the closest words of vocab(word, src), place from 1.

    Terms of fewer than four letters or of digits alone have none. One edit is allowed up to five letters, two
    beyond. Candidates share a trigram and rank by BM25 over trigrams, ties by word; a join on grams finds them.
    """
    grams = vocabulary_trigrams(vocab) if grams is None else grams
    asked = terms.select("term").distinct().where((F.length("term") >= 4) & ~F.col("term").rlike(r"^\p{Nd}+$"))
    pieces = asked.select("term", F.explode(trigrams(F.col("term"))).alias("gram"))
    # every word is a document here, those too short for a trigram being empty ones
    total = vocab.agg(F.count(F.lit(1)).alias("n_words"), F.avg(F.greatest(F.length("word") - 2, F.lit(0))).alias("mean"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.col("n_words") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    hit = pieces.join(df, "gram").join(grams, "gram").join(F.broadcast(total))  # total is one row
    part = F.when(idf <= 0, LEAST_IDF).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_grams") / F.col("mean")))
    ranked = hit.groupBy("term", "word").agg(F.sum(part).alias("match"))
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.round("match", 9).desc(), "word"))).where(F.col("r") <= candidates)
    allowed = F.when(F.length("term") <= 5, 1).otherwise(2)
    near = first.withColumn("distance", edit_distance(F.col("term"), F.col("word"), 2)).where((F.col("distance") > 0) & (F.col("distance") <= allowed)).join(vocab, "word")
    order = Window.partitionBy("term").orderBy("distance", F.desc("src"), F.abs(F.length("word") - F.length("term")), "word")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept).select("term", "word", "distance", "src", "place")


def completions(vocab: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """Words that begin with prefix, the shortest first; the range reaches Parquet statistics."""
    return vocab.where(F.col("word").startswith(prefix)).orderBy(F.length("word"), "word").limit(limit).select("word")


def past_searches(searches: DataFrame, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """(query, uses, ts) of a log searches(query, ts); with a prefix, others than it that begin with it, most used first."""
    history = searches.groupBy("query").agg(F.count(F.lit(1)).alias("uses"), F.max("ts").alias("ts"))
    if prefix is not None:
        low = prefix.lower()
        history = history.where(F.lower("query").startswith(low) & (F.col("query") != low))
    return history if limit is None else history.orderBy(F.desc("uses"), F.desc("ts"), "query").limit(limit)
