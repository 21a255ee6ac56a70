"""Weighted BM25 over phrases, their groups, and the top of a ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import FIELD_WEIGHTS

# Fixed values of the ranking formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Phrase:
    """One entry of an expression; prefix phrases match all terms that begin with it. Repeats count again."""

    group: int
    text: str
    prefix: bool = False


def group_phrases(groups: Sequence[Sequence[str]]) -> list[Phrase]:
    """Each group's first word, the same as a prefix (two letters or more), then its other words as they are."""
    out = []
    for g, (term, *others) in enumerate(groups):
        out.append(Phrase(g, term))
        if len(term) >= 2:
            out.append(Phrase(g, term, True))
        out += [Phrase(g, w) for w in others]
    return out


def matches(postings: DataFrame, phrases: Sequence[Phrase]) -> DataFrame:
    """(phrase, group, id, field, term, tf, dl) of the postings that phrases match.

    The terms to look for are pushed to the scan as comparisons; the phrase list is a handful of rows.
    """
    spark = postings.sparkSession
    wanted = reduce(or_, [F.col("term").startswith(p.text) if p.prefix else F.col("term") == p.text for p in phrases], F.lit(False))
    table = spark.createDataFrame([(k, p.group, p.text, p.prefix) for k, p in enumerate(phrases)], "phrase int, `group` int, text string, prefix boolean")
    fits = F.when(F.col("prefix"), F.col("term").startswith(F.col("text"))).otherwise(F.col("term") == F.col("text"))
    return postings.where(wanted).join(F.broadcast(table), fits).select("phrase", "group", "id", "field", "term", "tf", "dl")


def bm25(found: DataFrame, stats: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS, n_groups: int | None = None) -> DataFrame:
    """(id, raw, n_groups): lower raw is better. With n_groups, only documents that all groups match.

    found is what matches() gives, stats the row of corpus_stats(): a ranking reads the postings of its terms and
    nothing else of the corpus.
    """
    n, average = stats.select("n", "mean").first()
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("field")), F.lit(0.0))
    per = found.groupBy("phrase", "group", "id", "dl").agg(F.sum(weight * F.col("tf")).alias("f"))
    df = per.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rated = df.select("phrase", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))  # one row per phrase
    scored = per.join(F.broadcast(rated), "phrase")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(average or 1.0)))
    out = scored.groupBy("id").agg((-F.sum(part)).alias("raw"), F.countDistinct("group").alias("n_groups"))
    return out if n_groups is None else out.where(F.col("n_groups") == n_groups)


def top(scored: DataFrame, limit: int, by: str = "raw", descending: bool = False) -> DataFrame:
    return scored.orderBy(F.col(by).desc() if descending else F.col(by), "id").limit(limit)
