"""Words that go together: document frequencies, pairs of a document's rarest words, NPMI and Jaccard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_words

# Words that say nothing, and the limits of what is learned.
NOISE = "the and for with from that this new copy final old pdf jpg jpeg png txt doc docx xls xlsx zip img dsc file files untitled home".split()
READ_CHARS, READ_WORDS, PAIRED_WORDS = 3000, 60, 15
LEAST_DF, LEAST_TOGETHER, MOST_DF_SHARE, TOP, LEAST_DOCS = 3, 3, 0.2, 8, 20
LEAST_NPMI, LEAST_JACCARD = 0.3, 0.25
#: Usable words up to which their frequencies are broadcast.
BROADCAST_WORDS = 500_000


def document_words(name: Column, folder: Column, content: Column) -> Column:
    """The first READ_WORDS distinct words of name, folder and the head of the text that may mean something."""
    found = F.concat(split_words(name), split_words(folder), split_words(F.substring(content, 1, READ_CHARS)))
    useful = F.filter(found, lambda w: F.length(w).between(3, 25) & ~w.rlike(r"^\p{Nd}+$") & ~w.isin(NOISE))
    return F.slice(F.array_distinct(useful), 1, READ_WORDS)


def sampled(docs: DataFrame, most: int) -> DataFrame:
    """About `most` documents by a hash of their id, all if there are no more: each of a step that their number gives."""
    step = max(1, docs.count() // most)
    return docs if step == 1 else docs.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)


def related_words(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(word, other, score): pairs in both directions, score being their Jaccard overlap. All documents count; sampled() gives fewer.

    Frequencies count all words of a document, pairs only its PAIRED_WORDS rarest usable ones (ties by word), so a
    document gives 105 pairs at most. Fewer than LEAST_DOCS documents with two words teach nothing.
    """
    read = docs.select("id", document_words(F.col("name"), F.col("folder"), F.col("content")).alias("words")).where(F.size("words") >= 2).persist()  # read three times
    n = read.count()
    if n < LEAST_DOCS:
        return read.sparkSession.createDataFrame([], "word string, other string, score double")
    each = read.select("id", F.explode("words").alias("word"))
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    usable = df.where((F.col("df") >= LEAST_DF) & (F.col("df") <= max(LEAST_DF, int(MOST_DF_SHARE * n)))).persist()
    if usable.count() <= BROADCAST_WORDS:  # beyond, every word of every document is shuffled to its frequency
        usable = F.broadcast(usable)
    # a document's words are READ_WORDS at most: they come together without a window over the corpus
    rated = each.join(usable, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("rated"))
    rare = rated.select(F.array_sort(F.transform(F.slice("rated", 1, PAIRED_WORDS), lambda x: x["word"])).alias("w"))
    pairs = F.flatten(F.transform("w", lambda a, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    together = rare.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") >= LEAST_TOGETHER) & (F.col("c") < n))
    counted = together.join(usable.select(F.col("word").alias("a"), F.col("df").alias("df_a")), "a").join(usable.select(F.col("word").alias("b"), F.col("df").alias("df_b")), "b")
    c, total = F.col("c"), F.lit(float(n))
    npmi = F.log(c * total / (F.col("df_a") * F.col("df_b"))) / -F.log(c / total)
    score = c / (F.col("df_a") + F.col("df_b") - c)
    kept = counted.where((npmi >= LEAST_NPMI) & (score >= LEAST_JACCARD)).select("a", "b", score.alias("score"))
    both = kept.select(F.col("a").alias("word"), F.col("b").alias("other"), "score").union(kept.select("b", "a", "score"))
    order = Window.partitionBy("word").orderBy(F.desc("score"), F.desc("other"))
    return both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).drop("r")


def best_related(terms: DataFrame, related: DataFrame, limit: int = 3, least: float = LEAST_JACCARD) -> DataFrame:
    """(term, other, score, place): the strongest associations of each term."""
    found = terms.select("term").distinct().join(related.where(F.col("score") >= least), F.col("term") == F.col("word"))
    order = Window.partitionBy("term").orderBy(F.desc("score"), "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("term", "other", "score", "place")
