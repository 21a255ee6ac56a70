"""Mixing sources to target weights: water-filled targets, pivotal dependent rounding, a reduction tree of residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, n_partitions, stored, words

#: Documents that one rounding step takes together; each block hands one fractional document up the tree.
BLOCK = 128

_ITEM = "struct<k:int,h:bigint,size:bigint,m:double>"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, ceiling: float) -> DataFrame:
    """(source, source_size, target): a row per source of (source, size), nulls being a source of their own.

    Sources in code point order, null last, take the weights in turn and share budget * all sizes; no target exceeds
    ceiling * its source, and what is cut off goes to the others by weight. Places come from a range-partitioned
    sort, so that any number of sources works. Needs budget <= ceiling.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    placed = per.repartitionByRange(n_partitions(spark), "last", "source").sortWithinPartitions("last", "source")
    placed = stored(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    parts = placed.groupBy("part").count()
    # one row per partition of the sort: as many as the cluster has tasks, whatever the number of sources
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.pmod(F.col("before") + F.col("at"), F.lit(len(weights))).cast("int")
    ranked = stored(placed.join(before, "part").select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1).alias("w")))
    discard(placed)
    cap = F.col("source_size") * F.lit(float(ceiling))
    total = budget * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = cap < F.col("w") * F.lit(level)
        held, open_weight = ranked.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(~full, F.col("w")).otherwise(0.0))).first()
        new = (total - held) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(cap, F.col("w") * F.lit(level)).alias("target"))


def _uniform(*by) -> Column:
    """A number above 0 and below 1 that depends on these values alone."""
    return (F.pmod(F.xxhash64(*by), F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def _round_block(items: Column, seed: int) -> Column:
    """Pivotal steps along an array of items, m being the fraction of a copy in words (0 < m < size).

    Two neighbours move words between them, at random and without bias, until one holds none or all of its size;
    the other goes on. Returns done (items with all or nothing) and rest (the fractional one, or null).
    """

    def step(acc: Column, x: Column) -> Column:
        y = acc["rest"]
        up, down = F.least(x["size"] - x["m"], y["m"]), F.least(x["m"], y["size"] - y["m"])
        to_x = _uniform(x["h"], y["h"], x["k"], y["k"], F.lit(seed)) * (up + down) < down

        def item(of: Column, m: Column) -> Column:
            return F.struct(of["k"].alias("k"), of["h"].alias("h"), of["size"].alias("size"), m.alias("m"))

        size_x, size_y, zero = x["size"].cast("double"), y["size"].cast("double"), F.lit(0.0)
        fills, empties = (x["size"] - x["m"]) <= y["m"], x["m"] <= (y["size"] - y["m"])
        new_x = F.when(to_x, F.when(fills, size_x).otherwise(x["m"] + y["m"])).otherwise(F.when(empties, zero).otherwise(x["m"] - (y["size"] - y["m"])))
        new_y = F.when(to_x, F.when(fills, y["m"] - (x["size"] - x["m"])).otherwise(zero)).otherwise(F.when(empties, y["m"] + x["m"]).otherwise(size_y))

        def settled(m: Column, size: Column) -> Column:
            return (m <= 0.0) | (m >= size)

        def of_pair(pair: Column) -> Column:
            a, b = pair["a"], pair["b"]
            done_a, done_b = settled(a["m"], a["size"]), settled(b["m"], b["size"])
            done = F.concat(acc["done"], F.when(done_a & done_b, F.array(a, b)).when(done_a, F.array(a)).otherwise(F.array(b)))
            return F.struct(done.alias("done"), F.when(done_a & done_b, F.lit(None).cast(_ITEM)).when(done_a, b).otherwise(a).alias("rest"))

        paired = F.transform(F.array(F.struct(item(x, new_x).alias("a"), item(y, new_y).alias("b"))), of_pair)[0]
        return F.when(y.isNull(), F.struct(acc["done"].alias("done"), x.cast(_ITEM).alias("rest"))).otherwise(paired)

    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("rest"))
    return F.aggregate(items, start, step)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, ceiling: float = 2.0, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 10) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row: how often the mix takes each document.

    Each document of a source expects target / source_size copies; whole copies are certain and the fractions are
    settled by pivotal rounding in blocks, whose residuals meet in further levels until each source has one, which
    goes to the nearer side. So a source misses its target by half a document at most, and no document has more
    copies than that quotient rounded up. Chances come from hashes: reruns agree. Texts without a word, or null,
    have size 0, no effect and copies as certain (0 words taken). Rows with one id and size share chances but are
    settled one by one; a null source is a source; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text).cast("string"))).cast("long").alias("size"))
    base = stored(base)
    targets = stored(source_targets(base, weights, budget, ceiling))
    same = [F.col("s.source").eqNullSafe(F.col("t.source"))]
    rated = base.alias("s").join(targets.alias("t"), same, "left").select("id", F.col("s.source").alias("source"), "size", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("whole", F.floor(rate + 1e-12)).withColumn("part", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    # rows alike in every way are told apart by their number, so that each is settled once
    alike = rated.groupBy("id", "source", "size", "source_size", "target", "whole", "part").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    alike = stored(alike.withColumn("h", F.xxhash64("id", "source", "size", "copy", F.lit(seed))).withColumn("k", F.hash("id", "source", "size", "copy")))

    open_ = alike.where("size > 0 and part > 1e-12")
    group = F.xxhash64("source", F.lit(1))  # null has a value of its own
    item = F.struct("k", "h", F.col("size").alias("size"), (F.col("part") * F.col("size")).alias("m"))
    level = open_.select(group.alias("g"), item.alias("item"))
    done, depth = [], 0
    while True:
        counts = level.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0]
        if not most:
            break
        blocks = counts.select("g", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        dealt = level.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("item.h", F.lit(depth)), F.col("blocks")))
        gathered = dealt.groupBy("g", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("item.h").alias("by"), "item"))).alias("items"))
        rounded = stored(gathered.select("g", _round_block(F.transform("items", lambda x: x["item"]), seed + depth).alias("r")))
        done.append(rounded.select(F.explode("r.done").alias("x")).select(F.col("x.h").alias("h"), F.col("x.k").alias("k"), (F.col("x.m") > 0).cast("int").alias("extra")))
        level = rounded.where("r.rest is not null").select("g", F.col("r.rest").alias("item"))
        depth += 1
        if most <= BLOCK:
            done.append(level.select(F.col("item.h").alias("h"), F.col("item.k").alias("k"), (F.col("item.m") * 2 >= F.col("item.size")).cast("int").alias("extra")))
            break
    settled = None
    for part in done:
        settled = part if settled is None else settled.union(part)
    out = alike if settled is None else alike.join(settled, ["h", "k"], "left")
    extra = F.lit(0) if settled is None else F.coalesce("extra", F.lit(0))
    out = out.withColumn("copies", (F.col("whole") + extra).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that share an id take the greatest of their numbers."""
    copies = mix_sources(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias("__id")).agg(F.max("copies").cast("int").alias("__copies"))
    kept = docs.join(copies.where("__copies > 0"), F.col(id_col).eqNullSafe(F.col("__id")))
    return kept.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])

