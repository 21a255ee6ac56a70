"""Connected components of an edge table by alternating star contraction, all in DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


#: Neighbours from which a node's edges are spread, the tasks they go to, and hubs whose list may be broadcast.
HUB, HUB_PARTS, MOST_BROADCAST = 50_000, 64, 100_000
#: Edges of one task of a round.
EDGES_PER_TASK = 100_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if x < y:
            x, y = y, x
        self.up[x] = y
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by stars around the smallest member."""
    for batch in batches:
        f = Forest()
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f.join(u, v)
        nodes = np.fromiter(f.up, np.int64, len(f.up))
        roots = np.fromiter(map(f.root, f.up), np.int64, len(f.up))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the m of their u. Edges of hubs are spread over HUB_PARTS tasks, to each of which the hub's row goes."""
    hubs = least.where(F.col("n") > HUB)
    n_hubs = hubs.count()  # edges / HUB at most
    if not n_hubs:
        return edges.join(least, "u")
    named = hubs.select("u", F.lit(True).alias("hub"))
    marked = edges.join(F.broadcast(named) if n_hubs <= MOST_BROADCAST else named, "u", "left")
    dealt = marked.withColumn("part", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS))).otherwise(0).cast("int"))
    parts = F.when(F.col("n") > HUB, F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(least.withColumn("part", F.explode(parts)), ["u", "part"])


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(id, component_id) for every id on an edge; component_id is the smallest id reachable.

    Rounds of large star and small star; each keeps at most as many edges as it was given and hubs
    are pre-aggregated before their shuffle. Loops, nulls and repeated edges are harmless; no edges give no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = stored(e.mapInArrow(_contract, "u long, v long").distinct())
    before = _print(e)
    while before[0]:
        # a round never adds edges, so their number says how few tasks and files hold them
        parts = math.ceil(before[0] / EDGES_PER_TASK)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n").coalesce(2 * parts))
        large = stored(_with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts))
        discard(least)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small.coalesce(parts))
        discard(e)
        discard(large)
        e, last, before = small, before, _print(small)
        if before == last:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
