"""Embedding near-duplicates: cells by leading principal axes, tiles that accumulate leading dimensions first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, n_partitions, stored, with_arrow
from .components import connected_components

#: Vectors of one block; two blocks make a tile.
BLOCK = 4096
#: Rows of a tile that are worked on at a time.
STRIP = 256
#: Leading dimensions, turned to the axes, by which tiles are sifted before full vectors move.
HEAD = 16
#: Vectors of the bounded sample that gives the axes; they steer the work, never a result.
AXES_SAMPLE = 4096
#: Dimensions that are added at a time before pairs are given up.
STEP = 8
#: Leading axes that cut space into cells.
CELL_AXES = 2


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Columns of an orthonormal basis, by falling variance of the given unit vectors."""
    centred = vectors - vectors.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1]


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of what follows each dimension, from all of them (0) to none (d)."""
    rest = np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0))
    return np.hstack([rest, np.zeros((len(x), 1))])


def near_strips(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i of a and j of b (i < j within one block) whose cosine is at least threshold, in double precision, strip by strip.

    Unit vectors are turned to the axes; products of the leading dimensions are bounded by the product of the norms of
    the remaining ones, and pairs leave as soon as that bound is below the threshold. The cosine that decides is taken
    on the given vectors.
    """
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    ua, ub = a / na[:, None] @ axes, b / nb[:, None] @ axes
    rest_a, rest_b = _suffix_norms(ua), _suffix_norms(ub)
    d, least = a.shape[1], threshold - 1e-9
    for low in range(0, len(a), STRIP):
        rows = np.arange(low, min(low + STRIP, len(a)))
        part, at = np.zeros((len(rows), len(b))), 0
        alive = np.arange(len(b))[None, :] > rows[:, None] if same else np.ones(part.shape, bool)
        while at < d and alive.mean() > 0.05:  # many pairs: all of them by matrix products
            to = min(at + STEP, d)
            part += ua[rows, at:to] @ ub[:, at:to].T
            alive &= part + np.outer(rest_a[rows, to], rest_b[:, to]) >= least
            at = to
        i, j = np.nonzero(alive)
        part, i = part[i, j], rows[i]
        for start in range(at, d, STEP):
            to = min(start + STEP, d)
            part = part + np.einsum("ij,ij->i", ua[i, start:to], ub[j, start:to])
            ok = part + rest_a[i, to] * rest_b[j, to] >= least
            i, j, part = i[ok], j[ok], part[ok]
        ok = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok[k : k + (1 << 16)] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
        yield i[ok], j[ok]


def near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All of near_strips at once."""
    found = list(near_strips(a, b, axes, threshold, same))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def head_partners(a: np.ndarray, b: np.ndarray, home_a: np.ndarray, home_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a and of b have a partner by their heads: leading dimensions and, last, the norm of the rest."""
    has_a, has_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for low in range(0, len(a), STRIP):
        x = a[low : low + STRIP]
        near = (x[:, :-1] @ b[:, :-1].T + np.outer(x[:, -1], b[:, -1]) >= threshold - 1e-5) & (home_a[low : low + STRIP, None] | home_b[None, :])
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(low, low + len(x))[:, None]
        has_a[low : low + STRIP] |= near.any(axis=1)
        has_b |= near.any(axis=0)
    return has_a, has_b


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows of one tile, from batches sorted by their first four columns."""
    held, mark = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k).fill_null(0)) for k in range(4)]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            key = tuple(k[a] for k in keys)
            if key != mark and held:
                yield mark, held
                held = []
            mark = key
            held.append(batch.slice(a, b - a))
    if held:
        yield mark, held


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of linked rows; label holds the least row of each row's class."""
    while (differ := label[i] != label[j]).any():
        x, y = label[i[differ]], label[j[differ]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _lists(t: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a column of lists, where each row's begin, and how many they are."""
    held = t.column(column).combine_chunks()
    size = np.asarray(held.value_lengths())
    return held.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size


def _sift(threshold: float):
    """Of each tile of heads, the rows that may have a partner in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, bi, bj), parts in _tiles(batches):
            t = pa.Table.from_batches(parts)
            block, home = t.column("block").to_numpy(), t.column("home").to_numpy()
            flat, start, size = _lists(t, "head")
            keep = np.zeros(t.num_rows, bool)
            for d in np.unique(size):
                of_d = size == d
                p, q = np.flatnonzero(of_d & (block == bi)), np.flatnonzero(of_d & (block == bj))
                if len(p) and len(q):
                    x, y = (flat[start[rows][:, None] + np.arange(d)] for rows in (p, q))
                    keep_p, keep_q = head_partners(x, y, home[p], home[q], threshold, bi == bj)
                    keep[p] |= keep_p
                    keep[q] |= keep_q
            if keep.any():
                yield from t.drop_columns(["head"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _compare(axes_of: dict[int, np.ndarray], threshold: float):
    """For each tile: how many vectors each class links to, and its least class in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, bi, bj), parts in _tiles(batches):
            t = pa.Table.from_batches(parts)
            ids, times, block, home = (t.column(c).to_numpy() for c in ("c", "times", "block", "home"))
            flat, start, size = _lists(t, "v")
            n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for d in np.unique(size):
                of_d = size == d
                p, q = np.flatnonzero(of_d & (block == bi)), np.flatnonzero(of_d & (block == bj))
                if not len(p) or not len(q):
                    continue
                x, y = (flat[start[rows][:, None] + np.arange(d)].astype(float) for rows in (p, q))
                for i, j in near_strips(x, y, axes_of.get(int(d), np.eye(d)), threshold, bi == bj):
                    i, j = p[i], q[j]
                    met = home[i] | home[j]  # two visitors meet in a cell of their own
                    i, j = i[met], j[met]
                    n += np.bincount(i, times[j], len(ids)).astype(np.int64) + np.bincount(j, times[i], len(ids)).astype(np.int64)
                    _join(label, i, j)
            some, moved = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids)))
            if len(some):
                u, k = np.concatenate([ids[some], ids[moved]]), np.concatenate([n[some], np.zeros(len(moved), np.int64)])
                v = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[label[moved]])])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(k), v], names=["u", "n", "v"])

    return run


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: vectors of equal label linked at cosine >= threshold.

    Equal vectors of a label collapse into one class with a count. Unit vectors within the link distance differ by no
    more than it on any axis, so each class meets those of its own cell of the two leading axes and visits the later
    neighbouring cells that lie within that distance; cells are dealt out as tiles of two blocks. First only heads are
    dealt: the leading dimensions and the norm of the rest, which bound a cosine. Full vectors then move to the tiles
    where their head has a partner. Every linked pair meets in exactly one tile.
    Null labels, null or zero vectors and those with null or non-finite components link with nothing; vectors of
    different lengths neither. Ids are integers (cast to long). Rows that repeat an id count as separate vectors of one
    id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector)
    if dict(vectors.dtypes)[vector] != "array<float>":  # single precision stays as it is: half the bytes to move
        v = v.cast("array<double>")
    fit = F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    plain = F.when(fit, F.transform(v, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))  # one kind of zero
    prints = [F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "label", "v")).alias(f"p{seed}") for seed in (1, 2)]
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), plain.alias("v"))
    classes = base.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    classes = classes.select(F.monotonically_increasing_id().alias("c"), "id", "times", *prints, F.size("v").alias("size"), F.xxhash64("label", F.size("v")).alias("g"), "v")
    classes = stored(classes)

    sample = classes.select("size", "v").orderBy(F.xxhash64("p1")).limit(AXES_SAMPLE).collect()
    axes_of: dict[int, np.ndarray] = {}
    for d in {r["size"] for r in sample}:
        x = np.array([r["v"] for r in sample if r["size"] == d])
        axes_of[d] = principal_axes(x / np.sqrt((x * x).sum(axis=1))[:, None])
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) * 1.0001 + 1e-9
    width = 2 * reach

    def make():
        def run(batch: pa.RecordBatch) -> list:
            flat, start, size = _lists(pa.Table.from_batches([batch]), "v")
            at = np.zeros((len(size), CELL_AXES))
            heads: list = [None] * len(size)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = flat[start[rows][:, None] + np.arange(d)].astype(float)
                x = x / np.sqrt((x * x).sum(axis=1))[:, None] @ axes_of.get(int(d), np.eye(d))
                k, h = min(CELL_AXES, d), min(HEAD, d)
                at[rows, :k] = x[:, :k]
                head = np.hstack([x[:, :h], np.sqrt(np.maximum((x[:, h:] ** 2).sum(axis=1), 0))[:, None]]).astype(np.float32)
                for r, values in zip(rows, head, strict=True):
                    heads[r] = values
            own = np.floor(at / width).astype(int)
            low, high = np.floor((at - reach) / width).astype(int), np.floor((at + reach) / width).astype(int)
            cells = []
            for c, a, b in zip(own, low, high, strict=True):
                home = int(c[0]) * 4096 + int(c[1])
                mine = [(home, True)]
                for x0 in range(a[0], b[0] + 1):
                    mine += [(cell, False) for x1 in range(a[1], b[1] + 1) if (cell := x0 * 4096 + x1) > home]
                cells.append([{"cell": cell, "home": h} for cell, h in mine])
            return [pa.array(cells, pa.list_(pa.struct([("cell", pa.int64()), ("home", pa.bool_())]))), pa.array(heads, pa.list_(pa.float32()))]

        return run

    cell = T.StructType([T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType())])
    made = [T.StructField("cells", T.ArrayType(cell)), T.StructField("head", T.ArrayType(T.FloatType()))]
    placed = with_arrow(classes.select("g", "c", "v"), made, make).drop("v")
    placed = stored(placed.withColumn("x", F.explode("cells")).select("g", "x.cell", "x.home", "c", "head"))
    counts = placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = placed.join(counts, ["g", "cell"]).withColumn("block", F.pmod(F.xxhash64("c", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", "cell", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "home", "c", "head")
    by = ["g", "cell", "bi", "bj"]

    def tiles(df: DataFrame) -> DataFrame:
        return df.repartition(n_partitions(spark), *by).sortWithinPartitions(*by, "c")

    left = stored(tiles(dealt).mapInArrow(_sift(threshold), "g long, cell long, bi int, bj int, block int, home boolean, c long"))
    discard(placed)
    full = left.join(classes.select("c", "times", "v"), "c").select(*by, "block", "home", "c", "times", "v")
    found = stored(tiles(full).mapInArrow(_compare(axes_of, threshold), "u long, n long, v long"))
    discard(left)
    linked = found.where("v is null").groupBy(F.col("u").alias("c")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("v is not null")).withColumnRenamed("id", "c")
    parts = stored(parts.join(classes.select("c", "id"), "c"))
    least = parts.groupBy("component_id").agg(F.min("id").alias("least"))
    parts = parts.join(least, "component_id").select("c", "least")

    named = classes.select("p1", "p2", "c", "id", "times").join(linked, "c", "left").join(parts, "c", "left")
    named = named.select("p1", "p2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    out = base.select("id", *prints).join(named, ["p1", "p2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
