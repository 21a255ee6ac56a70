"""Near-duplicate texts: MinHash bands propose, odd sketches sift, full shingle sets confirm."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, n_partitions, stored, with_arrow
from .components import Forest, connected_components

#: Bands of rows: a pair at similarity 0.85 shares none with probability (1 - 0.85**6)**32 = 3e-7, at 0.8 with 6e-5.
BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Rows of a block; where more rows have to be compared, pairs of such blocks meet.
BLOCK = 256
#: Members of a bucket that are compared with its first member in one place.
PART = 256
#: Standard deviations below the threshold at which a sketch still passes a pair on to the full sets.
MARGIN = 5.0

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD_CACHE = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Distinct shingle hashes of a text: `size` words each, A-Z lower-cased; a shorter text is one shingle."""

    def __init__(self, size: int = 5) -> None:
        self.size, self.word = size, _WordHash()

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII only, which is the rule for words here
        found = text.encode().lower().split() if text else []
        if not found:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.word.__getitem__, found), np.uint64, len(found))
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, min(len(h), self.size), np.uint64)
        for k in range(min(len(h), self.size)):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


class Signer:
    """MinHash samples, their band keys and their odd sketch."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)[:, None]
        self.times = (rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1))[:, None]
        self.times2 = (rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1))[:, None]
        self.salt = rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
        self.band_salt = rng.integers(0, 2**63, BANDS, dtype=np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        h, least = shingles.astype(np.uint32)[None, :], np.full(SAMPLES, 2**32 - 1, np.uint32)
        for at in range(0, h.shape[1], 4096):
            x = h[:, at : at + 4096] ^ self.xor
            x *= self.times
            x ^= x >> np.uint32(15)
            x *= self.times2
            np.minimum(least, x.min(axis=1), out=least)
        return least

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        least = self.samples(shingles).astype(np.uint64)
        key = self.band_salt.copy()
        for k in range(ROWS):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
        bit = _mix(least + self.salt) % np.uint64(SKETCH_BITS)
        odd = (np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
        return key.view(np.int64), np.packbits(odd).tobytes()


def estimate(differing: np.ndarray | float) -> np.ndarray:
    """Similarity from the number of differing bits of two odd sketches."""
    left = np.maximum(1 - 2 * np.asarray(differing, float) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(left)


def most_differing(threshold: float) -> int:
    """Bits in which the sketches of a linked pair may differ, MARGIN deviations of sampling and of folding allowed."""
    balls = 2 * SAMPLES * (1 - threshold)
    spread = math.sqrt(4 * SAMPLES * threshold * (1 - threshold) + 2 * balls * balls / SKETCH_BITS)
    balls = min(balls + MARGIN * spread, 2.0 * SAMPLES)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * balls / SKETCH_BITS)))


def _groups(batches: Iterator[pa.RecordBatch], keys: int, once: int | None = None) -> Iterator[list[tuple]]:
    """Runs of rows with equal first columns, from batches sorted by them; each run is bounded by its blocks.

    Of neighbours in a run that agree in column `once`, only the first counts.
    """
    held, mark = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != mark:
                if held:
                    yield held
                held, mark = [], row[:keys]
            elif once is not None and row[once] == held[-1][once]:
                continue
            held.append(row)
    if held:
        yield held


class _Edges:
    """Pairs of ids, handed on in batches."""

    def __init__(self) -> None:
        self.u: list[int] = []
        self.v: list[int] = []

    def add(self, u: int, v: int) -> None:
        self.u.append(u), self.v.append(v)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.u, pa.int64()), pa.array(self.v, pa.int64())], names=["u", "v"])
        self.u, self.v = [], []
        return out

    def ready(self) -> Iterator[pa.RecordBatch]:
        if len(self.u) >= 10_000:
            yield self.batch()


def _dealt(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    return df.repartition(n_partitions(df.sparkSession), *by).sortWithinPartitions(*by, *order)


def _roles(stars: DataFrame, most: int) -> DataFrame:
    """(id, u, part, role) from pairs (u, v): each star's members, role 1, in parts of about `most`; u, role 0, with their number."""
    parts = stars.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("part"))
    at = F.pmod(F.xxhash64("v", F.lit(79)), F.col("part")).cast("int").alias("part")
    members = stars.join(parts, "u").select(F.col("v").alias("id"), "u", at, F.lit(1).alias("role"))
    return members.union(parts.select(F.col("u").alias("id"), "u", "part", F.lit(0).alias("role")))


def _dealt_roles(roles: DataFrame, *payload: str) -> DataFrame:
    """Rows u, part, role, id, payload by part, in each of which u leads."""
    at = F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("part") - 1)).otherwise(F.array("part")))
    return _dealt(roles.select("u", at.alias("part"), "role", "id", *payload), ["u", "part"], "role", "id")


def _near_first(most: int, ratio: float):
    """Of each part of (u, part, role, id, n, sketch), the pairs with its first row whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Edges()
        for rows in _groups(batches, 2):
            bits = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
            n = np.array([r[4] for r in rows], float)
            near = (np.bitwise_count(bits[1:] ^ bits[0]).sum(axis=1) <= most) & (np.minimum(n[1:], n[0]) >= ratio * np.maximum(n[1:], n[0]))
            for k in np.flatnonzero(near) + 1:
                out.add(rows[0][3], rows[k][3])
            yield from out.ready()
        yield out.batch()

    return run


def _linked_first(percent: int):
    """Of each part of (first, part, role, id, set), the pairs with the set of role 0 that the full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, mark, lead = _Edges(), None, None
        for batch in batches:
            for first, part, role, i, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(packed, np.uint64)
                if role == 0:
                    mark, lead = (first, part), own
                elif (first, part) == mark and 100 * (both := _common(lead, own)) >= percent * (len(lead) + len(own) - both):
                    out.add(first, i)
            yield from out.ready()
        yield out.batch()

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def _several(df: DataFrame, by: list[str]) -> DataFrame:
    """The groups that hold several components."""
    return df.groupBy(*by).agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select(*by)


def _tiles(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (keys, id, component, ...) of each group that holds several components, with what _dealt_tiles() needs.

    Pairs of one component need no comparing. A group's largest component is one side, all other rows the other: others
    meet each other and the largest, whose own rows never meet. A tile is two blocks: kind (0 others, 1 with the
    largest), i, j. Added columns: __b (the row's own block), __big (in the largest), __s, __l (blocks of either side).
    """
    per = df.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("several"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top")).where("several > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select(*keys, F.col("top.component").alias("__top"), blocks(F.col("all") - F.col("top.n")).alias("__s"), blocks(F.col("top.n")).alias("__l"))
    out = df.join(sizes, keys).withColumn("__big", F.col("component") == F.col("__top"))
    out = out.withColumn("__b", F.pmod(F.xxhash64("id", F.lit(77)), F.when(F.col("__big"), F.col("__l")).otherwise(F.col("__s"))).cast("int"))
    return out.drop("__top")


def _dealt_tiles(rows: DataFrame, keys: list[str], *payload: str) -> DataFrame:
    """Each row of _tiles() once in each of its tiles, sorted by tile: keys, kind, i, j, b, big, id, component, payload."""
    to = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    b, s, l = F.col("__b"), F.col("__s"), F.col("__l")  # noqa: E741
    large = F.transform(to(s), lambda i: tile(1, i, b))
    small = F.concat(F.transform(to(s), lambda o: tile(0, F.least(b, o), F.greatest(b, o))), F.transform(to(l), lambda k: tile(1, b, k)))
    out = rows.withColumn("__t", F.explode(F.when(F.col("__big"), large).otherwise(small)))
    out = out.select(*keys, F.col("__t.kind").alias("__kind"), F.col("__t.i").alias("__i"), F.col("__t.j").alias("__j"), "__b", "__big", "id", "component", *payload)
    return _dealt(out, [*keys, "__kind", "__i", "__j"], "id")


def _sides(rows: list[tuple], keys: int) -> tuple[list[tuple], list[tuple]]:
    """The two sides of a tile; the same list twice where a block meets itself."""
    kind, i, j = rows[0][keys : keys + 3]
    if kind == 1:
        return [r for r in rows if not r[keys + 4]], [r for r in rows if r[keys + 4]]
    if i == j:
        return rows, rows
    return [r for r in rows if r[keys + 3] == i], [r for r in rows if r[keys + 3] == j]


def _alike(most: int, ratio: float):
    """Of each tile, a forest of the pairs of different components whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Edges()
        for rows in _groups(batches, 5):
            left, right = _sides(rows, 2)
            if not left or not right:
                continue
            f, same = Forest(), left is right
            bits = np.frombuffer(b"".join(r[10] for r in right), np.uint64).reshape(len(right), -1)
            n, component = np.array([r[9] for r in right], float), np.array([r[8] for r in right])
            for k, row in enumerate(left):
                start = k + 1 if same else 0
                own = np.frombuffer(row[10], np.uint64)
                differ = np.bitwise_count(bits[start:] ^ own).sum(axis=1)
                near = (differ <= most) & (np.minimum(n[start:], row[9]) >= ratio * np.maximum(n[start:], row[9])) & (component[start:] != row[8])
                for m in np.flatnonzero(near) + start:
                    if f.join(row[7], right[m][7]):
                        out.add(row[7], right[m][7])
            yield from out.ready()
        yield out.batch()

    return run


def _linked(percent: int):
    """Of each tile of a family, a forest of the pairs of different components that the full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Edges()
        for rows in _groups(batches, 4, 6):
            left, right = _sides(rows, 1)
            if not left or not right:
                continue
            f, same = Forest(), left is right
            sets = [np.frombuffer(r[8], np.uint64) for r in right]
            n, component = np.array([len(s) for s in sets]), np.array([r[7] for r in right])
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            every, name = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(every), np.int32)
            for k, row in enumerate(left):
                own = np.frombuffer(row[8], np.uint64)
                at = np.searchsorted(every, own)
                at[at == len(every)] = 0
                at = at[every[at] == own]
                start = k + 1 if same else 0
                if start == len(right):
                    break
                mark[at] = 1
                both = np.add.reduceat(mark[name[begin[start] :]], begin[start:] - begin[start])
                mark[at] = 0
                near = (100 * both >= percent * (len(own) + n[start:] - both)) & (component[start:] != row[7])
                for m in np.flatnonzero(near) + start:
                    if f.join(row[6], right[m][6]):
                        out.add(row[6], right[m][6])
            yield from out.ready()
        yield out.batch()

    return run


def minhash_near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: texts linked at 100 * intersection >= percent * union.

    1. Each text gets its set's print, band keys and odd sketch; equal sets collapse into their smallest id.
    2. Sets that share a band form a bucket. Each member is compared with the bucket's first: by sketch, and if that
       allows a link, by full sets. Large groups of near copies join up here, one comparison a member.
    3. In buckets that still hold several components, rows of different components and compatible size meet in blocks,
       by sketch; what may
       link forms families, whose rows of different components are compared by full sets. Blocks return spanning
       forests, never all pairs.
    A text that shares no band with a linked one is missed with the probability given at BANDS; nothing else is.
    Null, empty and blank texts have size 0, stay alone and are kept. Ids are integers (cast to long; what can't be cast
    fails or becomes null by the session's rule). Rows that repeat an id go each with its own text's class; if several
    texts have that id as their smallest, the one of least print stands for all of them.
    """
    spark, ratio, most = docs.sparkSession, percent / 100, most_differing(percent / 100)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def make_signed():
        shingles, sign = Shingler(size), Signer()

        def run(batch: pa.RecordBatch) -> list:
            n, prints, keys, sketches = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                n.append(len(s))
                if not len(s):
                    prints.append(None), keys.append(None), sketches.append(None)
                    continue
                k, sketch = sign(s)
                prints.append(_print(s)), keys.append(k), sketches.append(sketch)
            return [pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]

        return run

    def make_sets():
        shingles = Shingler(size)

        def run(batch: pa.RecordBatch) -> list:
            seen, sets = set(), []
            column = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "print", "text")}
            for i, stands, t in zip(column["id"], column["print"], column["text"], strict=True):
                s = None if i in seen else shingles(t)
                s = s if s is not None and _print(s) == stands else None
                if s is not None:
                    seen.add(i)
                sets.append(None if s is None else s.tobytes())
            return [pa.array(sets, pa.binary())]

        return run

    # text comes back as the sketch or the set made of it, so that no text crosses twice
    fields = [T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("text", T.BinaryType())]
    signed = stored(with_arrow(base, fields, make_signed, 2 << 20).withColumnRenamed("text", "sketch"))
    rep = stored(signed.where("n > 0").groupBy("n", "print").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    several = stored(rep.groupBy("id").agg(F.min("print").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    first = rep.join(several, "id", "left").where("id is not null and (least is null or print = least)").drop("least")  # one text per id

    def with_sets(ids: DataFrame) -> DataFrame:
        """ids (unique id and other columns) with the set of each id's text, the one that stands for it."""
        wanted = stored(ids.join(first.select("id", "print"), "id"))
        # a stored table's size is known, so few ids are broadcast and only their texts move; else both joins share one exchange
        texts = base.join(wanted.select("id"), "id", "left_semi").join(wanted, "id")
        return with_arrow(texts, [T.StructField("text", T.BinaryType())], make_sets, 2 << 20).withColumnRenamed("text", "set").where("set is not null")

    bands = first.select("id", "n", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    met = stored(bands.join(buckets, "key").select("key", "u", "id", "n"))
    sketches = first.select("id", "n", "sketch")

    proposed = stored(met.where("id <> u").select("u", F.col("id").alias("v")).distinct())
    near = _dealt_roles(_roles(proposed, PART).join(sketches, "id"), "n", "sketch")
    stars = stored(near.mapInArrow(_near_first(most, ratio), "u long, v long"))
    discard(proposed)
    places = _roles(stars, BLOCK).groupBy("id").agg(F.collect_list(F.struct("u", "part", "role")).alias("to"))
    sets = with_sets(places).select("id", "set", F.inline("to"))
    star_links = stored(_dealt_roles(sets, "set").mapInArrow(_linked_first(percent), "u long, v long"))
    discard(stars)
    joined = stored(connected_components(star_links))

    placed = stored(met.join(joined, "id", "left").select("key", "id", "n", F.coalesce("component_id", "id").alias("component")))
    discard(met)
    # sizes that can link differ by at most one step of this scale: each row sits in its own step and the next
    scale = math.log(100 / percent) * 1.0001
    step = F.floor(F.log("n") / F.lit(scale)).cast("int")
    stepped = stored(placed.join(_several(placed, ["key"]), "key", "left_semi").select("key", F.explode(F.array(step, step + 1)).alias("step"), "id", "component"))
    discard(placed)
    rest = stepped.join(_several(stepped, ["key", "step"]), ["key", "step"], "left_semi")
    tiles = _tiles(rest, ["key", "step"]).join(sketches, "id")
    pairs = _dealt_tiles(tiles, ["key", "step"], "n", "sketch").mapInArrow(_alike(most, ratio), "u long, v long")
    family = stored(connected_components(pairs.distinct()))
    discard(stepped)
    related = family.select("id", F.col("component_id").alias("family")).join(joined, "id", "left").select("family", "id", F.coalesce("component_id", "id").alias("component"))
    links = _dealt_tiles(with_sets(_tiles(related, ["family"])), ["family"], "set").mapInArrow(_linked(percent), "u long, v long")
    starred, joined = joined, stored(connected_components(star_links.union(links)))
    discard(star_links), discard(family), discard(starred)

    named = rep.select("n", "print", "id").join(joined, "id", "left").select("n", "print", F.coalesce("component_id", "id").alias("component_id"))
    out = signed.select("id", "n", "print").join(named, ["n", "print"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _print(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def drop_near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id stands for its near-duplicate class.

    Rows with a null id stay; rows that repeat one id are one document and stay or go together.
    """
    gone = minhash_near_duplicates(docs, percent, size, id_col, text).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
