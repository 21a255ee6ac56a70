"""URL filters: longest-prefix rules first, then exact membership in a block list by a cascade of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored, with_arrow

#: (verdict, host, path prefix); a rule fits its host and all hosts below it.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Keys of the universe in one shard: bounds the memory in which a cascade is built.
SHARD_KEYS = 500_000
#: Bytes of filters that may be broadcast; beyond, keys meet the filters of their shard in a shuffle.
BROADCAST_BYTES = 64 << 20


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Among equal lengths the one with the longer host wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


@dataclass
class Bloom:
    bits: np.ndarray
    size: int
    probes: int
    salt: int

    @classmethod
    def of(cls, keys: np.ndarray, salt: int, rate: float) -> Bloom:
        n = max(len(keys), 1)
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        made = cls(np.zeros((size + 7) // 8, np.uint8), size, max(1, round(size / n * math.log(2))), salt)
        if len(keys):
            for at in made._places(keys):
                np.bitwise_or.at(made.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return made

    def _places(self, keys: np.ndarray):
        mix = np.uint64((self.salt * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
        a = (keys ^ mix) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(29)
        b = (a * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        for k in range(self.probes):
            yield (((a + np.uint64(k) * b) >> np.uint64(11)) % np.uint64(self.size)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def build_cascade(listed: np.ndarray, others: np.ndarray, first: float = 0.1, later: float = 0.5) -> list[Bloom]:
    """Levels that tell listed hashes from others: each level holds what the level before would get wrong.

    A hash that is both listed and not counts as listed; no level could part it from itself.
    """
    levels, inside, outside = [], np.unique(listed), np.setdiff1d(others, listed)
    while len(inside) or not levels:
        levels.append(Bloom.of(inside, len(levels), first if not levels else later))
        inside, outside = outside[levels[-1].has(outside)], inside
    return levels


def in_cascade(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed: exact for keys of the universe the levels were built from."""
    verdict, live = np.zeros(len(keys), bool), np.arange(len(keys))
    for depth, level in enumerate(levels):
        live = live[level.has(keys[live])]
        verdict[live] = depth % 2 == 0
    return verdict


def hashed(keys, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64)


_LEVEL = "shard int, level int, size long, probes int, bits binary, seed int"


def cascade_filters(universe: DataFrame, key: str = "key", listed: str = "listed") -> tuple[DataFrame, int]:
    """Filter levels per shard of a universe of keys, and the number of shards.

    A key that stands in several rows is listed if one of them says so; null keys are left out. Shards whose listed and
    other keys share a hash take another seed, so that membership is exact.
    """
    known = universe.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.max(F.coalesce(F.col(listed), F.lit(False))).alias("listed"))
    known = stored(known)
    shards = max(1, math.ceil(known.count() / SHARD_KEYS))

    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        inside, seed = rows["listed"].to_numpy(bool), 0
        while len(np.intersect1d((keys := hashed(rows["key"], seed))[inside], keys[~inside])):
            seed += 1
        levels = build_cascade(keys[inside], keys[~inside])
        return pd.DataFrame({"shard": shard[0], "level": range(len(levels)), "size": [x.size for x in levels], "probes": [x.probes for x in levels], "bits": [x.bits.tobytes() for x in levels], "seed": seed})

    sharded = known.withColumn("shard", _shard(F.col("key"), shards))
    filters = stored(sharded.groupBy("shard").applyInPandas(build, _LEVEL))
    discard(known)
    return filters, shards


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(42)), F.lit(shards)).cast("int")


def _levels(rows) -> dict[int, tuple[int, list[Bloom]]]:
    """Seed and filters of each shard."""
    out: dict[int, tuple[int, list[Bloom]]] = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["level"])):
        out.setdefault(r["shard"], (r["seed"], []))[1].append(Bloom(np.frombuffer(r["bits"], np.uint8), r["size"], r["probes"], r["level"]))
    return out


def mark_listed(rows: DataFrame, key: str, universe: DataFrame, out: str = "listed") -> DataFrame:
    """Append whether each row's key is listed in universe(key, listed), which holds every key of rows.

    Exact for those keys (levels go on until nothing is wrong); null keys are not listed. The filters are broadcast
    while they stay within BROADCAST_BYTES; a larger list is settled per distinct key, shard by shard.
    """
    filters, shards = cascade_filters(universe)
    total = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    if total > BROADCAST_BYTES:
        def settle(shard: tuple, keys: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
            seed, mine = _levels(levels.to_dict("records")).get(shard[0], (0, []))
            return pd.DataFrame({"key": keys["key"], out: in_cascade(mine, hashed(keys["key"], seed))})

        keys = universe.where(F.col("key").isNotNull()).select(F.col("key").cast("string").alias("key")).distinct().withColumn("shard", _shard(F.col("key"), shards))
        verdicts = keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(settle, f"key string, {out} boolean")
        kept = [c for c in rows.columns if c != out]
        return rows.select(*kept).join(verdicts.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left").select(*kept, F.coalesce(out, F.lit(False)).alias(out))
    shared = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in filters.collect()])

    def make():
        levels = _levels(shared.value)

        def run(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
            names, shard = column.dictionary.to_pylist(), batch.column(batch.schema.get_field_index("__shard")).to_numpy(zero_copy_only=False)
            at = column.indices.to_numpy(zero_copy_only=False)
            verdict = np.zeros(batch.num_rows, bool)
            there = np.asarray(column.is_valid())
            hashes = {seed: hashed((n or "" for n in names), seed) for seed in {seed for seed, _ in levels.values()}}
            for s, (seed, cascade) in levels.items():
                here = np.flatnonzero(there & (shard == s))
                verdict[here] = in_cascade(cascade, hashes[seed][at[here].astype(np.int64)])
            return [pa.array(verdict)]

        return run

    sharded = rows.withColumn("__shard", F.coalesce(_shard(F.col(key), shards), F.lit(-1)))
    return with_arrow(sharded, [T.StructField(out, T.BooleanType())], make).drop("__shard")


def filter_urls(pages: DataFrame, block_list: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Append host, path, rule and verdict to pages.

    The longest rule that fits decides. Where none fits, the verdict is block for hosts on block_list(host), allow for
    others. The distinct hosts of these pages are the universe of the filters; listed hosts that no page has are left
    out, repeated and null ones are harmless. Null urls and urls without :// have an empty host and path. Columns of
    these names are replaced.
    """
    own = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in own]
    parsed = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    # one aggregation sets both apart: hosts of pages, and of these the listed
    sides = parsed.select("host", F.lit(True).alias("met"), F.lit(False).alias("listed")).union(block_list.select("host", F.lit(False), F.lit(True)))
    universe = stored(sides.groupBy(F.col("host").alias("key")).agg(F.max("met").alias("met"), F.max("listed").alias("listed")).where("met").drop("met"))
    marked = mark_listed(parsed, "host", universe, "__listed")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return marked.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"))
