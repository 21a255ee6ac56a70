"""Byte-level BPE by padded numpy matrices: each round merges the leftmost least-rank pair of every row."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_arrow

_NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this take the queue: a matrix of one round per merge would cost their length squared.
_WIDEST = 256
#: Pieces whose ids a task keeps; the store is emptied at this size, which bounds its memory.
_KEPT = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def python_pattern(pattern: str) -> str:
    r"""The pattern for the regex module: its \s also takes U+001C to U+001F, which Unicode's White_Space leaves out."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class BytePairs:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(python_pattern(pattern)).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    left.append(a), right.append(b), out.append(rank)
        self._hash_table(np.array(left, np.int64), np.array(right, np.int64), np.array(out, np.int32))
        self.pairs = None
        self.kept: dict[str, bytes] = {}

    def _hash_table(self, left: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
        """Open addressing over a power of two; _probes is the longest run to look at."""
        self._shift = np.uint64(64 - max(4, int(2 * max(len(out), 1) - 1).bit_length() + 1))
        size = 1 << (64 - int(self._shift))
        keys = (left << 32) | right
        self._keys, self._ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._slot(keys[todo]) + step) & (size - 1)
            free = self._keys[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            took = np.flatnonzero(free)[first]
            self._keys[at[took]], self._ranks[at[took]] = keys[todo[took]], out[todo[took]]
            todo, step = np.delete(todo, took), step + 1
        self._probes = max(step, 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or the largest integer where they don't merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, mask = self._slot(keys), len(self._keys) - 1
        out = np.full(keys.shape, _NONE, np.int32)
        for step in range(self._probes):
            here = (at + step) & mask
            hit = self._keys[here] == keys
            out[hit] = self._ranks[here[hit]]
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length. Rows that can't merge leave; columns shrink with the longest row."""
        n = np.array([len(p) for p in pieces])
        width = int(n.max())
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.byte[flat]
        ranks = np.full((len(pieces), width), _NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(width)[None, :] >= (n - 1)[:, None]] = _NONE
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            over = best == _NONE
            if over.any():
                for k in np.flatnonzero(over):
                    out[row[k]] = ids[k, : n[k]].copy()
                live = ~over
                if not live.any():
                    return out
                row, n, at, best = row[live], n[live], at[live], best[live]
                width = int(n.max())
                ids, ranks = ids[live, :width], ranks[live, :width]
            r = np.arange(len(row))
            ids[r, at] = best
            move = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            move[:, -1] = np.minimum(move[:, -1], width - 1)
            ids = np.take_along_axis(ids, move, 1)
            ranks = np.take_along_axis(ranks, move, 1)
            n = n - 1
            ranks[r, n - 1] = _NONE
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < n)
                ranks[r[ok], left[ok]] = self.pair_ranks(ids[r[ok], left[ok]], ids[r[ok], left[ok] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same rule for one long piece: a queue of pairs by rank, then place."""
        if self.pairs is None:
            used = self._keys >= 0
            self.pairs = dict(zip(self._keys[used].tolist(), self._ranks[used].tolist(), strict=True))
        pairs, ids = self.pairs.get, self.byte[np.frombuffer(piece, np.uint8)].tolist()
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(rank, k) for k in range(end - 1) if (rank := pairs((ids[k] << 32) | ids[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            nxt = after[k]
            if ids[k] < 0 or nxt >= end or pairs((ids[k] << 32) | ids[nxt]) != rank:
                continue
            ids[k], ids[nxt], after[k] = rank, -1, after[nxt]
            if after[k] < end:
                before[after[k]] = k
            for p in (before[k], k):
                if p >= 0 and after[p] < end and (new := pairs((ids[p] << 32) | ids[after[p]])) is not None:
                    heapq.heappush(queue, (new, p))
        return np.array([i for i in ids if i >= 0], np.int32)

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces not seen before, in buckets of doubling width."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.kept[piece] = whole.to_bytes(4, "little")
            elif len(raw) > _WIDEST:
                self.kept[piece] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, rows in buckets.items():
            step = max(1, (1 << 20) >> bits)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for (piece, _), ids in zip(part, self.merge_matrix([raw for _, raw in part]), strict=True):
                    self.kept[piece] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.kept) > _KEPT:
            self.kept.clear()
        split = [self.split(t) if t else [] for t in texts]
        self.learn({p for row in split for p in row if p not in self.kept})
        get = self.kept.__getitem__
        return [b"".join(map(get, row)) for row in split]

    def decode(self, packed: list[bytes | None]) -> list[bytes]:
        """The bytes that packed ids stand for; an id outside the table raises KeyError."""
        get = self.token.__getitem__
        return [b"".join(map(get, np.frombuffer(p or b"", "<u4").tolist())) for p in packed]


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """Append packed ids (binary, little-endian unsigned 32-bit) and their number.

    Null and empty texts get no ids; a text is never cut, and a column of the same name is replaced.
    Every executor reads ranks_path, which is part of the installation.
    """

    def make():
        pairs = BytePairs(read_ranks(ranks_path), pattern)

        def run(batch: pa.RecordBatch) -> list:
            packed = pairs.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]

        return run

    return with_arrow(df, [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())], make, 1 << 20)


def bpe_decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Append the bytes that the packed ids stand for; null ids decode to no bytes."""

    def make():
        table = {rank: token for token, rank in read_ranks(ranks_path).items()}
        get = table.__getitem__

        def run(batch: pa.RecordBatch) -> list:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            return [pa.array([b"".join(map(get, np.frombuffer(p or b"", "<u4").tolist())) for p in rows], pa.binary())]

        return run

    return with_arrow(df, [T.StructField(decoded, T.BinaryType())], make, 2 << 20)
