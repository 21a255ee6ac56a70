"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow

UNKNOWN = "und"
_SHARE = 1 << 20
#: Code points that are looked at together; longer texts go through in such parts, without any effect on the result.
_CHUNK = 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class LanguageModel:
    """table holds a row per bucket: scores of languages, or embeddings that `out` turns into scores."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray | None = field(default=None)
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.out is None else mean @ self.out) + self.bias


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _B
    return ((h ^ (h >> np.uint64(32))) & np.uint64(buckets - 1)).astype(np.int64)


def subword_parts(text: str, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, places) of the subwords of a lower-cased text: its runs of letters and, with their ends marked, all
    pieces of two and three signs of them. A place is that of a letter plus one. buckets is a power of two.

    Long texts come in parts of _CHUNK code points; a word that goes on in the next part is carried over as the sum of
    its signs so far, so that the parts together hold exactly what the whole text holds, in bounded memory.
    """
    whole, size = f" {text} ", len(text) + 2
    since, summed, first = 0, np.uint64(0), 0  # of the word that is open at the start of a part: length, sum, place
    for low in range(0, size - 1, _CHUNK):
        high = min(low + _CHUNK, size - 1)  # this part owns the signs from low up to high; one more on each side is seen
        code = np.frombuffer((" " * (low == 0) + whole[max(low - 1, 0) : high + 1]).encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter()[code]
        c = np.where(letter, code, 0).astype(np.uint64)
        own = letter[1:-1]
        two = np.flatnonzero(own | letter[2:]) + 1
        three = np.flatnonzero(own) + 1
        if not len(two):
            continue
        h2 = c[two] * _A + c[two + 1] * _C + np.uint64(1)
        h3 = c[three - 1] * _A + c[three] * _C + c[three + 1] * _B + np.uint64(2)
        start = np.flatnonzero(own & ~letter[:-2])
        open_ = bool(letter[0] and len(own) and own[0])
        begins = np.concatenate([[0], start]) if open_ else start
        words, places = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(begins):
            at = np.arange(len(own), dtype=np.uint64)
            run = np.zeros(len(own), np.uint64)
            run[start] = start
            run = np.maximum.accumulate(run)
            since_start = at - run
            if open_:
                head = int(start[0]) if len(start) else len(own)
                since_start[:head] += np.uint64(since)
            signs = (c[1:-1] * _A + np.uint64(1)) ^ (since_start * _C)
            signs = np.where(own, (signs ^ (signs >> np.uint64(31))) * _B, np.uint64(0))
            sums = np.add.reduceat(signs, begins)
            places = begins + low
            if open_:
                sums[:1] += summed
                places[0] = first
            if own[-1] and letter[-1]:  # the last word goes on
                since, summed, first = int(since_start[-1]) + 1, sums[-1], int(places[-1])
                sums, places = sums[:-1], places[:-1]
            words = sums + np.uint64(3)
        yield (
            np.concatenate([_bucket(h, buckets) for h in (words, h2, h3)]),
            np.concatenate([places, np.where(letter[two], two, two + 1) + (low - 1), three + (low - 1)]),
        )


def subwords(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """subword_parts of a text in one piece."""
    parts = list(subword_parts(text, buckets))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.zeros(buckets, np.int64)
    for ids, _ in subword_parts(text.lower(), buckets):
        n += np.bincount(ids, minlength=buckets)
    at = np.flatnonzero(n)
    return at, n[at] / max(n.sum(), 1)


def train_languages(texts: list[str], langs: list[str], buckets: int = 1 << 15, dim: int | None = None, epochs: int = 6, rate: float = 0.5, seed: int = 7, coverage: float = 0.99) -> LanguageModel:
    """Stochastic gradient descent over whole texts and their single lines; a tenth calibrates.

    Calibration picks the temperature of least log loss and the confidence below which `coverage` of that tenth's
    right answers would be lost. No texts give a model without languages; one language is always right. dim is 16, or
    half the number of languages if that is more, up to 128.
    """
    names = sorted(set(langs))
    dim = dim or min(128, max(16, len(names) // 2))
    rows = []
    for t, lang in zip(texts, langs, strict=True):
        y = names.index(lang)
        for part in dict.fromkeys([t, *sorted(t.split("\n"), key=len)[-2:]]):
            at, share = _counts(part, buckets)
            if len(at):
                rows.append((zlib.crc32(part.encode()) % 10 == 0, y, at, share))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (buckets, dim))
    w, b = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    taught = {r[1] for r in rows if not r[0]}  # a language whose texts would all calibrate learns from them
    learn, hold = [r for r in rows if not r[0] or r[1] not in taught], [r for r in rows if r[0] and r[1] in taught]
    size = np.bincount([r[1] for r in learn], minlength=max(len(names), 1)) if learn else np.ones(1)
    weight = np.minimum(size.sum() / np.maximum(size, 1) / max(len(names), 1), 10.0)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(learn)):
            _, y, at, share = learn[k]
            lr, done = rate * (1 - done / steps) * weight[y], done + 1
            v = share @ e[at]
            z = v @ w + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = w @ g
            w -= lr * np.outer(v, g)
            b -= lr * 0.1 * g
            e[at] -= lr * 10 * share[:, None] * back
    few = len(names) <= dim
    model = LanguageModel(names, (e @ w if few else e).astype(np.float32), b, None if few else w)
    if hold and len(names) > 1:
        z = np.array([model.scores(share @ model.table[at]) for _, _, at, share in hold])
        y = np.array([r[1] for r in hold])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min((0.05 * 1.25**k for k in range(28)), key=loss)
        s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        s /= s.sum(axis=1, keepdims=True)
        right = np.sort(s.max(axis=1)[s.argmax(axis=1) == y])
        if len(right):
            model.reject_below = float(right[int((1 - coverage) * len(right))]) * 0.999
    return model


#: Texts that a language is learnt from, if it has them, however many languages there are.
LEAST_TEXTS = 20


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", only: Column | None = None, per_language: int = 400, most_texts: int = 20_000, most_chars: int = 20_000) -> LanguageModel:
    """Learn every language from about per_language of its whole texts, chosen by a hash of id and text.

    The bounds are of learning rows only: if per_language gave more than about most_texts in all, each language has
    fewer, though not under LEAST_TEXTS; learning texts have at most most_chars code points, but a language without such
    a text learns from its shortest ones. So the driver holds at most about most_texts * most_chars code points. Rows
    that repeat id, text and language count once. Null languages and texts teach nothing. Predictions read every text.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if only is not None:
        known = known.where(only)
    known = known.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"), F.length(text).alias("__size"))
    per = known.groupBy("__lang").agg(F.count_if(F.col("__size") <= most_chars).alias("short"), F.min("__size").alias("least"))
    sizes = per.orderBy("__lang").collect()  # a row per language
    if not sizes:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0))
    spark = docs.sparkSession
    per_language = min(per_language, max(LEAST_TEXTS, most_texts // len(sizes)))
    part = [(r["__lang"], min(_SHARE, int(np.ceil(per_language * _SHARE / max(r["short"], 1)))), max(most_chars, r["least"])) for r in sizes]
    rows = known.join(F.broadcast(spark.createDataFrame(part, "__lang string, __share long, __most int")), "__lang")
    rows = rows.where((F.col("__size") <= F.col("__most")) & (F.pmod(F.xxhash64("__id", "__text", F.lit(5)), F.lit(_SHARE)) < F.col("__share")))
    rows = rows.select("__id", "__text", "__lang").distinct().collect()
    rows.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    return train_languages([r[1] for r in rows], [r[2] for r in rows])


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Append lang_pred, score (calibrated probability) and rejected.

    Null texts, texts without a letter, and all texts under a model without languages: und, 0.0, rejected.
    rejected marks answers below the calibrated confidence; lang_pred still names the likeliest language.
    """

    def make():
        (buckets, width), n = model.table.shape, len(model.languages)
        columns = np.ascontiguousarray(model.table.T)

        def answers(texts: list[str | None]) -> list[tuple]:
            """Texts in groups of about a chunk, each place summed to its text."""
            total, number = np.zeros((len(texts), width)), np.zeros(len(texts))
            group: list[str] = []
            owner: list[int] = []

            def add() -> None:
                ends = np.cumsum([len(t) + 1 for t in group])
                low, high, owners = owner[0], owner[-1] + 1, np.array(owner)
                for ids, at in subword_parts(" ".join(group), buckets):
                    text_of = owners[np.searchsorted(ends, at - 1, side="right")] - low
                    number[low:high] += np.bincount(text_of, minlength=high - low)
                    for k in range(width):
                        total[low:high, k] += np.bincount(text_of, weights=columns[k][ids], minlength=high - low)
                group.clear(), owner.clear()

            held = 0
            for k, text in enumerate(texts):
                if not text:
                    continue
                group.append(text.lower()), owner.append(k)
                held += len(text)
                if held > _CHUNK or len(group) >= 64:
                    add()
                    held = 0
            if group:
                add()
            out = []
            for k in range(len(texts)):
                if not n or not number[k]:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                z = model.scores(total[k] / number[k]) / model.temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                best = int(p.argmax())
                out.append((model.languages[best], float(p[best]), bool(p[best] < model.reject_below)))
            return out

        def run(batch: pa.RecordBatch) -> list:
            found = answers(batch.column(batch.schema.get_field_index(text)).to_pylist())
            kinds = (pa.string(), pa.float64(), pa.bool_())
            return [pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds)]

        return run

    return with_arrow(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())], make)
