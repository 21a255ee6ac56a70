"""Toxicity by a weighted lexicon: folded text, Aho-Corasick, exception phrases, length-normalised score."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow

#: Whole words that are insults in themselves; learning adds to them and reweighs them.
SEED_WORDS = ("idiot", "moron", "loser", "scum", "stupid", "pathetic", "worthless", "disgusting", "imbecile", "dumbass")
#: Phrases in which a listed word is harmless: a hit inside one doesn't count.
EXCEPTIONS = ("pathetic fallacy", "clown fish", "class clown", "trash can", "trash bin", "trash bag", "pond scum", "loser bracket", "stupid simple")

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухіјѕԁӏһѵαβεικνορτυχ", "aeopcyxijsdlhvabeiknoptux", strict=True))
#: Digits and signs that stand for letters, when they touch a letter.
_LEET = dict(zip("013457@$!", "oieastasi", strict=True))
#: Wide, mathematical and circled letters are those that they are compatible with.
_STYLED = {chr(c): n.lower() for a, b in ((0xFF21, 0xFF5B), (0x1D400, 0x1D6A6), (0x24B6, 0x24EA), (0x2100, 0x2140)) for c in range(a, b) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii() and n.isalpha()}
#: Signs without width, which only break words up.
_UNSEEN = dict.fromkeys(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)))
_LETTERS = str.maketrans(_LOOKALIKES | _STYLED | _UNSEEN)
#: Between letters, or before one: "1d10t", "$tupid"; runs such as "***" or "!!" after a word stay signs.
_INSIDE = re.compile(r"(?<![0-9@$!])(?:[0-9@$]{1,3}|!)(?=[^\W\d_])|(?<=[^\W\d_])[013457](?![^\W_])")
_GAPS = re.compile(r"[\W\d_]+")
_LEET_TABLE = str.maketrans(_LEET)


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as letters, all else one space; a space at both ends."""
    t = text.lower().translate(_LETTERS) if not text.isascii() else text.lower()
    t = _INSIDE.sub(lambda m: m[0].translate(_LEET_TABLE), t)
    return " " + _GAPS.sub(" ", t).strip() + " "


@dataclass
class Lexicon:
    """weights: " word " is a whole word, " stem" a beginning. The score is a logistic of weight per length."""

    weights: dict[str, float] = field(default_factory=lambda: {f" {w} ": 4.0 for w in SEED_WORDS})
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 40.0
    offset: float = -2.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            a.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        a.make_automaton()
        return a


#: Words added to a text's own before its weight is divided by them, so that one word makes no whole text.
_LEAST_WORDS = 50


def density(matcher: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Summed weight per word of the text, and the number of hits that count."""
    if not len(matcher):
        return 0.0, 0
    hits, free = [], []
    for end, (size, weight) in matcher.iter(folded):
        (hits if weight else free).append((end - size + 1, end, weight))
    if free:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in free)]
    n = folded.count(" ") - 1
    return sum(w for *_, w in hits) / (_LEAST_WORDS + n), len(hits)


def _patterns(words: Iterable[str]) -> set[str]:
    """The whole words, and their beginnings."""
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in (4, 5, 6) if len(w) > k}


def _contexts(folded: Iterable[str], wanted: set[str]) -> Counter:
    """In how many different pairs of neighbours each pattern stands: copies of one passage count once."""
    seen: dict[str, set[int]] = {p: set() for p in wanted}
    for text in folded:
        w = ["", *text.split(), ""]
        for before, word, after in zip(w, w[1:], w[2:], strict=False):
            if here := _patterns((word,)) & wanted:
                around = zlib.crc32(f"{before} {after}".encode())
                for p in here:
                    seen[p].add(around)
    return Counter({p: len(x) for p, x in seen.items()})


def learn_lexicon(texts: Iterable[str | None], toxic: Iterable[int], least: int = 5, ratio: float = 3.0) -> Lexicon:
    """Lexicon and score from labelled texts.

    A pattern enters with at least `least` different contexts in toxic texts and a log odds ratio above `ratio`, so
    that copies of one text prove nothing; a beginning only if it covers several words, and what a shorter accepted beginning covers is left out. With one class missing the seed stays.
    """
    folded = [fold(t or "") for t in texts]
    y = np.array([int(bool(v)) for v in toxic])
    lexicon = Lexicon()
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return lexicon
    texts_of = [[t for t, v in zip(folded, y, strict=True) if v == k] for k in (0, 1)]
    bad = Counter(p for t in texts_of[1] for p in _patterns(set(t.split())))
    family = Counter(p[: 1 + k] for p in bad if p.endswith(" ") for k in (4, 5, 6))
    bad = Counter({p: n for p, n in bad.items() if n >= 3})
    fine = Counter(p for t in texts_of[0] for p in _patterns(set(t.split())) if p in bad)

    harmful, harmless = ({p: c[p] for p in lexicon.weights} for c in (bad, fine))

    def log_odds(p: str) -> float:
        return math.log((bad[p] + 0.5) / (n1 + 1)) - math.log((fine[p] + 0.5) / (n0 + 1))

    # first by texts, to leave common words out; what is left by contexts, of either class
    likely = {p for p in bad if log_odds(p) > ratio / 2}
    bad = Counter({p: n for p, n in _contexts(texts_of[1], likely).items() if n >= least})
    fine = _contexts(texts_of[0], set(bad))
    odds = {p: log_odds(p) for p in bad}
    good = {p for p, o in odds.items() if o > ratio}
    stems = {p for p in good if not p.endswith(" ") and family[p] >= 4}
    chosen = {p for p in good if p in stems or p.endswith(" ")}
    chosen = {p for p in chosen if not any(p[:k] in stems for k in range(5, min(len(p), 8)) if p[:k] != p)}
    for p in [p for p in lexicon.weights if harmless[p] > harmful[p]]:
        del lexicon.weights[p]  # its own labels call this seed word harmless
    lexicon.weights |= {p: min(odds[p], 8.0) for p in sorted(chosen)}
    matcher = lexicon.automaton()
    x = np.array([density(matcher, t)[0] for t in folded])
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)  # both classes count alike; the sample is stratified
    a, b = 20.0, -2.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * share * x).sum() + 1e-4 * a, ((p - y) * share).sum()])
        w = share * p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-4, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-6:
            break
    lexicon.slope, lexicon.offset = float(a), float(b)
    return lexicon


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", only: Column | None = None, per_class: int = 1500, most_chars: int = 50_000) -> Lexicon:
    """Learn from at most per_class labelled texts of each class, the first by a hash of the id; `only` limits the ids.

    The bounds are of learning rows only: texts of more than most_chars code points teach nothing, so that the driver
    holds at most 2 * per_class * most_chars code points. Conflicting labels of one id count as the larger, of several
    texts of one id the first in order counts; null labels and ids without a text don't count.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if only is not None:
        known = known.where(only)
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label)).cast("int").alias("__y"))
    part = [known.where(F.col("__y") == v).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for v in (1, 0)]
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    texts = texts.where(F.length("__text") <= most_chars)
    rows = texts.join(F.broadcast(part[0].union(part[1])), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).select("__id", "__text", "__y").collect()
    rows.sort(key=lambda r: str(r[0]))
    return learn_lexicon([r[1] for r in rows], [r[2] for r in rows])


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", names: tuple[str, str, str] = ("score", "predicted", "hits")) -> DataFrame:
    """Append score (0 to 1), predicted (1 from 0.5 up) and hits. Null and empty texts get the score of no hit."""

    def make():
        matcher = lexicon.automaton()

        def run(batch: pa.RecordBatch) -> list:
            scores, hits = [], []
            for t in batch.column(batch.schema.get_field_index(text)):
                d, n = density(matcher, fold(t.as_py() or ""))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.slope * d + lexicon.offset)))))
                hits.append(n)
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(hits, pa.int64())]

        return run

    kinds = (T.DoubleType(), T.IntegerType(), T.LongType())
    return with_arrow(docs, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], make)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The rows of docs that the lexicon doesn't call toxic, with their own columns."""
    names = ("__score", "__predicted", "__hits")
    return score_toxicity(docs, lexicon, text, names).where("__predicted = 0").drop(*names)
