"""Quality rules in SQL functions: base counts, then a cascade ordered by rejection per cost on a sample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

SYMBOLS = "#*$%&|<>"
#: Signs of Java's and RE2's whitespace class above.
_SPACE_CHARS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """fails(measures, text) is true for texts to reject; work(measures, text) is what that takes, in code points looked at."""

    name: str
    fails: Callable[..., Column]
    work: Callable[..., Column] = lambda m, t: F.lit(1.0)


def n_code_points_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]")), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(found: Column, window: int = 5) -> Column:
    """Words inside windows of `window` words that occur at least twice in the array, the first occurrence included.

    Windows are compared by 64-bit hashes of word hashes. Texts without a repeat cost one pass; others sort their
    windows and add up the words that the repeated ones cover.
    """

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        starts = F.sequence(F.lit(0), n - window)
        return let(F.when(n >= window, F.transform(starts, lambda i: F.xxhash64(*[h[i + k] for k in range(window)]))).otherwise(F.array().cast("array<bigint>")), of_windows)

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(F.transform(s, lambda x, i: F.when(((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["w"] == x["w"])) | ((i < last) & (s[F.least(i + 1, last)]["w"] == x["w"])), x["at"])), lambda x: x.isNotNull())
        return let(F.array_sort(twice), covered)

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(10**6)).alias("end"))
        return F.aggregate(at, start, lambda acc, x: F.struct((acc["n"] + (x + window - F.greatest(acc["end"], x)).cast("long")).alias("n"), (x + window).alias("end")), lambda acc: acc["n"])

    return let(F.transform(found, lambda x: F.xxhash64(x)), of_hashes)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed. Null texts count as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("r")))
    made = docs.withColumn("__w", of_words)
    out = made.withColumns({
        "n_words": F.col("__w.n"), "word_chars": n_code_points_without(t, _SPACE_CHARS).cast("long"),
        "n_symbols": (F.length(t) - n_code_points_without(t, SYMBOLS)).cast("long"), "n_dup_lines": n_dup_lines(t), "n_repeat_words": F.col("__w.r"),
    }).drop("__w")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


#: A code point that a pattern looks at costs about as much as this many that a plain scan passes.
_PATTERN = 8.0

#: What the cascade rejects beyond the base: shares are of words or of characters of words.
RULES = (
    Rule("long_words", lambda m, t: m["word_chars"] > 60 * m["n_words"]),
    Rule("short_words", lambda m, t: m["word_chars"] < 2 * m["n_words"]),
    Rule("symbols", lambda m, t: 10 * m["n_symbols"] > 3 * m["word_chars"]),
    Rule("dup_lines", lambda m, t: 10 * m["n_dup_lines"] > 5 * (F.length(t) - F.length(F.translate(t, "\n", "")) + 1), lambda m, t: 3.0 * F.length(t)),
    Rule("no_letters", lambda m, t: ~t.rlike(r"\p{L}"), lambda m, t: _PATTERN * (F.length(F.regexp_extract(t, r"^[^\p{L}]*+", 0)) + 1)),
    Rule("few_letters", lambda m, t: 2 * F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) < m["word_chars"], lambda m, t: _PATTERN * F.length(t)),
)

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Ranked:
    rule: Rule
    cost: float
    rejected: float


def order_rules(measured: DataFrame, rules=RULES, text: str = "text", sample: int = 2000, id_col: str = "doc_id") -> list[Ranked]:
    """Rules by share rejected per cost, the best first, from about `sample` rows chosen by a hash of id and text.

    A rule's cost is the mean of its work over the sample and its selectivity the share that it rejects; one job takes
    both for all rules, and the same rows always give the same order, where clocks would mostly measure the start of
    jobs. The sample decides the order of evaluation only, never a verdict. Rules that reject nothing come last, the
    cheap first; without rows the rules keep their order.
    """
    n = measured.count()
    if not n:
        return [Ranked(r, 0.0, 0.0) for r in rules]
    part = measured.where(F.pmod(F.xxhash64(id_col, text, F.lit(6)), F.lit(max(1, n // sample))) == 0).select(*_COUNTS, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    m, t = {c: F.col(c) for c in _COUNTS}, F.col("__t")
    each = [x for k, r in enumerate(rules) for x in (F.avg(r.work(m, t)).alias(f"c{k}"), F.avg(F.when(r.fails(m, t), 1.0).otherwise(0.0)).alias(f"r{k}"))]
    found = part.agg(*each).first() if each else {}
    ranked = [Ranked(r, found[f"c{k}"] or 0.0, found[f"r{k}"] or 0.0) for k, r in enumerate(rules)]
    return sorted(ranked, key=lambda r: (-(r.rejected / max(r.cost, 1e-6)), r.cost, r.rule.name))


def quality_verdicts(docs: DataFrame, rules=RULES, text: str = "text", id_col: str = "doc_id", sample: int = 2000) -> DataFrame:
    """Append the measures, base_failed, failed_rule (the first of the cascade, else null) and kept.

    kept is false where the base fails, else true if no rule fails. Rules run in the order of order_rules inside one
    CASE, so a text pays only up to its first failure; any order gives the same kept. Columns of these names are replaced.
    """
    ordered = [r.rule for r in order_rules(measures(docs, text), rules, text, sample, id_col)]
    measured = measures(docs, text)
    m, t = {c: F.col(c) for c in _COUNTS}, F.coalesce(F.col(text).cast("string"), F.lit(""))
    first = F.when(F.col("base_failed"), "base")
    for rule in ordered:
        first = first.when(rule.fails(m, t), rule.name)
    return measured.withColumn("failed_rule", first).withColumn("kept", F.col("failed_rule").isNull())
