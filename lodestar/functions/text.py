"""Folding, word splitting, trigrams and edit distance as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that are not a letter plus an accent, and where one word ends inside a run.
SPECIAL_LETTERS = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ı": "i"}
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

NOT_WORD = r"[^\p{L}\p{N}]+"
#: The last code point whose several-letter folds are done by replacement; rarer ones go to fold_exact.
_LATIN = 0x024F


def fold_text(text: str) -> str:
    """The rule itself: special letters, compatibility decomposition, no combining marks."""
    plain = text.translate(str.maketrans(SPECIAL_LETTERS))
    return "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))


@cache
def _tables(special: bool) -> tuple[str, str, dict[str, str]]:
    """From the rule: letters to letters, letters that go, and letters that become several."""
    source, target, gone, several = [], [], [], {}
    for point in range(0x80, 0x20000):
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xD7A4:
            continue
        c = chr(point)
        if special:
            f = fold_text(c)
        else:
            f = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if f == c:
            continue
        if not f:
            gone.append(c)
        elif len(f) == 1:
            source.append(c), target.append(f)
        else:
            several[c] = f
    return "".join(source + gone), "".join(target), several


def fold(text: Column) -> Column:
    """Accents off, special letters plain. Native; letters that fold to several are covered up to Latin Extended-B and
    Latin ligatures. fold_exact covers all."""
    source, target, several = _tables(True)
    latin = {c: f for c, f in several.items() if ord(c) <= _LATIN or 0xFB00 <= ord(c) <= 0xFB06}
    plain = F.translate(text, source, target)
    spelled = text
    for c, f in latin.items():
        spelled = F.replace(spelled, F.lit(c), F.lit(f))
    odd = "[" + "".join(latin) + "]"
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).when(text.rlike(odd), F.translate(spelled, source, target)).otherwise(plain)


@F.pandas_udf(T.StringType())
def _fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


def fold_exact(text: Column) -> Column:
    """As fold, but texts with letters of other scripts that fold to several pass through Arrow."""
    _, _, several = _tables(True)
    odd = "".join(c for c in several if ord(c) > _LATIN)
    rare = text.rlike(f"[{odd}가-힣]|[^\u0000-\U0001ffff]")
    return F.when(rare, _fold_all(F.when(rare, text))).otherwise(fold(text))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use reads it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column, pattern: str = NOT_WORD) -> Column:
    return F.filter(F.split(text, pattern), lambda w: w != "")


def split_words(text: Column) -> Column:
    """Lower-case words of a name or sentence: folded, cut at camel case and at all but letters and digits. Null gives none."""
    cut = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), CAMEL, " ")
    return words_of(F.lower(cut))


def index_tokens(text: Column) -> Column:
    """Tokens of raw content: letters and digits in runs, accents off, lower case; no camel case, no special letters."""
    source, target, _ = _tables(False)
    text = F.coalesce(text, F.lit(""))
    return words_of(F.lower(F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(F.translate(text, source, target))))


def trigrams(word: Column) -> Column:
    """Distinct pieces of three letters in order of place; none for shorter words."""
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda k: F.substring(word, k, F.lit(3)))
    return F.when(F.length(word) >= 3, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def edit_distance(a: Column, b: Column, limit: int = 3) -> Column:
    """Optimal string alignment (insert, delete, replace, swap of neighbours), limit + 1 where it is larger. Null for nulls."""

    def row(acc: Column, i: Column) -> Column:
        ca = F.substring(a, i, F.lit(1))

        def cell(line: Column, j: Column) -> Column:
            cb = F.substring(b, j, F.lit(1))
            change = acc["last"][j - 1] + F.when(ca == cb, 0).otherwise(1)
            best = F.least(acc["last"][j] + 1, line[j - 1] + 1, change)
            swapped = (i > 1) & (j > 1) & (ca == F.substring(b, j - 1, F.lit(1))) & (F.substring(a, i - 1, F.lit(1)) == cb)
            best = F.when(swapped, F.least(best, acc["before"][F.greatest(j - 2, F.lit(0))] + 1)).otherwise(best)
            return F.concat(line, F.array(best))

        line = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell)
        return F.struct(acc["last"].alias("before"), line.alias("last"))

    first = F.sequence(F.lit(0), F.length(b))
    start = F.struct(first.alias("before"), first.alias("last"))
    full = F.aggregate(F.sequence(F.lit(1), F.length(a)), start, row, lambda acc: F.element_at(acc["last"], -1))
    far = F.abs(F.length(a) - F.length(b)) > limit
    near = F.levenshtein(a, b) <= 2 * limit  # a swap costs two there
    return (
        F.when(a.isNull() | b.isNull(), None).when(a == b, 0).when(far | ~near, limit + 1)
        .when((F.length(a) == 0) | (F.length(b) == 0), F.least(F.length(a) + F.length(b), F.lit(limit + 1)))
        .otherwise(F.least(full, F.lit(limit + 1)))
    )
