"""Personal data in SQL functions: four base patterns, then terms that the corpus shows to reveal an entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, stored

_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: Kinds in the order that breaks ties. Possessive repeats and the look-behinds find the same matches as the plain
#: patterns, in time linear in the text: a run of local characters is only tried from its start or a match's end, and
#: runs of fewer than 12 digits, which can't pass as cards, aren't matched at all.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_TERM_CHARS = r"\p{L}\p{N}'-"
TERM = "term"
#: Entries up to which a list of terms, or of documents with theirs, is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000

_SPAN = "struct<s:int,k:int,e:int,m:string>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, x: Column) -> Column:
        d = x["d"]
        return acc + F.when(x["i"] % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    pairs = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(F.coalesce(d.try_cast("int"), F.lit(0)).alias("d"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: x.rlike(_BYTE)),
    "card": lambda m: let(F.regexp_replace(m, r"[\x20-]", ""), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15),
}
#: Cheap conditions without which a kind can't occur.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Prefix results of an associative function along an array, by doubling: n log n steps, where a fold that appends
    would copy the array n times."""
    steps = F.when(F.size(values) > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1), lambda k: F.pow(F.lit(2.0), k).cast("int")))
    steps = F.coalesce(steps, F.array().cast("array<int>"))
    return F.aggregate(steps, values, lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, both(F.get(acc, i - step), x)).otherwise(x)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def located(text: Column, pattern: Column | str, kind: int) -> Column:
    """All matches of a pattern as structs s, k, e, m: start and end in code points, kind number, matched text."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def place(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))

        def spans(ends: Column) -> Column:
            return F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.lit(kind).alias("k"), F.get(ends, i).alias("e"), m.alias("m")))

        return F.when(F.size(found) > 0, let(lengths, lambda n: let(running(n, _sum), spans))).otherwise(F.array()).cast(f"array<{_SPAN}>")

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), place)


#: Code points of a block: pieces of a long text are cut from its blocks, not from its beginning.
_BLOCK = 1024


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start up to end of the text that was cut into blocks."""
    first = F.floor(start / _BLOCK).cast("int")
    held = F.slice(blocks, first + 1, F.floor((end - 1) / _BLOCK).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(held, ""), start - first * _BLOCK + 1, end - start)).otherwise("")


def merged(spans: Column) -> Column:
    """struct(all, of, runs): spans by start, then kind; for each of them the number of its run (from 0); and the runs
    of overlapping spans as structs s, e, k, k being the kind of the first."""

    def of_sorted(x: Column) -> Column:
        return let(running(F.transform(x, lambda y: y["e"]), F.greatest), lambda top: of_tops(x, top))

    def of_tops(x: Column, top: Column) -> Column:
        begins = F.transform(x, lambda y, i: F.when((i == 0) | (y["s"] >= F.get(top, i - 1)), 1).otherwise(0))
        return let(begins, lambda b: let(F.filter(F.transform(b, lambda one, i: F.when(one == 1, i)), lambda i: i.isNotNull()), lambda heads: result(x, top, b, heads)))

    def result(x: Column, top: Column, begins: Column, heads: Column) -> Column:
        last = lambda j: F.coalesce(F.get(heads, j + 1), F.size(x)) - 1
        runs = F.transform(heads, lambda h, j: F.struct(F.get(x, h)["s"].alias("s"), F.get(top, last(j)).alias("e"), F.get(x, h)["k"].alias("k")))
        return F.struct(x.alias("all"), F.transform(running(begins, _sum), lambda n: n - 1).alias("of"), runs.alias("runs"))

    return let(F.array_sort(spans), of_sorted)


def _passes(valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: valid(x["m"])


def base_spans(text: Column) -> dict[str, Column]:
    """The base matches of each kind, leftmost and non-overlapping within the kind; those that fail its test go."""
    out = {}
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found = F.filter(located(text, pattern, k), _passes(VALID[kind]))
        hint = F.contains(text, F.lit(_HINT[kind])) if _HINT[kind] else text.rlike("[0-9]")
        out[kind] = F.when(hint, found).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return out


def span_text(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*PATTERNS, TERM)])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def terms_of(line: Column) -> Column:
    """Terms of a line: lower-cased runs of letters, digits, ' and - that begin with a letter and have three signs or more."""
    return F.filter(F.split(F.lower(F.regexp_replace(line, f"[^{_TERM_CHARS}]+", " ")), " "), lambda w: w.rlike(r"^\p{L}.{2}"))


def contexts(line: Column, found: Column, cut: Column, window: int) -> Column:
    """For each base match of a line a struct k, m, terms: the terms among the `window` before and after it.

    found is merged() of the matches, cut the line's blocks. Terms are those of the text between matches; other matches
    on the line are no context, and don't count as words.
    """
    runs = found["runs"]
    start = lambda j: F.coalesce(F.get(runs, j - 1)["e"], F.lit(0))
    gaps = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda j: piece(cut, start(j), F.coalesce(F.get(runs, j)["s"], F.length(line))))

    def of_terms(t: Column) -> Column:
        def near(y: Column, i: Column) -> Column:
            n = F.get(t["upto"], F.get(found["of"], i))
            around = F.concat(F.slice(t["flat"], F.greatest(n - window + 1, F.lit(1)), F.least(n, F.lit(window))), F.slice(t["flat"], n + 1, F.lit(window)))
            return F.struct(y["k"].alias("k"), y["m"].alias("m"), F.array_distinct(around).alias("terms"))

        return F.transform(found["all"], near)

    return let(F.transform(gaps, terms_of), lambda terms: let(F.struct(F.flatten(terms).alias("flat"), running(F.transform(terms, F.size), _sum).alias("upto")), of_terms))


def disclosing_terms(found: DataFrame, window: int = 5, alpha: float = 1.25, support: int = 3) -> tuple[DataFrame, DataFrame]:
    """(terms, hits): terms that reveal a protected entity, and (id, term) for each text that holds one.

    found has id, text and base (spans). Entities are the distinct base matches. Over the corpus's distinct lines,
    PMI(entity; term) = log(p(entity, term) / (p(entity) p(term))) and IC(entity) = -log p(entity); the joint event is
    the term within `window` words of the entity. A term reveals an entity if they meet in `support` distinct lines
    or more and PMI >= IC / alpha; at alpha = 1 it would have to occur nowhere else. A line that is copied counts once.
    All counts are exact, lines being told apart by 64-bit hashes.
    """
    # no base pattern reaches over the end of a line, so that lines can be looked at one by one
    held = found.where(F.size("base") > 0).select(F.explode(F.split("text", "\n")).alias("said"))
    # step by step: an expression that is read several times is planned and computed once
    held = held.withColumn("base", F.concat(*base_spans(F.col("said")).values())).withColumn("found", merged(F.col("base"))).withColumn("cut", blocks_of(F.col("said")))
    met = held.select(F.xxhash64("said").alias("line"), F.explode(contexts(F.col("said"), F.col("found"), F.col("cut"), window)).alias("x"))
    met = stored(met.select("line", "x.k", "x.m", "x.terms"))
    lines = found.select("id", F.explode(F.split("text", "\n")).alias("line"))
    n_lines = lines.agg(F.count_distinct(F.xxhash64("line"))).first()[0]
    near = met.select("k", "m", "line", F.explode("terms").alias("term"))
    joint = near.groupBy("k", "m", "term").agg(F.countDistinct("line").alias("n_ct")).where(F.col("n_ct") >= support)
    entity = met.groupBy("k", "m").agg(F.countDistinct("line").alias("n_c")).where(F.col("n_c") >= support)
    # PMI >= IC / alpha says that the term stands in `most` lines at most; those near entities are some of them
    most = F.col("n_ct") * F.pow(F.greatest(F.lit(float(max(n_lines, 1))) / F.col("n_c"), F.lit(1.0)), 1 - 1 / alpha)
    at_least = near.groupBy("term").agg(F.countDistinct("line").alias("e_t"))
    candidates = joint.join(entity, ["k", "m"]).groupBy("term").agg(F.max(most).alias("most")).join(at_least, "term").where("e_t <= most").select("term", "most")
    candidates = stored(candidates)
    discard(met)
    n_candidates = candidates.count()
    if not n_candidates:
        return candidates.select("term"), found.select("id", F.lit("").alias("term")).limit(0)
    words = lines.select("id", F.xxhash64("line").alias("line"), F.explode(F.array_distinct(terms_of(F.col("line")))).alias("term"))
    wanted = candidates.select("term")
    seen = stored(words.join(F.broadcast(wanted) if n_candidates <= BROADCAST_ROWS else wanted, "term"))
    frequency = seen.groupBy("term").agg(F.countDistinct("line").alias("n_t"))
    terms = frequency.join(candidates, "term").where("n_t <= most").select("term")
    terms = stored(terms)
    return terms, seen.join(terms, "term").select("id", "term").distinct()


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 5, alpha: float = 1.25, support: int = 3) -> DataFrame:
    """Append base (array of spans), more (spans of disclosing terms outside the base) to docs.

    A span is s, k, e, m: start and end in code points, number of the kind (PATTERNS in order, then term), text.
    Null texts count as empty and have no spans. Disclosing terms are marked wherever they occur in the texts of
    their ids, in any case. Rows that repeat an id share its terms. Columns named base and more are replaced.
    """
    kept = [c for c in docs.columns if c not in ("base", "more")]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by_kind = base_spans(F.col("__t"))
    found = docs.select(*[F.col(f"`{c}`") for c in kept], t.alias("__t")).withColumn("base", F.concat(*by_kind.values()))
    _, hits = disclosing_terms(found.select(F.col(id_col).alias("id"), F.col("__t").alias("text"), "base"), window, alpha, support)
    of_doc = stored(hits.groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_set("term")).alias("__terms")))
    if (of_doc.agg(F.sum(F.size("__terms") + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        of_doc = F.broadcast(of_doc)
    out = found.join(of_doc, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    pattern = F.concat(F.lit(f"(?iu)(?<![{_TERM_CHARS}])(?:"), F.array_join("__terms", "|"), F.lit(f")(?![{_TERM_CHARS}])"))
    outside = F.filter(located(F.col("__t"), pattern, len(PATTERNS)), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    more = F.when(F.col("__terms").isNotNull(), outside).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "base", more.alias("more"))


def sanitised(text: Column, runs: Column, blocks: Column, marks: tuple[str, ...] = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")) -> Column:
    """The text, given as its blocks too, with each run of overlapping spans generalised to the mark of its first's kind."""
    names = F.array(*[F.lit(m) for m in marks])
    end = lambda j: F.coalesce(F.get(runs, j)["e"], F.lit(0))
    clean = F.transform(runs, lambda x, j: F.concat(piece(blocks, end(j - 1), x["s"]), F.get(names, x["k"])))
    return F.when(F.size(runs) > 0, F.concat(F.array_join(clean, ""), piece(blocks, end(F.size(runs) - 1), F.length(text)))).otherwise(text)


def with_sanitised(df: DataFrame, text: str, spans: Column, out: str) -> DataFrame:
    """Append the text with its spans generalised; null texts stay null."""
    made = df.withColumn("__spans", spans).withColumn("__runs", merged(F.col("__spans"))["runs"])
    made = made.withColumn("__blocks", F.when(F.size("__runs") > 0, blocks_of(F.col(text))).otherwise(F.array().cast("array<string>")))
    return made.withColumn(out, F.when(F.col(text).isNotNull(), sanitised(F.col(text), F.col("__runs"), F.col("__blocks")))).drop("__spans", "__runs", "__blocks")


def without_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the same columns, spans replaced in the text; null texts stay null."""
    found = find_personal_data(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__key"), F.col(text).alias("__text")), "__key", "__text", **options)
    found = with_sanitised(found, "__text", F.concat("base", "more"), "__clean")
    return found.select(*[F.col("__clean").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
