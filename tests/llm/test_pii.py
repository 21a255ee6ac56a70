import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestar.llm import pii, registry
from lodestar.llm.pii import find_personal_data, span_text, without_personal_data

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text) if passes(kind, m[0])]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


def odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choices(["a", "1", ".", "@", "-", "+", " ", "(", "x", "%", "é", "9", "\n", "0", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (599) 555-3756", "5500005555555559"], k=rng.randint(0, 40))) for _ in range(1500)]
    return made + ["a@b.com_x@y.z.w@q.r", "1.2.3.4.5.6.7.8", "é 00255.1.1.1 256.1.1.1 é", "😀 4111-1111-1111-1111", "+1 (599) 555-3756)(", "5" * 30_000, "4111111111111111 " * 300, "12,4111 1111 1111 1111;" * 200, "a." * 20_000, "1 " * 20_000, "a@b.cc " * 600, ""]


def test_base_is_that_of_the_plain_patterns(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.b for r in find_personal_data(df).select("doc_id", span_text(F.col("base")).alias("b")).collect()}
    want = {k: brute(t) for k, t in enumerate(texts)}
    assert got == want and sum(map(bool, want.values())) > 500


def test_query_columns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = registry.op9_personal_data(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(f"{k}:") for k, _ in PLAIN)
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


@pytest.fixture
def corpus(spark):
    """A name that only stands with one address, among common words."""
    rows = [(k, f"write to Zorblatt today number{k} zorro@mail.example or wait until {k}", "x") for k in range(6)]
    rows += [(100 + k, f"an ordinary line that says write to wait today until {k}\nand another one {k}", "x") for k in range(200)]
    rows += [(900, "zorblatt was here", "x"), (901, None, "x"), (902, "", "x"), (903, "Zorblatts is another word", "x"), (900, "zorblatt was here", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, base string")


def test_disclosing_terms_are_found_everywhere(corpus):
    out = {r.doc_id: (r.text, r.more) for r in find_personal_data(corpus).collect()}
    marked = {i: [t[x.s : x.e] for x in more] for i, (t, more) in out.items() if more}
    assert marked[900] == ["zorblatt"] and marked[0] == ["Zorblatt"] and 903 not in marked and not any(100 <= i < 300 for i in marked)


def test_no_term_without_support(spark):
    rows = [(k, f"only{'abcdefghij'[k]} seen once with user{k}@mail.example") for k in range(10)]
    assert find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("more") > 0).count() == 0


def test_copies_of_a_line_prove_nothing(spark):
    rows = [(k, "rareword beside same@mail.example in every copy") for k in range(50)]
    assert find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("more") > 0).count() == 0


def test_sanitised_texts(spark, corpus):
    clean = without_personal_data(corpus)
    out = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == corpus.columns and clean.count() == corpus.count() and out[901] is None and out[902] == ""
    assert out[3] == "write to [TERM] today number3 [EMAIL] or wait until 3" and out[150] == corpus.where("doc_id = 150").first().text
    one = spark.createDataFrame([(1, "é 10.0.0.1 and +1 (599) 555-3756 end")], "doc_id long, text string")
    assert without_personal_data(one).first().text == "é [IP] and [PHONE] end"
    assert without_personal_data(corpus.limit(0)).count() == 0


def test_no_python_in_the_plan(corpus, capsys):
    find_personal_data(corpus).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_entities_of_one_line_count_its_lines_once(spark):
    """A contact list: a term near several entities of a line stands in as many lines as the list has."""
    rows = [(k, f"row{k} Zorblatt a@mail.example b@mail.example c@mail.example d@mail.example") for k in range(3)]
    out = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("Zorblatt" in [r.text[x.s : x.e] for x in r.more] for r in out)


def test_repeats_in_one_line_are_no_support(spark):
    rows = [(k, f"number{k} other{k} words{k}") for k in range(50)] + [(99, "Zorblatt same@mail.example Zorblatt same@mail.example Zorblatt same@mail.example")]
    assert find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("more") > 0).count() == 0


def test_overlapping_spans_leave_nothing_over(spark):
    df = spark.createDataFrame([(1, "call +378282246310005 now a@b.cc10.0.0.1 end")], "doc_id long, text string")
    out = without_personal_data(df).first().text
    assert not re.search("[0-9]", out) and out.startswith("call [") and out.endswith("] end")


def masked(text):
    """The text with all base matches replaced, one run of overlapping ones at a time."""
    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text) if passes(kind, m[0]))
    out, at = [], 0
    while found:
        s, k, e = found.pop(0)
        while found and found[0][0] < e:
            e = max(e, found.pop(0)[2])
        out += [text[at:s], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k]]
        at = e
    return "".join(out) + text[at:]


def test_sanitised_texts_are_those_of_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    marks = F.concat(*pii.base_spans(F.col("text")).values())
    got = {r.doc_id: r.x for r in pii.with_sanitised(df, "text", marks, "x").collect()}
    assert all(got[k] == masked(t) for k, t in enumerate(texts))


def brute_terms(docs, window=5, alpha=1.25, support=3):
    """PMI against information content, counted with sets of lines."""
    words = lambda t: [w for w in re.split(r"[^\w'-]|_", t.lower()) if re.match(r"[^\W\d_].{2}", w)]
    lines = {x for _, t in docs for x in (t or "").split("\n")}
    entity, joint, holds = {}, {}, {}
    for x in lines:
        for w in set(words(x)):
            holds.setdefault(w, set()).add(x)
        spans = sorted((m.start(), m.end(), kind, m[0]) for kind, p in PLAIN for m in re.finditer(p, x) if passes(kind, m[0]))
        hidden = list(x)
        for s, e, *_ in spans:
            hidden[s:e] = " " * (e - s)
        for s, e, kind, m in spans:
            entity.setdefault((kind, m), set()).add(x)
            for w in {*words("".join(hidden[:s]))[-window:], *words("".join(hidden[s:]))[:window]}:
                joint.setdefault((kind, m, w), set()).add(x)
    out = set()
    for (kind, m, w), both in joint.items():
        n_c, n_t, n_ct = len(entity[kind, m]), len(holds.get(w, ())), len(both)
        pmi, ic = math.log(n_ct * len(lines) / (n_c * max(n_t, 1))), -math.log(n_c / len(lines))
        if n_ct >= support and n_c >= support and pmi >= ic / alpha - 1e-12:
            out.add(w)
    return out


def test_terms_are_those_of_brute_force(spark):
    rng = random.Random(9)
    names = ["zorblatt", "quendel", "mirabor", "the", "call", "and", "today", "with"]
    people = [("zorblatt", "z@mail.example"), ("quendel", "10.1.2.3"), ("mirabor", "+1 (599) 555-3756")]
    docs = []
    for k in range(300):
        out = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.choice(names[3:]) for _ in range(rng.randint(2, 9))] + [f"n{k}x"] * (rng.random() < 0.2)
            if rng.random() < 0.3:
                for name, entity in rng.sample(people, rng.randint(1, 2)):
                    w[rng.randrange(len(w)) : 0] = [name, entity] if rng.random() < 0.8 else [entity]
            out.append(" ".join(w))
        docs.append((k, "\n".join(out)))
    df = spark.createDataFrame(docs, "id long, text string").repartition(4).withColumn("base", F.concat(*pii.base_spans(F.col("text")).values()))
    got = {r.term for r in pii.disclosing_terms(df)[0].collect()}
    assert got == brute_terms(docs) and got & {"zorblatt", "quendel", "mirabor"} and "the" not in got


def test_long_texts_take_time_in_proportion(spark):
    """A text of numbers, one of cards, one of addresses, each on one line."""

    def seconds(n):
        df = spark.createDataFrame([(1, "12," * (n // 3)), (2, "4111111111111111;" * (n // 17)), (3, "user@mail.example " * (n // 18))], "doc_id long, text string").repartition(3)
        began = time.perf_counter()
        rows = without_personal_data(df).collect()
        assert len(rows) == 3 and "4111" not in rows[0].text + rows[1].text + rows[2].text
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(1_000_000) < 60
