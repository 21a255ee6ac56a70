import html as stdlib
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import html_extract
from lodestar.llm.html_extract import content_lines, content_region, extract_main_text, main_text, read_page, smoothed, threshold

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<nav><a href=x>Home</a></nav><div class="content has-sidebar"><h1>Title &amp; more</h1><p>First paragraph with text enough to be the article, certainly.
<p>Second <b>bold</b> has
 white\t\tspace and is long as well.</p><form>search</form><div class="ad">Buy now</div><ul><li>point one</li><li>point two</li></ul><p>Short.</p></div>
<div class="comments"><p>I am a reader and write a very long text here that could mislead an extractor of main texts.</p></div><aside>side</aside>
<footer>&copy; foot</footer><script>var x="<p>no</p>"</script></body></html>"""


def test_furniture_goes_and_short_blocks_stay():
    assert main_text(PAGE).split("\n") == ["Title & more", "First paragraph with text enough to be the article, certainly.", "Second bold has white space and is long as well.", "point one", "point two", "Short."]


def test_titles_of_articles_and_other_layouts():
    page = '<article><header class="entry-header"><h1>Own title</h1></header><div class="entry-content"><p>Some text of the article.</p><div class="related-posts">Others</div></div><section id="comments"><p>Hm.</p></section></article>'
    assert main_text(page) == "Own title\nSome text of the article."
    table = "<table><tr><td><a href=x>Home</a></td><td><p>Long text in a cell of a table page, as it was once.</p><p>More text.</p></td></tr></table>"
    assert main_text(table) == "Long text in a cell of a table page, as it was once.\nMore text."


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<article><p>x &lt;y&gt; &#233;</article>", "x <y> é"), ("<p>unclosed <b>bold", "unclosed bold"), ("<script>x</script>", ""), ("<<<>>", "<<<>>"), ("<p>a<!-- c -->b</p>", "ab")])
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "<p>deep text</p>") == "deep text"
    long = "<article>" + "".join(f"<p>paragraph {k} with some words</p>" for k in range(5000)) + "</article>"
    assert main_text(long).count("\n") == 4999


def test_test_pages_give_their_articles(spark):
    rows = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for i, page in rows:
        body = page[page.find("<article>") + 9 : page.find("</article>")]
        blocks = (re.sub(r"\s+", " ", stdlib.unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", body))
        assert got[i] == "\n".join(b for b in blocks if b)


def test_clashing_columns_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, PAGE, "old")] * 2 + [(2, None, "old")], "page_id long, html string, text string")
    out = extract_main_text(df)
    assert set(out.columns) == {"page_id", "html", "text"} and out.where(F.col("text") == "").count() == 1 and out.count() == 3
    assert extract_main_text(df.limit(0)).count() == 0


def test_smoothing_keeps_a_constant():
    assert np.allclose(smoothed(np.full(7, 3.0), 2.0), 3.0)


def test_articles_in_several_blocks_stay_whole():
    first = [f"Paragraph {k} of the larger part" + " goes on" * n for k, n in enumerate((20, 5, 22, 18, 5, 20))]
    second = [f"Paragraph {k} of the smaller part" + " goes on" * 16 for k in range(2)]
    block = lambda tag, texts: f"<{tag}>" + "".join(f"<p>{t}</p>" for t in texts) + f"</{tag}>"
    whole = "\n".join(first + second)
    nav = "<nav><a href=x>Home</a></nav>"
    assert main_text(f"<body>{nav}<div class=content>{block('div', first)}{block('div', second)}</div><footer>foot</footer></body>") == whole
    assert main_text(f"<body>{nav}{block('article', first)}{block('article', second)}<footer>foot</footer></body>") == whole
    assert main_text(f"<body>{nav}<div>{block('section', second)}{block('blockquote', first)}</div></body>") == "\n".join(second + first)


def test_link_lists_of_an_article_stay():
    links = "<ul><li><a href=x>A first source of the article</a></li><li><a href=y>Another</a></li></ul>"
    want = "Text of an article that is long enough to be one.\nA first source of the article\nAnother"
    assert main_text(f"<body><article><p>Text of an article that is long enough to be one.</p>{links}</article></body>") == want
    assert main_text(f"<body><div><p>Text of an article that is long enough to be one.</p>{links}</div></body>") == want


UNNAMED = """<body><div><a href=1>Start</a> <a href=2>News</a> <a href=3>More of it</a></div><div><span>12 May</span><span>Log in</span></div>
<div><h2>The title</h2><p>A first paragraph that is long, as the paragraphs of articles are, and that goes on for a while.</p><p>Short one.</p>
<p>Another paragraph that is long, as the paragraphs of articles are, and that goes on for a while.</p></div>
<div><p><b>Read</b> <i>also</i> <a href=4>this thing</a></p><p><a href=5>that thing</a></p></div><div><span>2024</span> <span>imprint</span></div></body>"""


def test_ratios_decide_where_nothing_has_a_name(monkeypatch):
    want = "The title\nA first paragraph that is long, as the paragraphs of articles are, and that goes on for a while.\nShort one.\nAnother paragraph that is long, as the paragraphs of articles are, and that goes on for a while."
    assert main_text(UNNAMED) == want
    monkeypatch.setattr(html_extract, "smoothed", lambda values, sigma: np.ones(len(values)))
    assert main_text(UNNAMED) != want


@pytest.mark.parametrize("html", ["<div>word " * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<li>" + "<b>" * 30_000 + "<p>x" * 30_000, "<div>" * 30_000 + "</section>" * 30_000])
def test_time_is_linear(html):
    began = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - began < 20


def tree(rng, depth=0):
    """A random page: (html, lines), a line being (text, path of containers, element, linked)."""
    out, lines = [], []
    for _ in range(rng.randint(1, 4)):
        if depth < 3 and rng.random() < 0.45:
            tag = rng.choice(["div", "section", "ul", "blockquote"] + ["article"] * (rng.random() < 0.2))
            inner, below = tree(rng, depth + 1)
            name = (tag, rng.random())
            out.append(f"<{tag}>{inner}</{tag}>")
            lines += [(t, (name, *p), e, m) for t, p, e, m in below]
        else:
            text, tag, linked = " ".join("abcdefgh"[: rng.randint(1, 8)] for _ in range(rng.choice([1, 2, 4, 30]))), rng.choice(["p", "p", "h2"]), rng.random() < 0.25
            out.append(f"<{tag}><a href=x>{text}</a></{tag}>" if linked else f"<{tag}>{text}</{tag}>")
            lines.append((text, (), tag, linked))
    return "".join(out), lines


def brute_smooth(ratio):
    kernel = [math.exp(-0.5 * k * k) for k in range(-3, 4)]
    at = lambda k: ratio[min(max(k, 0), len(ratio) - 1)]
    return [sum(w * at(k + d) for d, w in zip(range(-3, 4), kernel, strict=True)) / sum(kernel) for k in range(len(ratio))]


def brute_region(lines, content):
    """Which lines stay, by comparing the paths of all lines with each other."""
    n = len(lines)
    paths = [p for _, p, _, _ in lines]
    inner = [next((p[: k + 1] for k in range(len(p) - 1, -1, -1) if p[k][0] == "article"), None) for p in paths]
    mass = sum(len(lines[i][0]) for i in range(n) if content[i])
    if 2 * sum(len(lines[i][0]) for i in range(n) if content[i] and inner[i]) >= mass:
        chosen = {inner[i] for i in range(n) if content[i] and inner[i]}
        return [any(paths[i][: len(c)] == c for c in chosen) for i in range(n)]
    own = {paths[i] for i in range(n) if content[i]}
    region = min(own, key=len)
    while not all(c[: len(region)] == region for c in own):
        region = region[:-1]
    first, last = min(i for i in range(n) if content[i]), max(i for i in range(n) if content[i])
    keep = []
    for i, (_, p, e, _) in enumerate(lines):
        if p[: len(region)] != region:
            keep.append(False)
            continue
        idle = next((p[:k] for k in range(len(region), len(p) + 1) if not any(c[:k] == p[:k] for c in own)), None)
        if idle is None:
            keep.append(p in own or e == "h2")
            continue
        part = [x for x in lines if x[1][: len(idle)] == idle]
        mostly_linked = 2 * sum(len(x[0]) for x in part if x[3]) >= sum(len(x[0]) for x in part)
        keep.append((idle[:-1] in own or first < i < last) if not mostly_linked else idle[:-1] in own and idle[-1][0] == "ul")
    k = keep.index(True)
    while k and lines[k - 1][2] == "h2":
        k -= 1
        keep[k] = True
    return keep


def test_is_the_brute_force_result():
    rng, seen = random.Random(5), set()
    for _ in range(1500):
        html, lines = tree(rng)
        page = read_page(html)
        assert [x.text for x in page.lines] == [t for t, *_ in lines]
        tags = np.array([x.tags for x in page.lines])
        own = np.array([0.0 if m else len(t) for t, _, _, m in lines])
        plain = brute_smooth((own / np.maximum(tags, 1)).tolist())
        assert np.allclose(plain, smoothed(own / np.maximum(tags, 1)))
        content = content_lines(page)
        cut = threshold(np.array(plain))
        passed = [s >= cut and o > 0 and 2 * o >= len(t) for s, o, (t, *_) in zip(plain, own, lines, strict=True)]
        together = [sum(o for o, q in zip(own, lines, strict=True) if q[1] == p) / sum(g for g, q in zip(tags, lines, strict=True) if q[1] == p) for _, p, *_ in lines]
        both = [a and b >= cut for a, b in zip(passed, together, strict=True)]
        assert content.tolist() == (both if any(both) else passed if any(passed) else [True] * len(lines))
        want = brute_region(lines, content)
        assert content_region(page, content).tolist() == want
        seen.add((any(want), all(want)))
    assert len(seen) == 2


def test_thresholds_part_two_clusters():
    for scores, high in (([5.0, 5.0], 2), ([0.0, 1.0, 80.0, 90.0], 2), ([0.0], 1), ([3.0, 100.0, 100.0, 100.0], 3), ([0.0, 0.0, 20.0, 100.0, 120.0, 90.0], 3)):
        assert sum(s >= threshold(np.array(scores)) for s in scores) == high
