import html
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from cratewise.llm import html_blocks as H
from tests.llm.common import clashing, prose

RICH = """<html><head><title>Site</title><style>p{}</style></head><body class="home"><header class="site-header"><h1>Site</h1></header>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div><div id="main-content"><h1>Title &amp; more</h1>
<p>First  para with <a href=y>a link</a>.<p>Second&nbsp;one.<div class="ad-slot">Buy!</div><form><input>Subscribe</form><ul><li>one<li>two</ul>
<script>var t="</p>";</script><blockquote>Quote &lt;b&gt;</blockquote></div><aside>Side</aside><!-- <p>no</p> -->
<section class="comments"><article class=comment><p>Nice post, I liked it a lot really</p></article></section><footer>(c)</footer></body></html>"""


def test_rich_page():
    assert H.main_text(RICH) == "Title & more First para with a link. Second one. one two Quote <b>"


@pytest.mark.parametrize("page,text", [("", ""), ("plain words " * 30, ("plain words " * 30).strip()), ("<article>x", "x"), ("<article><p>a<br>b</p>c</article>d", "a b c"),
                                       ("<nav>a</nav>", ""), ("<article><header><h1>T</h1></header>x</article>", "T x"), ("<script>a", ""),
                                       ("<article>1 < 2 &amp;&amp; 3 > 2</article>", "1 < 2 && 3 > 2"), ("<article><a href='x>y'>in</a> out</article>", "in out"),
                                       ("<main><p>one</p><div hidden>no</div><div class='overflow-hidden'>two</div></main>", "one two"),
                                       ("<div class='article-header'><h1>A</h1></div>" * 0 + "<article><p " + "a='" * 50 + ">x</article>", "x")])
def test_small_pages(page, text):
    assert H.main_text(page) == text


def accuracy(pages, labels):
    right = [H.is_article(H.default_tree(), row) == label for blocks, own in zip(pages, labels) for row, label in zip(H.described(blocks).tolist(), own)]
    return sum(right) / len(right)


def test_held_out_pages_of_the_table():
    rows, labels = H.labelled_table(300, seed=99)
    assert np.mean([H.is_article(H.default_tree(), r) == bool(y) for r, y in zip(rows.tolist(), labels)]) >= 0.97


@pytest.mark.parametrize("mode", ["given", "removed", "random"])
def test_blocks_are_told_by_density_when_names_are_removed_or_random(mode):
    """The given pages, their containers all made div without class, or named at random."""
    rng, pages, labels = random.Random(4), [], []
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        labels.append([b[1] > 0 for b in H.text_blocks(page)])
        if mode == "removed":
            page = re.sub(r"<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))
        elif mode == "random":
            for tag, other in zip(["article", "nav", "footer"], rng.choices(["article", "nav", "footer", "div", "aside", "main", "section"], k=3)):
                page = re.sub(rf"<(/?){tag}\b", rf"<\1x-{other}", page)
            page = re.sub('class="ad"', f'class="{rng.choice(["content", "ad", "article", "menu", "x"])}"', page.replace("x-", ""))
        blocks = H.text_blocks(page)
        assert len(blocks) == len(labels[-1])
        pages.append(blocks)
    assert accuracy(pages, labels) >= (0.95 if mode == "random" else 0.99)


def test_densities_and_neighbours_are_asked():
    used = set()

    def walk(tree):
        if isinstance(tree, tuple):
            used.add(H.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(H.default_tree())
    assert {"words", "links", "words_after", "links_after", "words_before"} <= used
    # A container named article can be refused, and one named otherwise taken.
    menu = "<article>" + "".join(f"<li><a href=u>{prose(k, 2)}</a></li>" for k in range(6)) + "</article>"
    story = "<div class=sidebar><h1>A title of it</h1>" + "".join(f"<p>{prose(100 + k, 50)}</p>" for k in range(5)) + "</div>"
    assert H.main_text(menu + story) == "A title of it " + " ".join(prose(100 + k, 50) for k in range(5))


def test_unmarked_pages():
    rng, right = random.Random(1), 0
    for k in range(100):
        links = "".join(f"<div><a href=#>{prose(k * 9 + j, rng.randrange(1, 4))}</a></div>" for j in range(6))
        paragraphs = [prose(1000 + k * 20 + j, rng.randrange(25, 120)) for j in range(rng.randrange(2, 8))]
        right += H.main_text(f"<body>{links}{''.join(f'<p>{p}</p>' for p in paragraphs)}{links}</body>") == " ".join(paragraphs)
    assert right >= 95


def test_elements_inside_an_article():
    """Only scripts, styles, controls of forms and templates are left out; unclosed or nested ones take nothing else."""
    text = prose(1, 60)
    page = "<article><p>{}</p><p>%s</p><p>%s</p></article>" % (text, text)
    for inner, kept in [("<math><mi>x</mi></math> is real", "x is real"), ("<noscript>shown words</noscript> here", "shown words here"),
                        ("<object>fall back</object> text", "fall back text"), ("one <svg><g><svg></svg></g></svg> two", "one two"),
                        ("one <template>a<template>b</template>c</template> two", "one two"), ("one <template> two three", "one two three"),
                        ("one <select><option>no</select> two", "one two"), ("one <textarea>no</textarea> two", "one two"), ("one <textarea> two", "one two")]:
        assert H.main_text(page.format(inner)) == f"{kept} {text} {text}", inner


def test_test_pages_give_their_articles():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        body = re.search("<article>(.*?)</article>", page, re.S)[1]
        assert H.main_text(page) == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())


@pytest.mark.parametrize("shape", [lambda d: d, clashing])
def test_pages(spark, shape):
    pages = [(1, "u", RICH), (2, None, None), (3, "u", ""), (3, "u", RICH), (4, "u", "<article>" + prose(1, 50000) + "</article>"), (None, "u", "<p>")]
    df = shape(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    rows = H.extract_main_text(df).collect()
    assert len(rows) == 6 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sorted(r["text"] for r in rows) == sorted(H.main_text(p[2] or "") for p in pages)
    assert H.extract_main_text(df.limit(0)).count() == 0
