"""Main text of web pages from a flat list of text blocks.

A page is cut into blocks at block-level tags. A block is described by its word
count, link density, text density and tag, by those of its neighbours, by its
place in the page, and by what its containers call themselves, together with
how far such names agree with the densities of the page's other blocks. A
decision tree tells article blocks from the rest. It is trained on a small
labelled table: the blocks of generated pages whose containers are named
rightly, not at all, or at random, so that names alone never decide. Every page
is one row in and one row out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cratewise.llm.text import slices

# Element names, and words of class, id and role attributes, by what they say.
RAW = frozenset("script style textarea title".split())  # what is inside is no markup
UNSEEN = frozenset("template select button datalist".split())  # not shown, or controls of forms; may hold further elements
BLOCKS = frozenset(("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
                    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section "
                    "summary table tbody td tfoot th thead tr ul").split())
CONTAINERS = BLOCKS - {"hr", "head", "html", "body"} | {"span"}
KINDS = {tag: k for k, tags in enumerate((
    "h1 h2 h3 h4 h5 h6", "p blockquote pre dd figcaption", "li dt", "td th caption", "div section article main span center details figure address",
    "nav aside footer header form fieldset menu dialog")) for tag in tags.split()}
PLAIN = KINDS["div"]
OTHER_TAGS = frozenset("aside dialog fieldset footer form header menu nav".split())
MAIN_TAGS = frozenset(["article", "main"])
OTHER_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising banner bottom breadcrumb breadcrumbs byline-links "
                         "comment comments commentlist consent cookie cookies copyright cta dialog discussion disqus footer footnav form gdpr "
                         "header legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices "
                         "overlay pager pagination paywall popup print-only promo promoted recommend recommended related reply replies "
                         "respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subnav subscribe tags "
                         "teaser toolbar topbar widget widgets alert contentinfo complementary").split())
MAIN_WORDS = frozenset("article articlebody content entry main post story text body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("words", "links", "density", "kind", "words_before", "links_before", "kind_before", "words_after", "links_after", "kind_after",
            "words_around", "place", "after_heading", "ends_sentence", "said", "trust", "said_and_trusted")


def described(blocks: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """A row a block, in the order of FEATURES.

    ``trust`` is the share of long unlinked text inside containers that say
    article, less the share of link blocks inside such containers.
    """
    n = len(blocks)
    words = np.array([b[2] for b in blocks], float)
    links = np.minimum(1.0, np.array([b[3] for b in blocks]) / words)
    said, kind = np.array([b[1] for b in blocks], float), np.array([b[4] for b in blocks], float)
    size = np.array([len(b[0]) for b in blocks], float)
    plain = words * (1 - links)
    total = np.cumsum(words)
    long = np.where((links < 0.3) & (words >= 10), words, 0.0)
    linked = links > 0.5
    inside = said > 0
    trust = 0.0
    if inside.any():
        trust = (long[inside].sum() / long.sum() if long.any() else 1.0) - (linked[inside].sum() / linked.sum() if linked.any() else 0.0)
    around = np.convolve(plain, np.ones(5))[2:n + 2] - plain
    heading = np.cumsum(kind == 0) - (kind == 0) > 0

    def shifted(x: np.ndarray, by: int, fill: float) -> np.ndarray:
        out = np.full(n, fill)
        if by > 0:
            out[by:] = x[:-by]
        else:
            out[:by] = x[-by:]
        return out

    ends = np.array([b[0].rstrip("\"')»”’")[-1:] in ".!?…:;。" for b in blocks], float)
    return np.column_stack([
        words, links, words / np.ceil(size / 80), kind, shifted(words, 1, 0), shifted(links, 1, 0), shifted(kind, 1, -1), shifted(words, -1, 0),
        shifted(links, -1, 0), shifted(kind, -1, -1), around, (total - words / 2) / total[-1], heading, ends, said, np.full(n, trust), said * trust])


# The labelled table ----------------------------------------------------------

def _words(rng: random.Random, mark: str, n: int, links: float = 0.0) -> str:
    """Words that begin with the mark of their label; about a share of them in links, and stops at their ends."""
    out = []
    for k in range(n):
        word = mark + "x" * min(14, int(rng.expovariate(0.22))) + ("." if k + 1 == n and n > 3 or rng.random() < 0.06 else "")
        out.append(f"<a href=u>{word}</a>" if rng.random() < links else word)
    return " ".join(out)


def labelled_page(rng: random.Random) -> str:
    """A page whose article words begin with A and whose other words begin with N.

    Its containers are named rightly, not at all, or with each other's names.
    """
    names = {"menu": ["nav", "div class=menu", "div id=navigation", "ul class=nav"], "head": ["header", "div class=site-header", "div class=masthead"],
             "ad": ["div class=ad", "div class=advert", "aside", "div class=promo-banner"], "notice": ["div class=notice", "div class=cookie-consent"],
             "article": ["article", "main", "div class=article-body", "div id=content", "div class=entry-content"],
             "side": ["aside", "div class=sidebar", "div class=related"], "foot": ["footer", "div class=footer", "div id=copyright"],
             "form": ["form", "div class=newsletter", "form class=search"], "remarks": ["section class=comments", "div id=comments"]}
    mode = rng.choice(["right", "right", "right", "right", "right", "none", "none", "random"])
    if rng.random() < 0.1:  # nothing but an article
        text = _words(rng, "A", rng.choice([1, 2, 5, 12, 40, 150]), rng.choice([0, 0, 0.3]))
        inner = rng.choice([text, f"<p>{text}</p>", f"<p>{text}</p>{_words(rng, 'A', rng.randrange(1, 9))}"])
        return f"<{(box := rng.choice(names['article']))}>{inner}</{box.split()[0]}>" if rng.random() < 0.7 else inner
    every = [x for group in names.values() for x in group]

    def box(role: str, inner: str) -> str:
        opening = {"none": "div", "random": rng.choice(every), "right": rng.choice(names[role])}[mode]
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def menu() -> str:
        items = [f"<li><a href=u>{_words(rng, 'N', rng.choice([1, 1, 1, 2, 3]))}</a></li>" for _ in range(rng.randrange(2, 9))]
        return box("menu", f"<ul>{''.join(items)}</ul>" if rng.random() < 0.7 else "".join(x.replace("li>", "div>") for x in items))

    def remark(role: str, low: int, high: int) -> str:
        text = _words(rng, "N", rng.randrange(low, high), rng.choice([0, 0, 0.1, 0.4]))
        return box(role, text if rng.random() < 0.8 or mode != "right" else f"<p>{text}</p>")

    def paragraph() -> str:
        n = rng.choice([1, 2, 3, 5, 9, 15, 25, 40, 60, 90, 140]) + rng.randrange(4)
        text = _words(rng, "A", n, rng.choice([0, 0, 0, 0.05, 0.2]))
        kind = rng.random()
        if kind < 0.08:
            return f"<h{rng.randrange(2, 5)}>{_words(rng, 'A', rng.randrange(1, 9))}</h3>"
        if kind < 0.14:
            return "<ul>" + "".join(f"<li>{_words(rng, 'A', rng.randrange(2, 25))}" for _ in range(rng.randrange(2, 6))) + "</ul>"
        if kind < 0.18:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.20:
            return f"<table><tr><td>{_words(rng, 'A', rng.randrange(1, 12))}<td>{_words(rng, 'A', rng.randrange(1, 12))}</table>"
        if kind < 0.27 and mode == "right":  # text beside the paragraphs
            return f"<p>{text}</p>{_words(rng, 'A', rng.randrange(1, 20))}" if kind < 0.23 else f"<div>{text}</div>"
        return f"<p>{text}</p>" if kind < 0.95 else f"<p>{text}<br>{_words(rng, 'A', 8)}"

    if rng.random() < 0.05 and mode == "right":  # no article
        return rng.choice([menu() + remark("foot", 1, 12), remark("menu", 1, 9), remark("foot", 1, 20), remark("form", 1, 9)])
    heading = f"<h1>{_words(rng, 'A', rng.randrange(1, 14))}</h1>"
    if mode == "right" and rng.random() < 0.2:
        heading = f"<header>{heading}</header>"
    body = [heading] * (rng.random() < 0.9) + [paragraph() for _ in range(rng.choice([1, 2, 3, 5, 8, 14]))]
    if rng.random() < 0.08 and mode == "right":
        body = [_words(rng, "A", rng.randrange(20, 200))]
    for role, chance, low, high in (("ad", 0.2, 1, 25), ("form", 0.15, 1, 12)):
        if rng.random() < chance:
            inner = remark(role, low, high)
            body.insert(rng.randrange(1, len(body) + 1), inner.replace(">", " hidden>", 1) if mode == "right" and rng.random() < 0.2 else inner)
    page = [menu()] * (rng.random() < 0.85)
    if rng.random() < 0.4:
        page.insert(0, box("head", _words(rng, "N", rng.randrange(1, 6)) if rng.random() < 0.6 or mode != "right" else f"<h1>{_words(rng, 'N', 3)}</h1>"))
    for role, chance in (("ad", 0.6), ("notice", 0.3)):
        if rng.random() < chance:
            page.insert(rng.randrange(len(page) + 1), remark(role, 2, 35))
    page.append(box("article", "".join(body)) + (_words(rng, "N", rng.randrange(1, 12)) if mode == "right" and rng.random() < 0.1 else ""))
    if rng.random() < 0.5:
        page.append(box("side", (f"<h3>{_words(rng, 'N', 2)}</h3>" if rng.random() < 0.5 else "") + "".join(
            f"<div><a href=u>{_words(rng, 'N', rng.randrange(1, 9))}</a></div>" for _ in range(rng.randrange(1, 6)))))
    if rng.random() < 0.3 and mode == "right":
        page.append(box("remarks", "".join(f"<{t}>{_words(rng, 'N', rng.randrange(2, 60))}</{t}>" for t in rng.choices(["p", "div", "li", "article"], k=rng.randrange(1, 6)))))
    for role, chance in (("form", 0.15), ("ad", 0.2), ("foot", 0.8)):
        if rng.random() < chance:
            page.append(remark(role, 2, 30))
    return "<body>" + "".join(page)


def labelled_table(pages: int = 1400, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: article) of all blocks of generated pages."""
    rng, rows, labels = random.Random(seed), [], []
    for _ in range(pages):
        blocks = text_blocks(labelled_page(rng))
        rows.append(described(blocks))
        labels += [b[0].startswith("A") for b in blocks]
    return np.concatenate(rows), np.array(labels, float)


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 12, least: int = 20):
    """A decision tree by Gini impurity: (feature, cut, tree up to the cut, tree above), or the share of article rows."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return share
    best = None
    for feature in range(rows.shape[1]):
        order = np.argsort(rows[:, feature], kind="stable")
        values, good = rows[order, feature], np.cumsum(labels[order])
        k = np.flatnonzero(values[1:] > values[:-1]) + 1  # rows up to each cut
        k = k[(k >= least) & (k <= len(labels) - least)]
        if not len(k):
            continue
        low, high = good[k - 1], good[-1] - good[k - 1]
        score = low * (1 - low / k) + high * (1 - high / (len(labels) - k))
        at = int(np.argmin(score))
        if best is None or score[at] < best[0] - 1e-9:
            best = float(score[at]), feature, float(values[k[at] - 1] + values[k[at]]) / 2
    if best is None:
        return share
    _, feature, cut = best
    low = rows[:, feature] <= cut
    return feature, cut, train_tree(rows[low], labels[low], depth - 1, least), train_tree(rows[~low], labels[~low], depth - 1, least)


@cache
def default_tree():
    return train_tree(*labelled_table())


def is_article(tree, features) -> bool:
    while isinstance(tree, tuple):
        feature, cut, low, high = tree
        tree = low if features[feature] <= cut else high
    return tree >= 0.5


def _said(tag: str, attributes: str, outer: int) -> int:
    """What a container says, given what the one around it says; the article never resumes inside something else."""
    if outer < 0:
        return outer
    if tag in OTHER_TAGS and not (tag == "header" and outer > 0):
        return -1
    if attributes:
        if HIDDEN.search(attributes):
            return -1
        words = set()
        for m in NAMED.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                words.update(CAMEL.sub("-", name).replace("_", "-").lower().split("-"))
        if outer <= 0 and words & MAIN_WORDS and words & OTHER_WORDS == {"header"}:
            return outer  # the heading of the article itself
        if words & OTHER_WORDS - ({"header"} if outer > 0 else set()) and tag != "body":
            return -1
        if words & MAIN_WORDS and tag not in ("p", "span", "li"):
            return 1
    return 1 if tag in MAIN_TAGS else outer


def _element_end(html: str, tag: str, at: int) -> int:
    """Where an element ends whose start tag ends at ``at``, elements of its kind inside it counted; ``at`` if it never does."""
    depth = 1
    for m in re.compile(f"<(/?){tag}(?=[\\s/>])[^>]*>", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def text_blocks(html: str) -> list[tuple[str, int, int, int, int]]:
    """(text, what its containers say, words, words in links, kind of tag) of the blocks of a page, in order."""
    blocks: list[tuple[str, int, int, int, int]] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    said, in_link, at, end = 0, 0, 0, len(html)

    def close() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                kind = next((KINDS[t] for t, _ in reversed(stack) if t in KINDS), PLAIN)
                blocks.append((text, said, text.count(" ") + 1, len(unescape(" ".join(linked)).split()), kind))
            pieces.clear()
            linked.clear()

    def data(body: str) -> None:
        if body:
            pieces.append(body)
            if in_link:
                linked.append(body)

    while at < end:
        match = TAG.search(html, at)
        if match is None:
            data(html[at:])
            break
        data(html[at:match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        closing, attributes = match[1] or match[4], match[3] or match[6] or ""
        if closing:
            if tag == "a":
                in_link = 0
            if tag in BLOCKS:
                close()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if stack[depth][1] != said or depth and stack[depth - 1][1] != said or not depth:
                        close()
                    del stack[depth:]
                    said = stack[-1][1] if stack else 0
                    break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                stop = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
                # Without an end, a script is the rest of the page; text of other elements stays.
                at = stop.end() if stop else end if tag in ("script", "style") else at
            continue
        if tag in UNSEEN:
            at = _element_end(html, tag, at)
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag in BLOCKS:
            close()
        if tag in BLOCKS and stack and (stack[-1][0] == tag and tag in ("p", "li", "td", "th", "tr", "dt", "dd") or stack[-1][0] == "p"):
            stack.pop()  # ended by what follows
            said = stack[-1][1] if stack else 0
        if tag in CONTAINERS and tag not in VOID and not attributes.rstrip().endswith("/"):
            inner = _said(tag, attributes, said)
            if inner != said:
                close()
            stack.append((tag, inner))
            said = inner
    close()
    return blocks


def main_text(html: str, tree=None) -> str:
    """The article's blocks joined by one space; empty if the page has none."""
    tree = default_tree() if tree is None else tree
    blocks = text_blocks(html)
    if not blocks:
        return ""
    return " ".join(block[0] for block, row in zip(blocks, described(blocks).tolist()) if is_article(tree, row))


def extract_main_text(pages: DataFrame, *, html: str = "html", tree=None) -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (code points) of the main text.

    A null or empty page has an empty text. Each page is treated alone and
    whole. Columns named text or n_chars are replaced.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*kept, F.col(html).alias("_html"))
    tree = default_tree() if tree is None else tree
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "text string, n_chars bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            texts = [main_text(page or "", tree) for page in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*kept, "text", "n_chars"])

    return source.mapInArrow(work, schema)
