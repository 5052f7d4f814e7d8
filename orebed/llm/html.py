"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags.  Each block has features of
its ancestors (tags, words of class and id), of its text (words, links, marks, place), of the blocks beside it and
of the page (what kinds of frame it has at all).  The field is trained on generated labelled pages of many layouts, with
named, unnamed and arbitrarily named containers and without any, and the blocks that Viterbi decoding labels as main
text are joined.  Elements hold their ancestors' features by reference, so that deep pages take linear time and space.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf as _crf
from .common import ready
from .crf import viterbi

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it runs to their end tag, or to the end of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are left out up to their own end tag: form controls, graphics, templates.  Without an end tag only the tag is left out.
SKIP = frozenset("select datalist button svg template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label input button select datalist svg math mi mn mo mrow msup msub mfrac mtext semantics annotation msqrt".split())
#: Tags whose start closes an open one of the same group.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr")}
BOUNDS = frozenset("table ul ol dl div section article body html td th blockquote main aside nav header footer form".split())
LISTS = ("table", "ul", "ol", "dl")
SECTIONS = ("article", "main", "nav", "aside", "footer", "header", "form", "section")
#: Words of class and id that layouts share.
MAIN_NAMES = "content main article post entry story body text article-body post-content entry-content page-content".split()
SIDE_NAMES = "sidebar side widget related recommended share social newsletter promo".split()
NOTICE_NAMES = "cookie cookies notice consent banner alert popup modal gdpr".split()
AD_NAMES = "ad ads advert advertisement sponsor sponsored promo adsbygoogle".split()
COMMENT_NAMES = "comments comment-list comment discussion replies disqus responses".split()
MENU_NAMES = "menu nav navbar navigation topnav breadcrumb breadcrumbs links".split()
HEAD_NAMES = "header masthead site-header topbar top".split()
FOOT_NAMES = "footer site-footer bottom legal copyright".split()
FRAME_NAMES = "wrapper page container site layout".split()
FORM_NAMES = "search login subscribe newsletter".split()
REPLY_NAMES = "comment reply comment-body".split()
KNOWN = frozenset(x for names in (MAIN_NAMES, SIDE_NAMES, NOTICE_NAMES, AD_NAMES, COMMENT_NAMES, MENU_NAMES, HEAD_NAMES, FOOT_NAMES, FRAME_NAMES, FORM_NAMES, REPLY_NAMES, ["hidden"]) for n in names for x in n.split("-"))
TAGS = frozenset("p div span li td th tr table ul ol dl dt dd h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption caption body html address details summary center noscript".split()) | set(SECTIONS)


class Element:
    """An open element: tag, parent, and the tags and known names of it and its ancestors, shared with the parent where it adds none."""

    __slots__ = ("tag", "parent", "tags", "names", "nearest")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None):
        self.tag, self.parent = tag, parent
        tags, known = (parent.tags, parent.names) if parent else (frozenset(), frozenset())
        self.tags = tags if tag in tags or tag not in TAGS else tags | {tag}
        new = KNOWN.intersection(names)
        self.names = known if new <= known else known | new
        self.nearest = tag if tag in SECTIONS else parent.nearest if parent else ""


ROOT = Element("none", (), None)


def blocks(page: str) -> list[tuple[str, Element, float]]:
    """Leaf blocks in page order: text, the innermost block-level element, share of linked characters."""
    out: list[tuple[str, Element, float]] = []
    stack: list[Element] = []  # open elements, and the innermost block-level one at each
    blocky: list[Element] = []
    places: dict[str, list[int]] = {}  # of each tag on the stack
    bounds: list[int] = []
    text: list[str] = []
    linked = at = links = 0
    unclosed: set[str] = set()

    def flush():
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            out.append((words, blocky[-1] if blocky else ROOT, min(1.0, linked / len(words))))
        text.clear()
        linked = 0

    def close(down_to: int):
        nonlocal links
        flushed = False
        while len(stack) > down_to:
            tag = stack[-1].tag
            if tag not in INLINE and not flushed:
                flush()
                flushed = True
            links -= tag == "a"
            places[tag].pop()
            if bounds and bounds[-1] == len(stack) - 1:
                bounds.pop()
            stack.pop()
            blocky.pop()

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        run = page[at : m.start()] if m else page[at:]
        if run:
            text.append(html.unescape(run) if "&" in run else run)
            if links:
                linked += len(run.strip())
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            i = last(tag)
            if i >= 0 and not (tag in INLINE or tag in ("p", "li")):
                close(i)
            elif i >= 0 and (not bounds or bounds[-1] <= i):
                close(i)
            continue
        if tag in ("br", "hr", "img"):
            text.append(" ")
        if tag in CLOSES_P and (i := last("p")) >= 0 and (not bounds or bounds[-1] < i):
            close(i)
        if tag in SIBLINGS and (i := last(*SIBLINGS[tag])) >= 0 and last(*LISTS) < i:
            close(i)
        if tag in RAW or tag in SKIP:
            if tag != "button" and tag not in INLINE:
                flush()
            if not m.group(3).rstrip().endswith("/"):
                end = _end(page, tag, at, unclosed)
                at = end if end >= 0 else size if tag in RAW else at
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        parent = blocky[-1] if blocky else ROOT
        element = Element(tag, _names(m.group(3)) if m.group(3) else (), parent)
        if tag in BOUNDS:
            bounds.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
        blocky.append(parent if tag in INLINE else element)
        links += tag == "a"
    flush()
    return out


@lru_cache(maxsize=64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>?", re.I | re.A)


def _end(page: str, tag: str, at: int, unclosed: set[str]) -> int:
    """The place after the end tag of an element whose content begins at ``at``, or -1; ``unclosed``: tags without a further end."""
    if tag in unclosed:
        return -1
    depth, first = 1, -1
    for m in _ends(tag).finditer(page, at):
        if m.group(1):
            depth -= 1
            first = m.end() if first < 0 else first
            if not depth or tag in RAW or tag + "/" in unclosed:
                return m.end()
        elif tag in ("svg", "template") and not m.group().endswith("/>"):
            depth += 1
    unclosed.add(tag if first < 0 else tag + "/")  # nested ones that do not match end at the first end from now on
    return first


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key in ("class", "id", "role", "itemprop"):
            found += NAME.findall(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.append("hidden")
    return tuple(found)


def _bucket(words: int) -> int:
    return min(words, 64).bit_length()


def features(found: list[tuple[str, Element, float]]) -> list[list[str]]:
    """Feature names of each block: ancestors, class words, the text's own, those of the blocks beside it and of the page."""
    out = []
    n = len(found)
    words = [text.count(" ") + 1 for text, _, _ in found]
    size = [f"{_bucket(w)}" for w in words]
    link = [f"{int(4 * share)}" for _, _, share in found]
    ended = ["e" if text[-1] in ".!?" else "x" for text, _, _ in found]
    within: dict[int, int] = {}  # words in blocks of one container
    for (_, own, _), w in zip(found, words, strict=True):
        within[id(own.parent)] = within.get(id(own.parent), 0) + w
    most = max(within.values(), default=0)
    frames = {t: any(t in own.tags for _, own, _ in found) for t in ("article", "main")}
    framed = any(frames.values())
    shared: dict[int, list[str]] = {}
    for i, (text, own, _) in enumerate(found):
        fixed = shared.get(id(own))
        if fixed is None:
            above = own.tags if own.tag in SECTIONS else own.parent.tags if own.parent else frozenset()
            named = "named" if own.names else "bare"
            fixed = ["tag=" + (own.tag if own.tag in TAGS else "other" if own.parent else "none"), *("in=" + t for t in above), *("name=" + x for x in own.names)]
            if own.nearest:
                fixed += ["nearest=" + own.nearest, f"nearest={own.nearest},{named}"]
            fixed += [f"{t}={t in own.tags}" for t, there in frames.items() if there]
            if not framed:
                fixed += ["unframed", f"unframed,{named}", "unframed,in=" + (own.nearest or "none"), f"unframed,tag={own.tag if own.tag in TAGS else 'other'}"]
            whole = within[id(own.parent)]
            fixed += [f"within{min(whole, 500).bit_length()}", "within_most" if whole == most else f"within_share{int(4 * whole / most)}"]
            shared[id(own)] = fixed
        mine = ["bias", "words" + size[i], "link" + link[i], f"words{size[i]},link{link[i]}", "end" + (text[-1] if text[-1] in ".!?:,;" else "x"), *fixed]
        if not framed:
            mine += [f"unframed,words{size[i]},{ended[i]}", f"unframed,link{link[i]}"]
        if i == 0:
            mine.append("first")
        else:
            mine += [f"before{size[i - 1]},{link[i - 1]}", "before=" + found[i - 1][1].tag]
            if found[i - 1][1].parent is own.parent:
                mine.append("beside")
                if found[i - 1][1].tag == own.tag:
                    mine.append("same_path")
        if i == n - 1:
            mine.append("last")
        else:
            mine.append(f"after{size[i + 1]},{link[i + 1]}")
        if n == 1:
            mine.append("only")
        if "\N{COPYRIGHT SIGN}" in text:
            mine.append("copyright")
        out.append(mine)
    return out


def extract(page: str | None, model: tuple) -> str:
    """Main text of a page: chosen blocks in page order, one per line; empty if there is none."""
    found = blocks(page) if page else []
    labels = viterbi(features(found), model)
    return "\n".join(b[0] for b, keep in zip(found, labels, strict=True) if keep)


class _Writer:
    """Generated pages and the label of each of their leaf blocks, found by a mark in the text."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.parts: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción ño für ß eau que".split()
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 60) -> str:
        return self.words(low, high).capitalize() + self.rng.choice([".", ".", ".", "!", "?", "", ".###", ".&amp;&amp;&amp;"])

    def strange(self) -> str:
        """A class that says nothing."""
        rng = self.rng
        return rng.choice([f"{rng.choice('abcdefgjkqxz')}{rng.randint(1, 99)}", f"{self.words(1, 1)}-{self.words(1, 1)}", self.words(1, 1), f"css-{rng.randrange(1 << 24):x}"])

    def put(self, markup: str, *labels: int):
        self.parts.append(markup)
        self.labels += labels


def training_pages(n: int = 700, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Generated pages of many layouts with a label (1: main text) for each leaf block."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = _Writer(rng)
        attr = lambda names: f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'
        semantic = rng.random() < 0.5
        strange = lambda: rng.choice(["", "", f' class="{w.strange()}"', f' class="{w.strange()} {w.strange()}"', f' id="{w.strange()}"'])

        def menu():
            k = rng.randint(2, 7)
            items = "".join(f'<li><a href="/x">{w.words(1, 3)}</a></li>' for _ in range(k))
            cells = items.replace("<li>", "<td>").replace("</li>", "</td>")
            w.put(rng.choice([f"<div{strange()}><ul>{items}</ul></div>", f"<ul{strange()}>{items}</ul>", f"<table><tr>{cells}</tr></table>", f"<nav><ul>{items}</ul></nav>", f"<nav><ul>{items}</ul></nav>", f"<nav{attr(MENU_NAMES)}><ul>{items}</ul></nav>", f"<div{attr(MENU_NAMES)}><ul>{items}</ul></div>"]), *[0] * k)

        def head():
            tag = "header" if semantic or rng.random() < 0.5 else "div"
            name = attr(HEAD_NAMES) if tag == "div" or rng.random() < 0.5 else ""
            w.put(f"<{tag}{name}><div>{w.words(1, 4)}</div><p>{w.words(2, 8)}</p></{tag}>", 0, 0)

        def advert():
            w.put(f'<div{attr(AD_NAMES)}>{w.sentence(3, 25)}</div>', 0)

        def notice():
            tag = rng.choice(["div", "div", "section", "aside"])
            w.put(f"<{tag}{attr(NOTICE_NAMES)}><p>{w.sentence(4, 30)}</p></{tag}>", 0)

        def side():
            tag = rng.choice(["aside", "aside", "div"])
            name = attr(SIDE_NAMES) if tag == "div" or rng.random() < 0.6 else ""
            k = rng.randint(1, 4)
            inner = "".join(rng.choice([f"<p>{w.sentence(2, 30)}</p>", f'<p><a href="#">{w.words(2, 9)}</a></p>']) for _ in range(k))
            w.put(f"<{tag}{name}><h3>{w.words(1, 3)}</h3>{inner}</{tag}>", *[0] * (k + 1))

        def form():
            w.put(f'<form action="/go"{rng.choice(["", attr(FORM_NAMES)])}><label>{w.words(1, 4)}</label><input name="q"><p>{w.sentence(2, 12)}</p></form>', *[0, 0])

        def comments():
            k = rng.randint(1, 5)
            tag = rng.choice(["section", "div", "div"])
            kind = rng.choice(["li", "div", "p", "article"])
            box = f"<{kind}{rng.choice(['', attr(REPLY_NAMES)])}>"
            items = "".join(f"{box}{rng.choice(['<p>' + w.sentence(2, 40) + '</p>', w.sentence(2, 40)])}</{kind}>" for _ in range(k))
            items = f"<ul>{items}</ul>" if kind == "li" else items
            w.put(f"<{tag}{attr(COMMENT_NAMES)}><h3>{w.words(1, 3)}</h3>{items}</{tag}>", *[0] * (k + 1))

        def foot():
            tag = "footer" if semantic or rng.random() < 0.5 else "div"
            name = attr(FOOT_NAMES) if tag == "div" or rng.random() < 0.3 else ""
            mark = rng.choice(["&copy; ", "&copy; ", ""])
            w.put(f"<{tag}{name}>{mark}{w.words(1, 3)} &middot; {w.sentence(2, 15)}</{tag}>", 0)

        def inline():
            return rng.choice([f" <math><mi>{w.words(1, 1)}</mi></math> ", f" <button>{w.words(1, 1)}</button> ", " <svg><title>x</title></svg> ", f" <em>{w.words(1, 3)}</em> ", " "]) if rng.random() < 0.2 else " "

        def paragraph():
            kind = rng.random()
            body = w.sentence(1, 80)
            if kind < 0.62:
                w.put(rng.choice([f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<p>{w.words(1, 9)} <a href='/y'>{w.words(1, 3)}</a> {body}</p>", f"<p>{w.words(1, 9)}{inline()}{body}</p>"]), 1)
            elif kind < 0.66:
                w.put(rng.choice([f"<div{strange()}>{body}</div>", f"<noscript><p>{body}</p></noscript>", f"<figure><figcaption>{body}</figcaption></figure>", f"<section{strange()}><p>{body}</p></section>"]), 1)
            elif kind < 0.74:
                k = rng.randint(1, 4)
                tag = rng.choice(["ul", "ol"])
                w.put(f"<{tag}>" + "".join(f"<li>{w.sentence(2, 20)}</li>" for _ in range(k)) + f"</{tag}>", *[1] * k)
            elif kind < 0.84:
                w.put(f"<h2>{w.words(1, 8)}</h2>", 1)
            elif kind < 0.9:
                w.put(f"<blockquote><p>{body}</p></blockquote>", 1)
            elif kind < 0.95:
                w.put(f"<pre>{w.words(3, 20)}</pre>", 1)
            else:
                k = rng.randint(1, 4)
                w.put("<table>" + "".join(f"<tr><td>{w.words(1, 4)}</td></tr>" for _ in range(k)) + "</table>", *[1] * k)

        bare = rng.random()
        if bare < 0.06:  # text without a frame
            k = rng.randint(1, 6)
            w.put(rng.choice(["<p>", "<p>", ""]).join(["", *(w.sentence(2, 60) + "</p>" if k > 1 else w.sentence(2, 60) for _ in range(k))]) if k > 1 else w.sentence(1, 60), *[])
            w.labels += [1] * len(blocks("".join(w.parts)))
            out.append(("".join(w.parts), w.labels))
            continue
        w.put("<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        plain = bare < 0.2  # a title and paragraphs, no other parts
        if rng.random() < 0.3:
            w.put(f'<div id="{rng.choice([*FRAME_NAMES, w.strange()])}">')
        for part in (head, menu, advert, notice, side, form):
            if not plain and rng.random() < 0.5:
                part()
        box = rng.choice(["article", "main", "both", "div", "div", "strange", "strange"]) if not semantic else rng.choice(["article", "article", "main", "both"])
        name = attr(MAIN_NAMES) if box == "div" or rng.random() < 0.4 else ""
        opened = {"article": f"<article{name}>", "main": f"<main{name}>", "both": f"<main><article{name}>", "div": f"<div{name}>", "strange": ""}[box]
        closed = {"article": "</article>", "main": "</main>", "both": "</article></main>", "div": "</div>", "strange": ""}[box]
        if box == "strange":
            for _ in range(rng.randint(1, 4)):
                tag = rng.choice(["div", "div", "div", "section"])
                opened, closed = f"{opened}<{tag}{strange()}>", f"</{tag}>{closed}"
        if box == "div" and rng.random() < 0.25:  # no container at all
            opened = closed = ""
        w.put(opened)
        if rng.random() < 0.9:
            w.put(rng.choice([f"<h1>{w.words(1, 12)}</h1>", f"<h1>{w.sentence(1, 12)}</h1>", f"<header><h1>{w.words(1, 12)}</h1></header>", f"<h2{strange()}>{w.words(1, 12)}</h2>"]), 1)
        for _ in range(rng.randint(1, 14)):
            paragraph()
            if rng.random() < 0.1 and not plain:
                rng.choice([advert, advert, side, notice, form])()
        w.put(closed)
        for part in (comments, side, advert, form, notice, menu):
            if not plain and rng.random() < 0.4:
                part()
        if rng.random() < 0.9 and not plain:
            foot()
        w.put("</body></html>")
        out.append(("".join(w.parts), w.labels))
    return out


@lru_cache(maxsize=1)
def train() -> tuple:
    """The field's weights, trained on the generated pages."""
    pages = [(features(blocks(page)), labels) for page, labels in training_pages()]
    for x, y in pages:
        if len(x) != len(y):
            raise ValueError("a generated page has other blocks than labels")
    return _crf.train(pages)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for each row of ``pages``.

    A null page is empty and its text is empty, as is that of a page without main text.  Ids and urls may be
    null or repeat; each row returns.  Other columns are not read.  An empty table returns no rows.
    """
    model = train()
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for batch in batches:
            texts = pa.array([extract(page, model) for page in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    ready(pages.sparkSession)
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
