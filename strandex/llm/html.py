"""Main text of web pages: boosted trees over the nodes of the document tree, decoded from the root down."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandex.llm import boosting
from strandex.llm.common import table

#: Training pages, which are invented, and their seed.
PAGES, SEED = 1200, 5

# Fixed values of HTML.
_RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Elements of drawings and formulas; there, and only there, a slash before ">" closes any element.
_FOREIGN = frozenset("svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "svg g path circle rect line polygon polyline ellipse text tspan defs use symbol desc math semantics annotation mrow mi mo mn ms mtext mspace mfrac msqrt mroot msup msub msubsup "
    "munder mover munderover mfenced mstyle mpadded mtable mtr mtd object a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tr td th tbody thead tfoot", "table"), "tfoot": ("tr td th tbody thead", "table"), "option": ("option", "select"), "body": ("head", "html"),
}
_SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SIBLINGS.items()}
_SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol dl figure blockquote".split())

_PART = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+|(?<=[a-z])[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "runs", "depth", "block")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.runs: list[tuple[str, bool]] = []  # text, and whether it is in a link
        self.depth = 0 if parent is None else parent.depth + 1
        self.block = 0  # leaves of one number are one run of inline content, cut only at inline elements that are nodes
        if parent is not None:
            parent.children.append(self)


def _tidy(parts: Iterable[str]) -> str:
    return " ".join("".join(parts).split())


def parse(html: str) -> Node:
    """The tree of block elements and of inline ones that an attribute calls an advert or hidden.

    Text is in leaves ``#text``, a leaf for each run of inline content between such elements.
    """
    root = Node("#root", "", None)
    stack: list[tuple[str, Node]] = [("#root", root)]  # open elements, with the block that each is or is in
    leaf: Node | None = None
    block, begun = 0, -1  # the run of inline content that text is in, and the last that has a leaf
    links, at, n = 0, 0, len(html)

    def text(part: str) -> None:
        nonlocal leaf, begun
        if part:
            if leaf is None:
                if part.isspace() and begun != block:
                    return
                leaf = Node("#text", "", stack[-1][1])
                leaf.block = begun = block
            leaf.runs.append((unescape(part) if "&" in part else part, links > 0))

    def end_run() -> None:
        nonlocal leaf, block
        leaf = None
        block += 1

    def close(to: int) -> None:
        nonlocal leaf, links
        for i in range(to, len(stack)):
            tag, node = stack[i]
            links -= tag == "a"
            if tag not in _INLINE:
                end_run()
            elif node is not stack[i - 1][1]:
                leaf = None
        del stack[to:]

    def close_to(tags: frozenset, within: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                close(i)
                return
            if stack[i][0] in within:
                return

    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            text(html[at:])
            break
        found = _PART.match(html, begin)
        if found is None:  # a plain "<"
            text(html[at : begin + 1])
            at = begin + 1
            continue
        text(html[at:begin])
        at = found.end()
        if found[2] is None:
            continue
        tag, attrs = found[2].lower(), found[3]
        if found[1]:
            if tag == "br":
                text(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i][0] in _SCOPES:
                    break
            continue
        if tag in _VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                end_run()
            continue
        if attrs.endswith("/") and (tag in _FOREIGN or any(t in _FOREIGN for t, _ in stack)):
            continue
        if tag in _RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if tag == "xmp":  # its text is shown, as it stands
                    end_run()
                    text(html[at : end.start() if end else n].replace("&", "&amp;"))
                at = end.end() if end else n
            if tag != "script":
                end_run()
            continue
        if tag in _INLINE:
            links += tag == "a"
            telling = bool(_NAMED.search(attrs)) and _telling(attrs)
            leaf = None if telling else leaf
            stack.append((tag, Node(tag, attrs, stack[-1][1]) if telling else stack[-1][1]))
            continue
        if tag in _CLOSES_P:
            close_to(frozenset(["p"]), frozenset(["td", "th", "table", "button", "#root"]))
        if tag in _SIBLINGS:
            close_to(*_SIBLINGS[tag])
        end_run()
        stack.append((tag, Node(tag, attrs, stack[-1][1])))
    return root


# -- features -------------------------------------------------------------------------------------------------------

_TAGS = (
    "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "table tbody tr td th",
    "figure figcaption", "blockquote pre", "button fieldset legend dialog", "body html #root head", "#text",
)
_TAG = {t: i for i, group in enumerate(_TAGS) for t in group.split()}
#: Words of class, id and role attributes, by what they tell.
_HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip",
    "head": "header masthead banner branding logo top",
    "foot": "footer foot copyright colophon legal bottom imprint contentinfo",
    "side": "sidebar side aside related widget rail complementary recommended popular trending more teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall message dialog warning",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp adsense",
    "comment": "comment comments reply replies respond disqus discussion thread feedback reader",
    "main": "article content main post entry story body text page prose single document detail hentry articlebody",
    "share": "share sharing social tags meta byline author date toolbar rating print follow",
    "form": "form search login input field contact",
}
_HINT = {}
for _i, _words in enumerate(_HINTS.values()):
    for _w in _words.split():
        _HINT.setdefault(_w, []).append(_i)
N_HINTS, N_TAGS = len(_HINTS), len(_TAGS)


_SEEN: dict[str, tuple[float, ...]] = {}


def _hints(attrs: str) -> tuple[float, ...]:
    if attrs in _SEEN:
        return _SEEN[attrs]
    out = [0.0] * (N_HINTS + 1)
    for name, value in _ATTRIBUTE.findall(attrs):
        if name.lower() == "hidden" and value.strip("\"'").lower() != "false":
            out[N_HINTS] = 1.0
        for w in _WORD.findall(value):
            for i in _HINT.get(w.lower(), ()):
                out[i] = 1.0
    if "display:none" in attrs.replace(" ", ""):
        out[N_HINTS] = 1.0
    if len(_SEEN) < 4096:
        _SEEN[attrs] = tuple(out)
    return tuple(out)


_AD = list(_HINTS).index("ad")
_NAMED = re.compile(r"class|id|role|hidden|display", re.I)


def _telling(attrs: str) -> bool:
    """Whether an inline element is a node: its attributes say advert, or that it isn't shown."""
    hints = _hints(attrs)
    return bool(hints[_AD] or hints[N_HINTS])


def flatten(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: its tag and attribute words, those above it, depth, siblings, and densities of its subtree."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    chars, linked, words, stops, texts, size, paras = (np.zeros(n) for _ in range(7))
    for i, x in enumerate(nodes):
        for run, link in x.runs:
            k = len(run)
            chars[i] += k
            linked[i] += k * link
            words[i] += run.count(" ") + 1
            stops[i] += run.count(".") + run.count(",") + run.count("!") + run.count("?")
        texts[i] = x.tag == "#text"
        paras[i] = x.tag == "p"
        size[i] = 1
    before = np.concatenate([[0.0], np.cumsum(chars)[:-1]])
    parent = np.array([-1 if x.parent is None else at[id(x.parent)] for x in nodes])
    for i in range(n - 1, 0, -1):
        up = parent[i]
        for a in (chars, linked, words, stops, texts, size, paras):
            a[up] += a[i]
    total = max(1.0, chars[0])
    out = np.zeros((n, N_FEATURES))
    places, tags = np.zeros(n, dtype=int), {}  # the number of a node among its siblings; how many of a tag a parent has
    for x in nodes:
        for k, s in enumerate(x.children):
            places[at[id(s)]] = k
            tags[id(x), s.tag] = tags.get((id(x), s.tag), 0) + 1
    for i, x in enumerate(nodes):
        up = parent[i]
        row = out[i]
        if x.tag in _TAG:
            row[_TAG[x.tag]] = 1
        row[N_TAGS : N_TAGS + N_HINTS + 1] = _hints(x.attrs) if x.attrs else 0.0
        above = N_TAGS + N_HINTS + 1
        if up >= 0:  # what is above: the nearest sets the tags, any sets the hints
            row[above : above + N_TAGS] = np.maximum(out[up, above : above + N_TAGS], out[up, :N_TAGS])
            tail = above + N_TAGS
            row[tail : tail + N_HINTS + 1] = np.maximum(out[up, tail : tail + N_HINTS + 1], out[up, N_TAGS : N_TAGS + N_HINTS + 1])
            k, m, same = places[i], len(x.parent.children), tags[id(x.parent), x.tag]
            beside = chars[up] - chars[i]
            place = (k / m, min(m, 50), same / m, chars[i] / max(1.0, chars[up]), np.log1p(beside))
        else:
            place = (0.0, 1.0, 1.0, 1.0, 0.0)
        c = max(1.0, chars[i])
        row[-16:] = (
            x.depth, np.log1p(chars[i]), linked[i] / c, words[i] / max(1.0, texts[i]), 100 * stops[i] / c, c / size[i], np.log1p(size[i]), np.log1p(paras[i]),
            before[i] / total, chars[i] / total, np.log1p(texts[i]), *place,
        )
    return out


N_FEATURES = 2 * (N_TAGS + N_HINTS + 1) + 16


# -- decoding -------------------------------------------------------------------------------------------------------


def decode(nodes: list[Node], logit: np.ndarray) -> list[bool]:
    """The likeliest choice of kept nodes in which nothing is kept below a node that goes."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    keep = -np.logaddexp(0, -logit)
    drop = -np.logaddexp(0, logit)
    for i in range(n - 1, 0, -1):
        up = at[id(nodes[i].parent)]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[at[id(nodes[i].parent)]] and bool(keep[i] >= drop[i])
    return kept


def main_texts(pages: list[str | None], model: boosting.Trees) -> list[str]:
    """The main text of each page; the nodes of all of them are judged at once."""
    trees = [flatten(parse(h or "")) for h in pages]
    if not trees:
        return []
    logit = model.logit(np.vstack([features(t) for t in trees]))
    out, at = [], 0
    for nodes in trees:
        kept = decode(nodes, logit[at : at + len(nodes)])
        at += len(nodes)
        out.append(_joined(nodes, kept))
    return out


def _joined(nodes: list[Node], kept: list[bool]) -> str:
    """The text of the kept leaves: those of one run as one block, blocks joined by one space."""
    gone = {id(x) for x, k in zip(nodes, kept) if not k}
    blocks: dict[int, list[str]] = {}
    for x in nodes:
        if x.tag != "#text":
            continue
        parts = [r for r, _ in x.runs]
        # white space between two inline nodes goes with what holds it, whatever its own leaf is judged to be
        if id(x) not in gone or (id(x.parent) not in gone and not "".join(parts).strip()):
            blocks.setdefault(x.block, []).extend(parts)
    return " ".join(filter(None, map(_tidy, blocks.values())))


# -- invented pages to learn from -----------------------------------------------------------------------------------


def invent(rnd: random.Random) -> str:
    """A page in which every element of the main text, and nothing else, is marked by a leading ``\\x01`` in its text."""
    vocab = ["".join(rnd.choice("aeioubcdfglmnprst") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    junk = rnd.choice(["", "", "", "!!", "***", "&amp;&amp;"])

    def sentence(low: int, high: int) -> str:
        words = [rnd.choice(vocab) + (junk if rnd.random() < 0.5 else "") for _ in range(rnd.randint(low, high))]
        text = " ".join(words)
        return (text.upper() if junk == "!!" else text.capitalize()) + rnd.choice([".", ".", ".", "", "!", "?"])

    def prose(low: int, high: int) -> str:
        return " ".join(sentence(2, 18) for _ in range(rnd.randint(low, high)))

    def inline(text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and rnd.random() < 0.3:
            i = rnd.randrange(len(words))
            words[i] = rnd.choice(["<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<code>{}</code>", "{}<br>"]).format(words[i])
        if len(words) > 2 and rnd.random() < 0.08:  # an advert or something unseen within a paragraph
            tag, word = rnd.choice(["span", "span", "a", "em", "small"]), rnd.choice(_HINTS["ad"].split())
            attrs = rnd.choice([f'class="{word}"', f'class="x {word}-{rnd.choice("abc")}"', f'id="{word}{rnd.randint(1, 9)}"', "hidden", 'style="display:none"'])
            words.insert(rnd.randint(1, len(words)), f"<{tag} {attrs}>{sentence(1, rnd.choice([4, 12]))}</{tag}>{mark}")
        return " ".join(words)

    def wrap(kind: str, tags: str, body: str) -> str:
        tag = rnd.choice(tags.split())
        word = rnd.choice(_HINTS[kind].split())
        mark = rnd.choice(["", f' class="{word}"', f' class="x {word}-{rnd.choice("abc")}"', f' id="{word}"']) if tag not in ("div", "section", "p") else rnd.choice(
            [f' class="{word}"', f' class="{word} box"', f' id="{word}{rnd.randint(1, 9)}"', f' class="site-{word}"']
        )
        if kind != "main" and rnd.random() < 0.05:
            mark = rnd.choice([" hidden", ' style="display:none"', ' aria-hidden="true"'])
        return f"<{tag}{mark}>{body}</{tag}>"

    def links(n: int) -> str:
        items = [f"<a href='/{i}'>{rnd.choice(vocab)}</a>" for i in range(rnd.randint(2, n))]
        return rnd.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()

    def boiler(kind: str) -> str:
        short = lambda: rnd.choice([f"<p>{sentence(2, 20)}</p>", sentence(2, 25), f"<div>{sentence(3, 20)}</div>", sentence(1, 5) + "\n" + sentence(1, 12)])
        if kind == "menu":
            return wrap("menu", "nav nav div ul", links(9))
        if kind == "head":
            return wrap("head", "header header div", rnd.choice([f"<h1>{sentence(1, 4)}</h1>", f"<a href='/'>{sentence(1, 3)}</a>", ""]) + rnd.choice(["", links(6), f"<p>{sentence(2, 7)}</p>"]))
        if kind == "foot":
            return wrap("foot", "footer footer div", rnd.choice(["", "&copy; www.example.com &middot; "]) + rnd.choice(["", links(6), short()]) + short())
        if kind == "side":
            return wrap("side", "aside aside div", rnd.choice(["", f"<h3>{sentence(1, 3)}</h3>"]) + rnd.choice([links(9), short() + short(), f"<p>{prose(1, 4)}</p>"]))
        if kind == "notice":
            return wrap("notice", "div div section", short() + rnd.choice(["", "<button>OK</button>"]))
        if kind == "ad":
            return "<!-- ad -->" + wrap("ad", "div div div aside", rnd.choice([short(), prose(1, 4), f"<a href='/ad'>{sentence(2, 9)}</a>", short()]))
        if kind == "form":
            return f"<form action='/s'{rnd.choice(['', ' class=search'])}><label>{sentence(1, 3)}</label><input name=q>{short()}<button>{rnd.choice(vocab)}</button></form>"
        if kind == "share":
            return wrap("share", "div div p ul", links(5) if rnd.random() < 0.6 else sentence(1, 6))
        head = rnd.choice(["", f"<h3>{sentence(1, 3)}</h3>"])
        some = "".join(rnd.choice(["<li class=comment><p>{}</p></li>", "<div class='comment'>{}</div>", "<article class='comment'><p>{}</p></article>"]).format(prose(1, 5)) for _ in range(rnd.randint(1, 5)))
        return wrap("comment", "section div div ul", head + some)

    def some(*kinds: str) -> str:
        return "".join(boiler(k) for k in kinds if rnd.random() < 0.6)

    mark = "\x01"
    brief = rnd.random() < 0.4  # main text that is shorter than what surrounds it
    if brief:
        whole = prose
        prose = lambda low, high: sentence(1, 9)
    parts = [f"<h1>{mark}{sentence(1, 9)}</h1>"] if rnd.random() < 0.8 else []
    for _ in range(rnd.choice([0, 0, 1] if brief else [0, 1, 1, 2, 3, 5, 9, 14])):
        kind = rnd.random()
        if kind < 0.72:
            parts.append(f"<p>{mark}{inline(prose(1, rnd.choice([1, 1, 3, 9])))}" + rnd.choice(["</p>", "</p>", ""]))
        elif kind < 0.78:
            parts.append(f"<{(h := rnd.choice(['h2', 'h3', 'h4']))}>{mark}{sentence(1, 6)}</{h}>")
        elif kind < 0.84:
            parts.append("<ul>" + "".join(f"<li>{mark}{inline(sentence(2, 12))}</li>" for _ in range(rnd.randint(2, 6))) + "</ul>")
        elif kind < 0.88:
            parts.append(f"<blockquote><p>{mark}{prose(1, 3)}</p></blockquote>")
        elif kind < 0.91:
            parts.append("<table>" + "".join(f"<tr><td>{mark}{sentence(1, 4)}</td><td>{mark}{sentence(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.93:
            parts.append(f"<div>{mark}{inline(prose(1, 4))}</div>")
        elif kind < 0.95:
            parts.append(f"<figure><img src=x><figcaption>{mark}{sentence(2, 9)}</figcaption></figure>")
        else:
            parts.append(some(rnd.choice(["ad", "share", "side", "notice"])))
    if rnd.random() < 0.35:
        parts.insert(len(parts) and 1, f"<p><b>{mark}{prose(1, 4)}<br>")
    if not any(mark in x for x in parts):
        parts.append(f"<p>{mark}{prose(1, 4)}</p>")
    if brief:
        prose = whole
    body = "".join(parts)
    holder = rnd.choice(["article"] * 5 + ["main", "div", "section", "none"])
    inside = rnd.random()
    if inside < 0.25:
        body += some("share", "comment")
    elif inside < 0.35:
        body = some("ad", "share") + body
    if holder == "article":
        body = f"<article{rnd.choice(['', '', ' class=post', ' id=story'])}>{body}</article>"
    elif holder == "main":
        body = f"<main>{body}</main>"
    elif holder != "none":
        body = wrap("main", holder, body)
    if rnd.random() < 0.3:
        body = rnd.choice(["<main>{}</main>", '<div class="container">{}</div>', "<div id=wrapper><div>{}</div></div>"]).format(body + some("side", "comment"))
    page = some("notice", "head", "menu", "ad", "form") + body + some("comment", "side", "ad", "form", "notice", "foot")
    return f"<html><head><title>{sentence(1, 5)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{page}" + rnd.choice(["</body></html>", ""])


@lru_cache(maxsize=1)
def default_model(pages: int = PAGES, seed: int = SEED) -> boosting.Trees:
    """Trained on invented pages: a node is kept if main text is in it."""
    rnd = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = flatten(parse(invent(rnd)))
        good = {}
        for node in reversed(nodes):
            good[id(node)] = any("\x01" in r for r, _ in node.runs) or any(good[id(c)] for c in node.children)
        for node in nodes:
            node.runs = [(r.replace("\x01", ""), link) for r, link in node.runs]
        xs.append(features(nodes))
        ys += [good[id(node)] for node in nodes]
    return boosting.train(np.vstack(xs), np.array(ys, dtype=np.float64), rounds=100, depth=4)


def extract(pages: DataFrame, model: boosting.Trees | None = None, id_col: str = "page_id", html_col: str = "html", out: str = "text", batch: int = 256) -> DataFrame:
    """``pages`` with the column ``out``, the main text of each page: no shuffle, whole pages, ``batch`` of them judged at once.

    The text is that of the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles, markup and comments. Character references are decoded, white space in a block is one space, blocks are
    joined by one. Inline elements that attributes call an advert or hidden are judged as blocks are, and what is left of their
    block stays one. Null and empty pages, and pages without main text, give the empty text; broken markup is read as
    far as it goes, and a page of any length is read whole. Each row is judged by its page alone, so rows that repeat
    get the same text; an empty table gives no rows. A column of ``pages`` that is named as ``out`` gives way to it.
    """
    model = model or default_model()

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            found: list[str] = []
            for at in range(0, len(html), batch):
                found += main_texts(html.iloc[at : at + batch].tolist(), model)
            yield pd.Series(found, dtype=object)

    return pages.withColumn(out, F.pandas_udf(texts, "string")(F.col(html_col)))


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
