"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, inline markup and formulas joined; scripts,
styles, controls and drawings left out. A block's features are its ancestors' tags and class or id words, and its text: length, links, punctuation,
notices' words. A CRF with the labels main and other, trained by stochastic gradient ascent on labelled pages, scores
blocks and neighbouring labels; Viterbi decodes a whole page.

Labelled pages are made by :func:`labelled_pages`: page layouts with known main and other blocks (menus, headers,
sidebars, notices, adverts, forms, comments), a bounded number given by a parameter and drawn from a fixed seed.

Edge cases: a null or empty page, or one without text, gives the empty string; unclosed and stray tags are tolerated,
an unclosed comment, script, style, textarea, iframe or noscript reaches to the end of the page, any other element left out to its
parent's end or a tag that it cannot hold; repeated rows are treated alike; an empty table gives
no rows; other columns are not read. Whole pages are parsed, whatever their length.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

PAGES = 480
FEATURES = 1 << 12
#: Inline tags do not end a block; void tags have no content; raw and left-out ones hold no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
                   "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
                   "mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea".split())
LEFT_OUT = frozenset("template svg head object canvas select optgroup option button annotation annotation-xml".split())
#: What a head may hold; tags that end an open drawing, control or list of choices when they begin inside it.
IN_HEAD = frozenset("title meta link base basefont bgsound command".split())
ENDS_SVG = frozenset("article aside blockquote body center code dd div dl dt em footer h1 h2 h3 h4 h5 h6 header hr img li main menu nav ol p pre section span strong sub sup table ul".split())
ENDS_CHOICE = frozenset("article aside blockquote body footer form h1 h2 h3 h4 h5 h6 header input main nav ol p pre section table textarea ul".split())
ENDS_BUTTON = frozenset("article aside body button footer form header main nav section".split())
#: Tags whose open paragraphs or items end when another begins.
CLOSES = {"option": ("option",), "optgroup": ("option", "optgroup"), "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Where the search for an element to end stops.
ENDS_INLINE = frozenset("p div td li article section body template".split())
ENDS_IMPLIED = frozenset("table ul ol dl div article section aside main body".split()) | LEFT_OUT
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NOTICE = re.compile(r"\b(?:cookie|copyright|©|all rights|subscribe|newsletter|sign up|log ?in|privacy|terms|advert|sponsor|share|follow us|comment|reply|related|read more)", re.I)

Block = tuple[str, tuple[str, ...], float]


@lru_cache(4096)
def named(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role."""
    out: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        out += re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower())
    return tuple(dict.fromkeys(out))


def blocks(page: str) -> list[Block]:
    """(text, ancestors' tags and words, share of the text in links) of the leaf blocks, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, at, end = 0, 0, len(page)
    hidden = -1  # place in the stack of the outermost element whose text is left out

    def flush() -> None:
        nonlocal linked
        t = " ".join(html.unescape("".join(text)).split())
        if t:
            shown = stack if hidden < 0 else stack[:hidden]
            marks = tuple(dict.fromkeys(w for tag, words in shown if tag not in INLINE for w in (f"<{tag}>", *words)))
            out.append((t, marks, min(1.0, linked / max(1, len(t)))))
        text.clear()
        linked = 0

    def cut(i: int) -> None:
        nonlocal hidden
        if hidden > i:
            flush()  # the text before the element that its parent's end closes
        if hidden >= i:
            hidden = -1
        del stack[i:]

    def pop(tag: str, stop: tuple[str, ...] | frozenset[str] = ()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                cut(i)
                return
            if stack[i][0] in stop:
                return

    def leave(tag: str) -> None:
        """End the elements left out that cannot hold the tag."""
        kinds = [t for t, _ in stack[hidden:]]
        if "template" in kinds:
            return
        if kinds[0] == "head":
            if tag not in IN_HEAD and tag != "head":
                cut(hidden)
        elif kinds[0] == "svg":
            if tag in ENDS_SVG and not {"foreignobject", "desc"} & set(kinds):
                cut(hidden)
        elif kinds[0] in ("select", "optgroup", "option"):
            if tag in ENDS_CHOICE or kinds[0] == tag == "select":
                cut(hidden)
        elif kinds[0] == "button" and tag in ENDS_BUTTON:
            cut(hidden)

    def add(piece: str) -> None:
        nonlocal linked
        if piece and hidden >= 0 and stack[-1][0] == "head" and piece.strip():
            cut(hidden)
        if piece and hidden < 0:
            text.append(piece)
            if any(tag == "a" for tag, _ in stack):
                linked += len(piece.strip())

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        tag, closing = m[1].lower(), page[m.start() + 1] == "/"
        alone = tag in VOID or m[2].rstrip().endswith("/")
        if hidden >= 0 and not closing and tag not in RAW | {"template"}:
            leave(tag)
        if not closing and (tag in RAW or tag == "title" and hidden >= 0):
            if not alone:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag in RAW:
                    at = end
                else:
                    stack.append((tag, ()))
            if hidden < 0:
                flush()
            continue
        if tag in LEFT_OUT and not closing:
            if hidden < 0 and tag not in ("button", "annotation", "annotation-xml"):
                flush()
            for other in CLOSES.get(tag, ()):
                pop(other, LEFT_OUT)
            if tag == "head" or not alone:
                hidden = len(stack) if hidden < 0 else hidden
                stack.append((tag, ()))
            continue
        if tag in INLINE:
            if closing:
                pop(tag, ENDS_INLINE)
            elif not alone or tag not in VOID and hidden < 0:
                stack.append((tag, named(m[2])))
            continue
        if hidden < 0:
            flush()
        if closing:
            pop(tag, ("template",) if hidden >= 0 and tag != "template" else ())
        elif not alone:
            for other in CLOSES.get(tag, ("p",) if tag in ENDS_P else ()):
                pop(other, ENDS_IMPLIED)
            stack.append((tag, named(m[2])))
    flush()
    return out


@lru_cache(1 << 16)
def slot(feature: str) -> int:
    h = 2166136261
    for c in feature.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) % FEATURES


def features(block: Block) -> list[int]:
    text, marks, links = block
    n = text.count(" ") + 1
    out = ["bias", f"words{min(n, 64).bit_length()}", f"links{int(links * 4)}", f"stop{text[-1] in '.!?…:”\"'}", f"commas{min(text.count(','), 3)}"]
    if n < 40 and NOTICE.search(text):
        out.append("notice")
    return [slot(f) for f in out] + [slot("in " + w) for w in marks] + [slot("under " + " ".join(marks[-3:]))]


def scores(feats: list[list[int]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[f].sum(axis=0) for f in feats])


def viterbi(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Best labels of a chain."""
    best, back = unary[0].copy(), np.zeros(unary.shape, np.int64)
    for i in range(1, len(unary)):
        step = best[:, None] + pair
        back[i] = step.argmax(axis=0)
        best = step.max(axis=0) + unary[i]
    out = np.empty(len(unary), np.int64)
    out[-1] = best.argmax()
    for i in range(len(unary) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def marginals(unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each block, and the sum of neighbouring pairs', by forward and backward passes."""
    n, e = len(unary), np.exp(pair)
    x = np.exp(unary - unary.max(axis=1, keepdims=True))
    f, b = np.empty_like(x), np.ones_like(x)
    f[0] = x[0] / x[0].sum()
    for i in range(1, n):
        f[i] = (f[i - 1] @ e) * x[i]
        f[i] /= f[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = e @ (x[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    p = f * b
    p /= p.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for i in range(n - 1):
        q = f[i][:, None] * e * (x[i + 1] * b[i + 1])[None]
        pairs += q / q.sum()
    return p, pairs


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.2, decay: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature and label, weights of neighbouring labels) by stochastic gradient ascent.

    Steps shrink per feature with the gradients it has had, so names that few pages use are learned as well.
    """
    rng, w, pair = np.random.default_rng(seed), np.zeros((FEATURES, 2)), np.zeros((2, 2))
    had = np.full((FEATURES, 2), 1e-2)
    data = [([features(b) for b in bs], np.array(ys)) for bs, ys in pages if bs]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(data)):
            feats, y = data[i]
            p, q = marginals(scores(feats, w), pair)
            g = -p
            g[np.arange(len(y)), y] += 1
            for f, d in zip(feats, g):
                had[f] += d * d
                w[f] += rate * d / np.sqrt(had[f])
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            pair += step * (seen - q) / len(y)
        w *= 1 - decay
    return w, pair


#: Words of class and id attributes around main text and around the rest of a page.
MAIN_NAMES = ("content", "article", "article body", "post", "post content", "entry content", "main", "story", "text", "body")
OTHER_NAMES = ("menu", "nav", "navbar", "header", "site header", "masthead", "sidebar", "side", "widget", "footer", "site footer", "cookie notice",
               "notice", "banner", "consent", "popup", "modal", "alert", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "newsletter", "subscribe", "signup",
               "form", "search", "login", "comments", "comment", "comment list", "reader comments", "reply", "related", "recommended", "share",
               "social", "breadcrumb", "pagination", "tags", "meta")


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels (1: main) of made-up pages. Every main text holds a mark that tells its blocks afterwards."""
    rng = np.random.default_rng(seed)

    def words(lo: int, hi: int, mark: str = "") -> str:
        w = ["".join(rng.choice(list("aeinorst"), rng.integers(1, 9))) for _ in range(rng.integers(lo, hi))]
        s = " ".join(w).capitalize() + ("." if rng.random() < 0.8 else "")
        return f"{mark}{s}"

    def link() -> str:
        return f'<a href="/{words(1, 2)}">{words(1, 4)}</a>'

    def attrs(names: tuple[str, ...]) -> str:
        name = str(rng.choice(names))
        return rng.choice(['class', 'id']) + f'="{name if rng.random() < 0.5 else name.replace(" ", "-")}"'

    def other(tag: str | None = None) -> str:
        tag = tag or str(rng.choice(["div", "div", "div", "section", "aside", "ul", "p", "form"]))
        head = str(rng.choice(["h2", "h3", "h4"]))
        body = {0: lambda: "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 8))),
                1: lambda: f"<p>{words(3, 60)}</p>", 2: lambda: f"{words(2, 30)} {link()}",
                3: lambda: f"<{head}>{words(1, 4)}</{head}>" + "".join(f"<p>{words(4, 40)}</p>" for _ in range(rng.integers(1, 4))),
                4: lambda: f'<label>{words(1, 3)}</label><input type="text">'}[int(rng.integers(5))]()
        name = "" if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5 else " " + attrs(OTHER_NAMES)
        return f"<{tag}{name}>{body}</{tag}>"

    def main() -> str:
        out = [f"<h1>{words(2, 12, '\x02')}</h1>"] if rng.random() < 0.8 else []
        divs = rng.random() < 0.15  # paragraphs are plain divs
        part = str(rng.choice(["", "", "section", "div"]))  # parts of the text in elements of their own
        for _ in range(rng.integers(2, 12)):
            kind = rng.random()
            if part:
                out.append(f"<{part}>")
            if kind < 0.7:
                p = "div" if divs else "p"
                out.append(f"<{p}>{words(*((1, 7) if rng.random() < 0.4 else (5, 90)), '\x02')}" + (f" <b>{words(1, 3)}</b> {link()}" if rng.random() < 0.2 else "") + ("</p>" if not divs and rng.random() < 0.9 else "</div>" * divs))
            elif kind < 0.8:
                out.append(f"<h2>{words(1, 8, '\x02')}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{words(2, 20, '\x02')}</li>" for _ in range(3)) + "</ul>")
            else:
                out.append(str(rng.choice([f"<blockquote>{words(5, 30, '\x02')}</blockquote>", f"<table><tr><td>{words(1, 5, '\x02')}</td></tr></table>", f"<pre>{words(3, 9, '\x02')}</pre>", f"<figure><figcaption>{words(3, 12, '\x02')}</figcaption></figure>"])))
            if part:
                out.append(f"</{part}>")
            if rng.random() < 0.25:
                out.append(other())
        if rng.random() < 0.3:
            out.append(other(str(rng.choice(["footer", "aside", "form", "div"]))))
        return "".join(out)

    pages = []
    for _ in range(n):
        tag = str(rng.choice(["article", "article", "main", "div", "div", "section"]))
        body = f"<{tag}{'' if rng.random() < (0.3 if tag == 'div' else 0.6) else ' ' + attrs(MAIN_NAMES)}>{main()}</{tag}>"
        if rng.random() < 0.4:
            tag = str(rng.choice(["main", "section", "div"]))
            body = f'<{tag}{"" if rng.random() < 0.5 else " " + attrs(MAIN_NAMES)}>{body}</{tag}>'
        before = [other(t) for t in rng.choice(["nav", "header", "div", "aside", "section"], rng.integers(1, 5))]
        after = [other(t) for t in rng.choice(["footer", "aside", "div", "section", "form", "p"], rng.integers(1, 5))]
        page = "".join(before) + body + "".join(after)
        for _ in range(rng.integers(0, 3)):
            page = f"<div>{page}</div>"
        bs = blocks(f"<html><body>{page}</body></html>")
        pages.append(([(t.replace("\x02", ""), m, s) for t, m, s in bs], [int("\x02" in t) for t, _, _ in bs]))
    return pages


def main_text(page: str | None, weights: np.ndarray, pair: np.ndarray) -> str:
    bs = blocks(page or "")
    if not bs:
        return ""
    labels = viterbi(scores([features(b) for b in bs], weights), pair)
    return " ".join(b[0] for b, y in zip(bs, labels) if y)


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url"), labelled: int = PAGES) -> DataFrame:
    """The ``carry`` columns, text (main text) and n_chars (its code points) of every page."""
    model = pages.sparkSession.sparkContext.broadcast(train(labelled_pages(labelled)))  # 2 x FEATURES numbers

    def run(texts: list) -> tuple[None, list[list]]:
        text = [main_text(h, *model.value) for h in texts]
        return None, [text, [len(t) for t in text]]

    return per_text(pages, [F.col(c) for c in carry], F.col(html_col), run, {"text": pa.string(), "n_chars": pa.int64()})
