"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page's elements become blocks: block-level elements, and runs of bare text between them.  Two sets of boosted trees give each block the
log odds that it is main text throughout, and that it has none, from its text and tag density, link density, depth, place among its siblings, tag, enclosing
landmark, the tokens of its own and its ancestors' class, id and role, and the share of its text below such tokens of bad repute.  Decoding walks the tree upwards: a block is
kept whole, dropped whole, or left to its children as mixed, whichever is likeliest for its subtree, so that nothing is kept
inside a dropped block or dropped inside a kept one.

The trees are trained on ``TRAINING_PAGES`` pages that ``page_maker`` draws with a fixed seed: articles of many layouts with
menus, headers, footers, sidebars, notices, adverts, forms, comments and broken markup, whose main text is known.

Defined results: null, empty and textless pages have empty text; repeated rows get equal results; character references are
decoded, white space inside a block is one space, and blocks are joined by one space; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.llm import boosting, dom

TRAINING_PAGES, SEED = 300, 8
#: Pages of a prediction.
AT_ONCE = 128
#: Text nodes of a page that stay out of every block.
_NEVER = dom.RAW - {"textarea"} | dom.HIDDEN | {"head", "button", "select", "input", "textarea"}

GOOD = "article content post entry story body text main page blog news detail".split()
BAD = "ad ads advert advertisement sponsor banner promo nav menu navbar breadcrumb header masthead footer sidebar aside widget related recommended share social comment comments reply respond cookie consent notice alert popup modal newsletter subscribe login search form pagination tags meta byline author copyright legal skip".split()
TOKENS = {t: i for i, t in enumerate(GOOD + BAD)}
TAGS = {t: i for i, t in enumerate("#run article main section div nav header footer aside form ul ol li dl p h1 h2 h3 h4 blockquote pre table tr td figure figcaption body details address center".split())}
LANDMARKS = {t: i for i, t in enumerate("article main nav header footer aside form section table ul".split())}
_NUMBERS = 23
WIDTH = _NUMBERS + len(TAGS) + 1 + len(LANDMARKS) + 2 * len(TOKENS)

_PARTS = re.compile(r"[A-Z]?[a-z]+|[0-9]+|[A-Z]+")


class Block:
    __slots__ = ("tag", "tokens", "landmark", "outer", "children", "raw", "text", "length", "links", "marks", "tags", "paragraphs", "controls", "depth", "start", "shady")

    def __init__(self, tag: str, attrs: str, up: Block | None):
        self.tag, self.children, self.raw = tag, [], []
        self.length = self.links = self.marks = self.tags = self.paragraphs = self.controls = self.start = self.shady = 0
        self.text = ""
        self.depth = up.depth + 1 if up else 0
        self.outer = up.outer | up.tokens if up else frozenset()
        self.landmark = up.tag if up and up.tag in LANDMARKS else up.landmark if up else None
        self.tokens = frozenset() if not attrs else _tokens(attrs) if len(attrs) <= 200 else _tokens.__wrapped__(attrs)


@lru_cache(maxsize=1 << 14)
def _tokens(attrs: str) -> frozenset[int]:
    found = dom.Node("x", attrs).attributes()
    return frozenset(TOKENS[p.lower()] for k in ("class", "id", "role") for p in _PARTS.findall(found.get(k, "")) if p.lower() in TOKENS)


def blocks_of(source: str) -> Block:
    """The block tree of a page; text is in leaves only."""
    root = Block("#root", "", None)
    todo: list[tuple[dom.Node, Block, bool]] = [(dom.parse(source), root, False)]
    order = []
    while todo:
        node, block, link = todo.pop()
        if node.tag == "#":
            run = block.children[-1] if block.children and block.children[-1].tag == "#run" else None
            if run is None:
                if not node.text.strip():
                    continue
                run = Block("#run", "", block)
                block.children.append(run)
                order.append(run)
            run.raw.append((node.text, link))
            continue
        if node.tag in _NEVER:
            block.controls += node.tag in ("button", "select", "input", "textarea")
            continue
        if node.tag == "br":
            if block.children and block.children[-1].tag == "#run":
                block.children[-1].raw.append((" ", False))
            continue
        own = block
        if node.tag in dom.BLOCK:
            own = Block(node.tag, node.attrs, block)
            block.children.append(own)
            order.append(own)
        else:
            own.tags += 1
        todo.extend((c, own, link or node.tag == "a") for c in reversed(node.children))
    at = 0
    for b in order:
        b.start = at
        if b.raw:
            b.text = dom.clean(entities.unescape("".join(t for t, _ in b.raw)))
            b.length, b.links = len(b.text), sum(len(t.strip()) for t, link in b.raw if link)
            b.marks = sum(map(b.text.count, ".,!?"))
            at += b.length
    for b in [*reversed(order), root]:
        for c in b.children:
            b.length += c.length
            b.links += c.links
            b.marks += c.marks
            b.tags += c.tags + (c.tag != "#run")
            b.paragraphs += c.paragraphs + (c.length if c.tag == "p" else 0)
            b.controls += c.controls
            b.shady += c.shady
        if any(t >= len(GOOD) for t in b.tokens):
            b.shady = b.length
    return root


def _features(root: Block) -> tuple[list[Block], np.ndarray]:
    """Blocks with text in page order, and their features."""
    found, todo = [], [(c, root, i) for i, c in reversed(list(enumerate(root.children)))]
    rows: list[tuple[Block, Block, int]] = []
    while todo:
        b, up, i = todo.pop()
        if b.length:
            rows.append((b, up, i))
            todo.extend((c, b, j) for j, c in reversed(list(enumerate(b.children))))
    x = np.zeros((len(rows), WIDTH), np.float32)
    page = max(1, root.length)
    tags0, land0, own0, outer0 = _NUMBERS, _NUMBERS + len(TAGS) + 1, _NUMBERS + len(TAGS) + 1 + len(LANDMARKS), WIDTH - len(TOKENS)
    for r, (b, up, i) in enumerate(rows):
        n, sib = b.length, up.children
        before, after = (sib[i - 1].length if i else 0), (sib[i + 1].length if i + 1 < len(sib) else 0)
        x[r, :_NUMBERS] = (b.depth, math.log1p(n), min(1.0, b.links / n), math.log1p(n / (1 + b.tags)), math.log1p(len(b.children)), i / len(sib), math.log1p(len(sib)), n / up.length, n / page, 100 * b.marks / n, before / page, after / page, b.start / page, (b.start + n) / page, b.paragraphs / n, math.log1p(b.controls), b.text.startswith(("©", "(c)")), b.shady / n, 0 < b.shady < n, *(sum((t < len(GOOD)) == good for t in ts) for ts in (b.tokens, b.outer) for good in (True, False)))
        x[r, tags0 + TAGS.get(b.tag, len(TAGS))] = 1
        if b.landmark:
            x[r, land0 + LANDMARKS[b.landmark]] = 1
        for t in b.tokens:
            x[r, own0 + t] = 1
        for t in b.outer:
            x[r, outer0 + t] = 1
        found.append(b)
    return found, x


def decode(root: Block, blocks: list[Block], log_odds: np.ndarray) -> list[str]:
    """Texts of the leaves that the likeliest consistent choice keeps; log_odds: of all main text, of none.

    The choices of a subtree are a cut of blocks that are kept or dropped and, above them, blocks that are mixed.
    """
    p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    keep, drop, mixed = (np.log(np.maximum(v, 1e-9)).tolist() for v in (p[:, 0], p[:, 1], 1 - p.sum(1)))
    best: dict[int, tuple[float, str]] = {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        options = [(keep[i], "keep"), (drop[i], "drop")]
        if not b.text:
            options.append((mixed[i] + sum(best[id(c)][0] for c in b.children if c.length), "open"))
        best[id(b)] = max(options)
    texts, todo = [], [(c, False) for c in reversed(root.children) if c.length]
    while todo:
        b, kept = todo.pop()
        choice = "keep" if kept else best[id(b)][1]
        if choice == "drop":
            continue
        if b.text:
            texts.append(b.text)
        todo.extend((c, choice == "keep") for c in reversed(b.children) if c.length)
    return texts


def page_maker(rng: random.Random) -> tuple[str, list[str]]:
    """A page, and the texts of its main blocks."""
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an er on".split()]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda lo=4, hi=18: words(lo, hi).capitalize() + rng.choice("...!?")
    main: list[str] = []

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 3)}</a>'

    def items(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"

    def attr(names: list[str]) -> str:
        return f' {rng.choice(["class", "id", "class"])}="{rng.choice(["", "site-", "js-", "main_"])}{rng.choice(names)}{rng.choice(["", "", "-box", " x1"])}"'

    def junk() -> str:
        kind = rng.choice(["ad", "side", "note", "form", "share", "related", "comments", "crumb", "tags"])
        short = rng.choice([sentence(), sentence() + " " + sentence(), link()])
        if kind == "ad":
            return f"<div{attr(['ad', 'ads', 'advert', 'banner', 'promo', 'sponsor', 'advertisement'])}>{short}</div>"
        if kind == "side":
            return f"<{(t := rng.choice(['aside', 'div']))}{attr(['sidebar', 'widget', 'aside'])}><h3>{words(1, 3)}</h3>{rng.choice([items(4), '<p>' + sentence() + '</p>'])}</{t}>"
        if kind == "note":
            return f"<div{attr(['cookie', 'consent', 'notice', 'alert', 'popup', 'newsletter'])}><p>{short}</p><button>{word()}</button></div>"
        if kind == "form":
            return f"<form{attr(['search', 'login', 'subscribe', 'form'])}><label>{words(1, 4)}</label><input name=q><p>{sentence()}</p></form>"
        if kind == "comments":
            return f"<{(t := rng.choice(['section', 'div']))}{attr(['comments', 'comment', 'respond', 'reply'])}><h3>{words(1, 2)}</h3>" + "".join(f"<div class=\"comment\"><p>{' '.join(sentence() for _ in range(rng.randint(1, 5)))}</p></div>" for _ in range(rng.randint(1, 4))) + f"</{t}>"
        if kind == "crumb":
            return f"<div{attr(['breadcrumb', 'pagination', 'menu'])}>{link()} &raquo; {link()}</div>"
        return f"<div{attr(['share', 'social', 'related', 'recommended', 'tags', 'meta', 'byline'])}>{rng.choice([items(3), link(), sentence()])}</div>"

    def top() -> str:
        parts = [f"<nav{rng.choice(['', attr(['nav', 'menu', 'navbar'])])}>{items(rng.randint(2, 8))}</nav>", f"<header{rng.choice(['', attr(['header', 'masthead'])])}>{rng.choice([link(), '<h2>' + words(1, 4) + '</h2>'])}</header>", f"<div{attr(['header', 'nav', 'menu', 'masthead', 'skip'])}>{items(3)}</div>", junk()]
        return "".join(rng.sample(parts, rng.randint(1, 3)))

    def bottom() -> str:
        return rng.choice([f"<footer{rng.choice(['', attr(['footer'])])}>&copy; {word()} &middot; {sentence()}</footer>", f"<div{attr(['footer', 'copyright', 'legal'])}>&copy; {words(2, 9)} {link()}</div>", f"<footer><p>{sentence()}</p>{items(4)}</footer>", ""])

    def prose(long: bool) -> str:
        n = rng.choice([1, 1, 2, 3, 6, 12, 30]) if long else 1
        return rng.choice([" | ".join(words(1, 1) for _ in range(rng.randint(3, 30))), " ".join(sentence() for _ in range(n)), " ".join(sentence() for _ in range(n)), words(1, 60)])

    def body() -> str:
        out = []
        if rng.random() < 0.85:
            main.append(words(1, 12))
            out.append(f"<{(t := rng.choice(['h1', 'h1', 'h2']))}>{main[-1]}</{t}>")
        for _ in range(rng.choice([1, 1, 2, 4, 8, 14, 40])):
            text = prose(True)
            main.append(text)
            shape = rng.random()
            if shape < 0.6:
                out.append(f"<p>{text}</p>")
            elif shape < 0.75:
                out.append(f"<p><b>{text}<br>")
            elif shape < 0.82:
                out.append(f"<p>{text}")
            elif shape < 0.88:
                out.append(f"<ul><li>{text}</li></ul>")
            elif shape < 0.93:
                out.append(f"<blockquote>{text}</blockquote>")
            else:
                out.append(f"<h3>{text}</h3>")
            if rng.random() < 0.08:
                out.append("</p>" + junk())
        return "".join(out)

    inner = body()
    t = rng.choice(["article", "article", "main", "div", "section", "div"])
    named = attr(GOOD) if t == "div" or rng.random() < 0.4 else ""
    text = f"<{t}{named}>{inner}</{t}>"
    if rng.random() < 0.3:
        text = f"<div{rng.choice(['', attr(['wrapper', 'container', 'page', 'content'])])}>{text}{junk() if rng.random() < 0.5 else ''}</div>"
    end = "" if rng.random() < 0.1 else "</body></html>"
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>{top()}<!-- ad -->{junk() if rng.random() < 0.6 else ''}{text}{junk() if rng.random() < 0.5 else ''}{bottom()}{end}", main


def training_set(pages: int = TRAINING_PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (only main text; none) of all blocks."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, main = page_maker(rng)
        known = {dom.clean(m) for m in main}
        root = blocks_of(source)
        blocks, x = _features(root)
        good: dict[int, int] = {}
        for b in reversed(blocks):
            good[id(b)] = b.length if b.text and b.text in known else sum(good.get(id(c), 0) for c in b.children)
        xs.append(x)
        ys += [(good[id(b)] == b.length, good[id(b)] == 0) for b in blocks]
    return np.concatenate(xs), np.array(ys, float)


@cache
def model() -> tuple[boosting.Boosted, boosting.Boosted]:
    x, y = training_set()
    return boosting.train(x, y[:, 0]), boosting.train(x, y[:, 1])


def extract(sources: list[str | None], trees: tuple[boosting.Boosted, boosting.Boosted]) -> list[str]:
    """The main texts of pages; the trees see the blocks of ``AT_ONCE`` pages together."""
    out = []
    for at in range(0, len(sources), AT_ONCE):
        pages = [blocks_of(s or "") for s in sources[at : at + AT_ONCE]]
        found = [_features(root) for root in pages]
        x, i = np.concatenate([x for _, x in found]), 0
        odds = np.stack([t.log_odds(x) for t in trees], 1)
        for root, (blocks, _) in zip(pages, found, strict=True):
            out.append(" ".join(decode(root, blocks, odds[i : i + len(blocks)])))
            i += len(blocks)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    trees = model()

    def run(source: pa.Array) -> pa.Array:
        return pa.array(extract(source.to_pylist(), trees), pa.string())

    run.__annotations__ = {"source": pa.Array, "return": pa.Array}
    return pages.select("page_id", "url", F.arrow_udf(run, T.StringType())(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
