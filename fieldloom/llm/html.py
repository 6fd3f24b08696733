"""Main-text extraction: boosted trees over the blocks of a page, decoded from the top down.

A page becomes a tree of block elements; text between blocks is a node of its own.  Features of
a node are its subtree's text and link densities, its tag and attribute tokens and those of
its ancestors, its depth, and its place and share among its siblings.  Tokens count in two ways:
by groups of words that pages use, and by what the fitted pages tell of them: each token is
hashed to one of ``BUCKETS`` log odds, learned from other pages than those that the trees are
fitted on with it; unseen tokens tell nothing.  Decoding picks the best labelling in which nothing
below a dropped node is kept, so contradictory choices of ancestors and descendants can't occur.

The trees are fitted on generated layouts with known labels, and on a bounded sample of the
pages themselves whose semantic elements (``article``, ``main``) tell their labels.  The sample
is of the smallest hashes of page_id among pages of at most ``SAMPLE_CHARS``.

A null or empty page has no text.  Scripts, styles, templates, comments, form controls and the
head never count as text; whatever else stands in a kept block does, formulas, drawings and what
stands in for objects too.  White space is ``[\\x20\\x09-\\x0D]``.  Broken markup is read as far
as it goes: open elements end with the page.  Of labellings that are equally good the one with
less text is taken.  Repeated rows are extracted each, as are those without a page_id.  A long
page is parsed by one task, at some hundred times its size a node.  Extra columns of any name are
ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.boost import BoostedTrees

#: The most pages, and generated pages, that the trees are fitted on.
SAMPLE_PAGES, GENERATED_PAGES = 300, 400
#: The longest page that is fitted on, and the number of learned log odds of tokens.
SAMPLE_CHARS, BUCKETS = 1 << 17, 1 << 16
#: Pages that a token must stand on to be learned.
TOKEN_PAGES = 5

#: A tag with no "<" up to its end and no quote left open: what most tags are.
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*+)(?=[\s/>])((?:[^>\"'<]++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLOCKS = "#text body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset form nav header footer aside center hr noscript".split()
_KIND = {t: i for i, t in enumerate(_BLOCKS)}
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW = frozenset("script style template textarea title select option head button".split())
_TO_THE_END = frozenset("script style template textarea title".split())
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in _RAW}
_VOID = frozenset("br img input hr meta link area base col embed source track wbr param".split())
_CLOSED_BY = {"p": frozenset(_BLOCKS) - {"#text", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Attribute and tag tokens by what they tell of a block.
_GROUPS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc skip links".split(),
    "header": "header masthead banner logo branding topbar hero".split(),
    "footer": "footer copyright legal colophon bottom".split(),
    "side": "aside sidebar side widget related recommended recommend popular trending more rail complementary tags".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay disclaimer privacy warning".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense".split(),
    "form": "form search login signup subscribe newsletter contact fieldset".split(),
    "comment": "comment comments reply replies disqus discussion respond reviews".split(),
    "share": "share social follow byline meta author date tools".split(),
    "content": "article content main post entry story text body copy page prose".split(),
}
_GROUP_OF = {}
for _i, _words in enumerate(_GROUPS.values()):
    for _w in _words:
        _GROUP_OF[_w] = _GROUP_OF.get(_w, 0) | 1 << _i
_TAG_GROUP = {"nav": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "article": "content", "main": "content", "fieldset": "form"}
_TAG_MASK = {t: 1 << list(_GROUPS).index(g) for t, g in _TAG_GROUP.items()}
_N_GROUPS = len(_GROUPS)
_NEGATIVE = (1 << _N_GROUPS - 1) - 1


@lru_cache(65536)
def _buckets(value: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(part.lower().encode()) % BUCKETS for part in _PART.findall(value) if not part.isdigit())


@lru_cache(65536)
def _mask(value: str) -> int:
    out = 0
    for part in _PART.findall(value):
        out |= _GROUP_OF.get(part.lower(), 0)
    return out


class Tokens:
    """The tags of a page, one after the other, in time that grows with the page alone, whatever it leaves open.

    A tag ends at the first ">" outside quotes, or with the page; a "<" whose tag has a quote without an
    end is text.  Where a scan has been, no other goes: ends of names, the next quote or ">" and what
    comes after a quoted value are remembered.
    """

    def __init__(self, source: str):
        self.source, self.size = source, len(source)
        self._last = {q: source.rfind(q) for q in "\"'>"}
        self._next = {_NAME_END: (0, -1), _SPECIAL: (0, -1)}
        self._after: dict[int, int] = {}
        self._without: dict[str, int] = {}

    def _find(self, pattern: re.Pattern, at: int) -> int:
        """The next place of one of the characters, or the page's end."""
        begin, place = self._next[pattern]
        if not begin <= at <= place:
            m = pattern.search(self.source, at)
            place = m.start() if m else self.size
            self._next[pattern] = at, place
        return place

    def _tag_end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends; -1 if it doesn't."""
        passed, end = [], None
        while end is None:
            p = self._find(_SPECIAL, at)
            if p == self.size:
                end = p
            elif self.source[p] == ">":
                end = p + 1
            elif p >= self._last[self.source[p]]:
                end = -1
            else:
                at = self.source.find(self.source[p], p + 1) + 1
                end = self._after.get(at)
                passed.append(at)
        self._after |= dict.fromkeys(passed, end)
        return end

    def following(self, at: int) -> tuple[int, int, bool, str | None, str]:
        """Begin and end of the next tag, comment or declaration, whether it closes, its name in lower case (None for the latter two) and its attributes; begin is -1 where none is left."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if m := _SIMPLE.match(source, at):
                return at, m.end(), m[1] == "/", m[2].lower(), m[3]
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, end + 3 if end >= 0 else self.size, False, None, ""
            if source[at + 1 : at + 2] in ("!", "?"):
                end = source.find(">", at + 2)
                return at, end + 1 if end >= 0 else self.size, False, None, ""
            closes = source[at + 1 : at + 2] == "/"
            name = at + 1 + closes
            if name < self.size and source[name].isascii() and source[name].isalpha():
                name_end = self._find(_NAME_END, name)
                end = self._tag_end(name_end)
                if end >= 0:
                    return at, end, closes, source[name:name_end].lower(), source[name_end : end - 1 if source[end - 1] == ">" else end]
            at += 1
        return -1, self.size, False, None, ""

    def raw_end(self, tag: str, at: int) -> int:
        """Where the raw element that begins at ``at`` ends, with its end tag; -1 if there is none."""
        if self._without.get(tag, self.size) <= at:
            return -1
        m = _RAW_END[tag].search(self.source, at)
        if m is None or m.end() > self._last[">"]:
            self._without[tag] = at
            return -1
        return self.source.find(">", m.end()) + 1


class Page:
    """The block tree of a page, its nodes in page order.

    ``parent`` and ``end`` (one past the last node below) give the tree; ``own`` has, for each
    node: characters, characters in links, words, full stops and commas, inline elements.
    """

    def __init__(self, source: str, marked: bool = False):
        self._marked = marked  # whether ``data-label`` tells the labels, as in generated pages alone
        self.tags, self.parent, self.end, self.depth = ["body"], [-1], [0], [0]
        self.mask, self.above, self.label = [0], [0], [None]
        self.tokens: list[tuple[int, ...]] = [()]
        self.own: list[list[int]] = [[0, 0, 0, 0, 0]]
        self.texts: dict[int, str] = {}
        self._parse(source)

    def _open(self, tag: str, mask: int, label, tokens: tuple[int, ...] = ()) -> int:
        p = self._stack[-1]
        self.tags.append(tag)
        self.parent.append(p)
        self.end.append(0)
        self.depth.append(self.depth[p] + 1)
        self.mask.append(mask)
        self.tokens.append(tokens)
        self.above.append(self.above[p] | self.mask[p])
        self.label.append(label if label is not None else self.label[p])
        self.own.append([0, 0, 0, 0, 0])
        return len(self.tags) - 1

    def _flush(self) -> None:
        """The text gathered since the last block boundary becomes a node."""
        text = _SPACES.sub(" ", "".join(self._run)).strip(" ")
        if text:
            i = self._open("#text", 0, None)
            self.texts[i] = text
            self.own[i] = [len(text), min(len(text), self._linked), text.count(" ") + 1, text.count(".") + text.count(","), self._inline]
            self.end[i] = i + 1
        self._run, self._linked, self._inline = [], 0, 0

    def _close(self) -> None:
        self._flush()
        i = self._stack.pop()
        self._standing[self.tags[i]] -= 1
        self.end[i] = len(self.tags)

    def _parse(self, source: str) -> None:
        self._stack, self._run, self._linked, self._inline, link, at = [0], [], 0, 0, 0, 0
        self._standing = Counter(["body"])
        size, tokens_of = len(source), Tokens(source)
        while at < size:
            begin, end, closes, tag, attributes = tokens_of.following(at)
            text = source[at : begin if begin >= 0 else size]
            if text:
                text = _html.unescape(text) if "&" in text else text
                self._run.append(text)
                if link:
                    self._linked += len(text.strip())
            at = end
            if tag is None:
                continue
            if closes:
                if tag in _KIND:
                    if tag != "body" and self._standing[tag]:
                        while self.tags[self._stack[-1]] != tag:
                            self._close()
                        self._close()
                elif tag == "a" and link:
                    link -= 1
                continue
            if tag in _RAW:
                if tag == "head":
                    # what may stand in a head is raw itself; a head without an end is no reason to lose the page
                    continue
                e = tokens_of.raw_end(tag, at)
                # without an end, the parser's own raw elements take the rest of the page, the others nothing
                at = e if e >= 0 else size if tag in _TO_THE_END else at
                continue
            if tag in _KIND and tag != "#text":
                if tag == "body":
                    self.mask[0] |= _mask_of(attributes)[0]
                    continue
                self._flush()
                while len(self._stack) > 1 and tag in _CLOSED_BY.get(self.tags[self._stack[-1]], ()):
                    self._close()
                link = 0
                if tag == "hr":
                    continue
                mask, label, tokens = _mask_of(attributes)
                label = label if self._marked else None
                self._standing[tag] += 1
                self._stack.append(self._open(tag, mask | _TAG_MASK.get(tag, 0), label, (zlib.crc32(tag.encode()) % BUCKETS, *tokens)))
            elif tag == "br":
                self._run.append(" ")
            else:
                self._inline += 1
                if tag == "a":
                    link += 1
        while self._stack:
            self._close()


def _mask_of(attributes: str) -> tuple[int, str | None, tuple[int, ...]]:
    mask, label, tokens = 0, None, []
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "data-label":
                label = value
            else:
                mask |= _mask(value)
                tokens += _buckets(value)
    return mask, label, tuple(tokens)


def token_odds(pages: list["Page"], labels: list[np.ndarray]) -> np.ndarray:
    """The log odds, against those of all nodes, that a node with a token holds main text, by the token's bucket."""
    main, total, on = (np.zeros(BUCKETS) for _ in range(3))
    for page, y in zip(pages, labels):
        there = set()
        for i, tokens in enumerate(page.tokens):
            for t in set(tokens):
                total[t] += 1
                main[t] += y[i]
                there.add(t)
        on[list(there)] += 1
    share = (main.sum() + 1) / (total.sum() + 2)
    odds = np.log((main + share * 10) / (total - main + (1 - share) * 10)) - np.log(share / (1 - share))
    return np.where(on >= TOKEN_PAGES, odds, 0.0).astype(np.float32)


def _token_features(page: "Page", odds: np.ndarray) -> np.ndarray:
    """A node's least and largest log odds of a token, and the least of the nodes above it."""
    out = np.zeros((len(page.tags), 3))
    for i, tokens in enumerate(page.tokens):
        if tokens:
            own = odds[list(tokens)]
            out[i, 0], out[i, 1] = min(0.0, own.min()), max(0.0, own.max())
        if i:
            p = page.parent[i]
            out[i, 2] = min(out[p, 2], out[p, 0])
    return out


@dataclass
class Model:
    """Fitted trees, and the log odds of tokens."""

    trees: BoostedTrees
    odds: np.ndarray

    def margin(self, pages: list["Page"]) -> np.ndarray:
        """Log odds of all nodes of the pages, end to end."""
        return self.trees.margin(np.concatenate([features(p, self.odds) for p in pages]))


def features(page: Page, odds: np.ndarray) -> np.ndarray:
    """A row for each node."""
    n = len(page.tags)
    parent, end = np.maximum(np.array(page.parent), 0), np.array(page.end)
    own = np.array(page.own, np.float64)
    tags = np.array([_KIND[t] for t in page.tags])
    kinds = np.stack([tags == _KIND["p"], tags == _KIND["li"], np.isin(tags, [_KIND[h] for h in _HEADING])], 1)
    sums = np.concatenate([np.zeros((1, 8)), np.cumsum(np.concatenate([own, kinds], 1), 0)])
    sub = sums[end] - sums[:-1]
    nodes = end - np.arange(n)
    chars = sub[:, 0]
    siblings = np.bincount(parent[1:], minlength=n)[parent]
    first = np.zeros(n, np.int64)
    order = np.argsort(parent[1:], kind="stable") + 1
    heads = np.concatenate([[0], np.cumsum(np.bincount(parent[1:], minlength=n))])[:-1]
    first[order] = np.arange(n - 1) - heads[parent[order]]
    up = chars[parent]
    mean = (up - own[parent, 0]) / np.maximum(siblings, 1)
    mask, above = np.array(page.mask), np.array(page.above)
    bits = np.arange(_N_GROUPS)
    dense = [
        np.log1p(chars), sub[:, 1] / np.maximum(chars, 1), np.log1p(sub[:, 2]), chars / nodes, sub[:, 3] / np.maximum(sub[:, 2], 1), sub[:, 4] / np.maximum(sub[:, 2], 1), np.log1p(own[:, 0]),
        np.array(page.depth), np.log1p(siblings), first / np.maximum(siblings, 1), chars / np.maximum(up, 1), np.log1p(mean), chars / max(1.0, chars[0]), sums[:-1, 0] / max(1.0, chars[0]),
        sub[:, 5] / nodes, sub[:, 6] / nodes, sub[:, 7] / nodes, tags, np.log1p(nodes), np.log1p(chars[parent]), sub[parent, 1] / np.maximum(up, 1), tags[parent],
    ]
    return np.concatenate([np.stack(dense, 1), mask[:, None] >> bits & 1, above[:, None] >> bits & 1, _token_features(page, odds)], 1)


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the labelling of the largest log odds in which no node below a dropped one is kept.

    Each text speaks for itself, by its length; a block speaks for whether anything in it is kept.
    """
    weight = np.where([t == "#text" for t in page.tags], np.log2(2.0 + np.array(page.own)[:, 0]), 1.0)
    value = np.clip(margin, -6, 6) * weight
    best = value.copy()  # of a subtree whose root is kept, against all dropped
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    keep = np.zeros(len(best), bool)
    keep[0] = True
    for i in range(1, len(best)):
        keep[i] = keep[page.parent[i]] and best[i] > 0
    return keep


def extract(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [Page(p) if p else None for p in pages]
    parsed = [t for t in trees if t is not None]
    margin, at, out = model.margin(parsed) if parsed else None, 0, []
    for t in trees:
        if t is None:
            out.append("")
            continue
        n = len(t.tags)
        keep = decode(t, margin[at : at + n])
        at += n
        out.append(" ".join(text for i, text in t.texts.items() if keep[i]))
    return out


# training


def _labels(page: Page) -> np.ndarray | None:
    """1 for nodes with main text: as marked, or inside an article or main element and outside what its tags and tokens rule out."""
    n = len(page.tags)
    if any(page.label):
        y = np.array([page.label[i] == "main" and page.tags[i] == "#text" for i in range(n)])
    else:
        inside = np.zeros(n, bool)
        for i, t in enumerate(page.tags):
            p = page.parent[i]
            ruled_out = page.mask[i] & _NEGATIVE and t not in ("article", "main", "p", "#text") and t not in _HEADING
            inside[i] = t in ("article", "main") or (p >= 0 and inside[p] and not ruled_out)
        y = inside & np.array([t == "#text" for t in page.tags])
        if not y.any():
            return None
    sums = np.concatenate([[0], np.cumsum(y)])
    return (sums[np.array(page.end)] - sums[:-1] > 0).astype(np.float64)


def generated_pages(n: int, seed: int = 7) -> list[str]:
    """Pages of invented words in many layouts; ``data-label`` marks their main text."""
    r = random.Random(seed)
    plain = False  # a page without semantic elements and names
    syllables = "ka re ti mo sun la per vi ost en dra qui bel nor".split()

    def words(lo: int, hi: int) -> str:
        out = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        for i in range(len(out)):
            if r.random() < 0.09:
                out[i] += r.choice(".,")
        return " ".join(out).capitalize() + r.choice([".", "", "."])

    def attr(group: str | None) -> str:
        if not group or plain or r.random() < 0.35:
            # names that tell nothing: common ones, and ones that stand nowhere else
            return r.choice(["", f' class="{r.choice(["box", "row", "col", "wrap", "c1", "inner"])}"', f' class="{"".join(r.choices("bcdfgklmz", k=5))}"'])
        token = r.choice(_GROUPS[group])
        return f' {r.choice(["class", "id", "class"])}="{r.choice(["", "site-", "block-", "the_"])}{token}{r.choice(["", "-inner", " box", "-1"])}"'

    def block(group: str | None, inner: str, tags=("div", "section")) -> str:
        tag = r.choice(("div", "div", "section", "div", "center") if plain else tags)
        return f"<{tag}{attr(group)}>{inner}</{tag}>"

    def links(lo: int, hi: int) -> str:
        items = [f'<a href="/{i}">{words(1, 4)}</a>' for i in range(r.randint(lo, hi))]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: " ".join(items), lambda: "<br>".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()

    def paragraphs(lo: int, hi: int, low=8, high=120) -> str:
        out = []
        for _ in range(r.randint(lo, hi)):
            text = words(r.choice([1, 3, low]), high) if r.random() < 0.9 else words(1, 3)
            if r.random() < 0.15:
                text = f"<b>{text}<br>"  # left open
            elif r.random() < 0.2:
                text += f' <a href="x">{words(1, 3)}</a> ' + words(3, 20)
            out.append(r.choice([f"<p>{text}</p>"] * 8 + [f"<p>{text}", f"<blockquote>{text}</blockquote>", f"<h2>{words(1, 6)}</h2><p>{text}</p>", f"<ul><li>{text}</li><li>{words(2, 20)}</li></ul>"]))
        return "".join(out)

    def boiler() -> str:
        # where nothing is named, what only its name tells from an article isn't there
        kind = r.choice(["menu", "footer", "side", "form"] if plain else ["menu", "header", "footer", "side", "notice", "advert", "form", "comment", "share"])
        if kind == "menu":
            return block(kind, links(2, 10), ("nav", "div", "nav"))
        if kind == "header":
            return block(kind, f"{r.choice(['<h1>', '<div>', '<h2>'])}{words(1, 4)}" + links(0, 4), ("header", "div"))
        if kind == "footer":
            return block(kind, f"&copy; {words(1, 12)}" + r.choice(["", links(1, 5), f"<p>{words(3, 20)}</p>"]), ("footer", "div", "footer"))
        if kind == "side":
            return block(kind, f"<h3>{words(1, 3)}</h3>" + (links(3, 8) if plain else r.choice([links(2, 8), f"<p>{words(4, 25)}</p>" + links(1, 3)])), ("aside", "div"))
        if kind == "form":
            return f"<form{attr(kind)}><label>{words(1, 4)}</label><input name=q><p>{words(2, 12)}</p><button>{words(1, 2)}</button></form>"
        if kind == "comment":
            return block("comment" if r.random() < 0.95 else None, f"<h3>{words(1, 2)}</h3>" + "".join(f"<div{attr('comment')}><b>{words(1, 2)}</b><p>{words(2, 60)}</p></div>" for _ in range(r.randint(1, 5))))
        return block(kind if r.random() < 0.98 else "advert", r.choice([words(2, 30), f"<p>{words(3, 30)}</p>"]) + r.choice(["", links(1, 2)]))

    pages = []
    for _ in range(n):
        plain = r.random() < 0.4
        tag, title = r.choice(["div", "div", "section", "td"] if plain else ["article", "article", "main", "div", "div", "section"]), words(2, 9)
        main = f"{r.choice([f'<h1>{title}</h1>', f'<h2>{title}</h2>', ''])}{paragraphs(1, 12)}"
        if r.random() < 0.25:
            cut = main.find("<p>", len(main) // 3)
            if cut > 0:
                main = main[:cut] + boiler().replace(">", ' data-label="no">', 1) + main[cut:]
        main = f'<{tag}{attr("content")} data-label="main">{main}</{tag}>'
        if tag == "td":
            main = f"<table><tr>{f'<td>{links(2, 8)}</td>' if r.random() < 0.5 else ''}{main}</tr></table>"
        for _ in range(r.randint(0, 2)):
            main = f"<div{attr(r.choice([None, 'content']))}>{boiler() if r.random() < 0.3 else ''}{main}</div>"
        before, after = "".join(boiler() for _ in range(r.randint(0, 4))), "".join(boiler() for _ in range(r.randint(0, 5)))
        page = f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='<p>';</script></head><body>{before}{main}{after}</body></html>"
        pages.append(page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.1 else page)
    return pages


def fit(pages: DataFrame | None, sample: int = SAMPLE_PAGES, generated: int = GENERATED_PAGES) -> Model:
    """A model of generated pages and of at most ``sample`` of ``pages`` (those of the smallest hashes of their page_id)."""
    found = [Page(source, marked=True) for source in generated_pages(generated)]
    if pages is not None and sample:
        usable = pages.where(F.length("html") <= SAMPLE_CHARS).withColumn("place", F.xxhash64(F.lit("sample"), "page_id"))
        # places alone are ordered first, so pages beyond the sample don't reach the driver
        last = usable.select("place").orderBy("place").limit(sample).agg(F.max("place")).first()[0]
        part = usable.where(F.col("place") <= F.lit(last)).orderBy("place", F.xxhash64("html")).limit(sample) if last is not None else usable.limit(0)
        found += [Page(r["html"]) for r in part.select("html").collect()]
    known = [(page, y) for page in found if (y := _labels(page)) is not None and len(y) > 1]
    # a page's tokens are judged by the other half of the pages
    halves = [known[0::2], known[1::2]]
    odds = [token_odds(*zip(*half)) if half else np.zeros(BUCKETS, np.float32) for half in halves]
    rows = [(features(page, odds[1 - h])[1:], y[1:]) for h, half in enumerate(halves) for page, y in half]
    return Model(BoostedTrees.fit(*(np.concatenate(x) for x in zip(*rows))), token_odds(*zip(*known)))


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                b = batch.slice(lo, 128)
                texts = extract(b.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, fit(pages))


QUERIES = {"op7_html_extract": op7_html_extract}
ORACLE_SQL: dict[str, str] = {}
