"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of blocks. Each block has its number of words and link
density, those of its neighbours, and what the markup around it says of its place. A
decision tree, trained on a small table of labelled snippets, tells main text from the rest.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerflow.llm.common import map_slices

_OPENING = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_BRACKET = re.compile(r"<(?=[a-zA-Z/!?])")
_HINTS = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)""", re.IGNORECASE)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_WORD = re.compile(r"[^\s]+")

#: Elements without text of their own for a reader.
_SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "textarea", "select", "button", "option"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track"}
#: What may stand in a head; any other tag and any text ends one that is still open.
_IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head"}
_MAIN = {"article", "main"}
_APART = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
#: Names in class, id and role that pages use for what isn't the article.
_APART_NAMES = set(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments disqus cookie cookies consent copyright "
    "footer header legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices pagination pager "
    "popup promo promotion related recommended share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "toolbar widget widgets alert gdpr reply replies respond search skip complementary contentinfo".split()
)
#: First parts of names that tell of the page's state (has-sidebar), and last parts that don't change what a name says.
_STATES = set("has have with without no not is show shows hide hides under above below before after near beside".split())
_PLACES = set("area bar block body box container content footer form header inner item items left links list main nav outer panel right section thread top wrap wrapper".split())
_MAIN_NAMES = {"article", "content", "entry", "main", "post", "story", "articlebody", "text", "body"}

FEATURES = ("words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after", "in_main", "heading", "apart", "apart_named", "beside_main")


@dataclass
class Block:
    text: list[str] = field(default_factory=list)
    linked: int = 0
    in_main: bool = False
    apart: bool = False
    apart_named: bool = False
    heading: bool = False
    #: Inside article or main; apart by a name of an element inside that.
    in_article: bool = False
    apart_inside: bool = False

    def joined(self) -> str:
        return " ".join("".join(self.text).split())


def _is_apart(name: list[str]) -> bool:
    """Whether a whole name, given by its parts, says that its element isn't the article."""
    if "".join(name) in _APART_NAMES:
        return True
    if name[0] in _STATES:
        return False
    return name[-1] in _APART_NAMES or (name[0] in _APART_NAMES and all(part in _PLACES | _APART_NAMES for part in name[1:]))


def _names(attributes: str) -> tuple[set[str], bool, bool]:
    """Parts of the names that an element has, whether one sets it apart, and whether it is hidden."""
    parts: set[str] = set()
    apart, hidden = False, bool(_HIDDEN.search(_QUOTED.sub('""', attributes)))
    for match in _HINTS.finditer(attributes):
        value = match[2] or match[3] or match[4] or ""
        hidden = hidden or (match[1].lower() == "class" and "hidden" in value.lower().split())
        for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
            own = [part for part in re.split(r"[_-]+", name) if part]
            parts.update(own)
            apart = apart or (bool(own) and _is_apart(own))
    return parts, apart, hidden


class TagScanner:
    """The tags of a page in order, in time that grows with its length whatever is broken in it.

    A tag ends at the first ">" outside quotes. Once quotes have swallowed the rest of a page
    they don't count any more, so that no text is gone through again and again.
    """

    def __init__(self, page: str):
        self._page = page
        self._quotes = True

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start and end of the next tag, "/" if it is an end tag, its name and attributes; no name if it has none."""
        page = self._page
        while opening := _OPENING.search(page, at):
            start = opening.start()
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, (len(page) if end < 0 else end + 3), "", "", ""
            if page[start + 1] in "!?":
                end = page.find(">", start)
                if end >= 0:
                    return start, end + 1, "", "", ""
                at = start + 1
                if _OPENING.search(page, at) is None or page.find(">", at) < 0:
                    return None
                continue
            name = _NAME.match(page, start + 1)
            end = self._end(name.end())
            if end < 0:
                return None
            return start, end + 1, name[1], name[2].lower(), page[name.end() : end]
        return None

    def _end(self, at: int) -> int:
        """Place of the ">" that ends a tag; -1 if there is none at all."""
        page, first = self._page, at
        while self._quotes:
            close = page.find(">", at)
            if close < 0:
                break
            mark = min((i for i in (page.find(q, at, close) for q in "\"'") if i >= 0), default=-1)
            if mark < 0:
                return close
            ending = page.find(page[mark], mark + 1)
            if ending < 0:
                break
            at = ending + 1
        self._quotes = False
        return page.find(">", first)


def flat_blocks(page: str) -> list[Block]:
    """Text blocks in page order; character references decoded, white space kept for later."""
    blocks: list[Block] = []
    # name, main, apart, apart by name, silent, inside article or main, apart by a name inside that
    stack: list[tuple[str, bool, bool, bool, bool, bool, bool]] = []
    nothing = (False,) * 6
    state = nothing
    current: Block | None = None
    links = 0
    at = 0
    open_names: Counter[str] = Counter()
    tags = TagScanner(page)

    def end_head() -> None:
        nonlocal state
        if stack and stack[-1][0] == "head":
            open_names[stack.pop()[0]] -= 1
            state = stack[-1][1:] if stack else nothing

    def put(raw: str) -> None:
        nonlocal current
        if raw and not raw.isspace():
            end_head()
        if state[3] or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            heading = any(open_names[f"h{n}"] for n in range(1, 7))
            current = Block([], 0, state[0], state[1], state[2], heading, state[4], state[5])
            blocks.append(current)
        text = html.unescape(raw)
        current.text.append(text)
        if links:
            current.linked += len(_WORD.findall(text))

    while at < len(page):
        tag = tags.next(at)
        if tag is None:
            rest = page[at:]
            cut = _BRACKET.search(rest)  # a tag that the page's end broke off
            put(rest[: cut.start()] if cut else rest)
            break
        start, end, slash, name, attributes = tag
        put(page[at:start])
        at = end
        if not name:
            continue
        if name in _BLOCKS:
            current = None
        elif name == "br" and current is not None:
            current.text.append(" ")
        if slash:
            if name == "a":
                links = max(0, links - 1)
            for depth in range(len(stack) - 1 if open_names[name] > 0 else -1, -1, -1):
                if stack[depth][0] == name:
                    open_names.subtract(s[0] for s in stack[depth:])
                    del stack[depth:]
                    break
                if stack[depth][0] in _MAIN | _APART | {"div", "section", "body"} and name not in _BLOCKS:
                    break
            state = stack[-1][1:] if stack else nothing
            continue
        if name not in _IN_HEAD:
            end_head()
        if name in _VOID or attributes.endswith("/"):
            continue
        if name == "a":
            links += 1
        if name in _BLOCKS and stack and stack[-1][0] == "p":
            open_names[stack.pop()[0]] -= 1  # a paragraph ends where the next block begins
            state = stack[-1][1:] if stack else nothing
        parts, named, hidden = _names(attributes) if attributes.strip() else (set(), False, False)
        if name in ("html", "body"):
            named = hidden = False  # such names tell of the page, not of a part of it
        main, apart, apart_named, silent, in_article, apart_inside = state
        if name in _MAIN and not in_article:
            in_article, apart_inside = True, False
        if name in _MAIN or (parts & _MAIN_NAMES and not named and name in ("div", "section", "td")):
            main = True
        # The headline block of an article is part of it.
        apart = apart or (name in _APART and not (name == "header" and main))
        apart_named = apart_named or named
        apart_inside = apart_inside or named
        silent = silent or name in _SILENT or hidden
        state = (main, apart, apart_named, silent, in_article, apart_inside)
        stack.append((name, *state))
        open_names[name] += 1
        if name in _RAW:
            closing = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else len(page)
            open_names[stack.pop()[0]] -= 1
            state = stack[-1][1:] if stack else nothing
    blocks = [b for b in blocks if b.joined()]
    # Names around the only articles are not about them; comments are articles beside others.
    if not any(b.in_main and not b.apart_named for b in blocks):
        for block in blocks:
            if block.in_article:
                block.apart_named = block.apart_inside
    return blocks


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row per block in the order of FEATURES; beyond either end there are no words."""
    words = np.array([0.0, *(len(b.joined().split()) for b in blocks), 0.0])
    share = np.array([0.0, *(b.linked for b in blocks), 0.0]) / np.maximum(words, 1)
    has_main = any(b.in_main for b in blocks)
    marks = [(b.in_main, b.heading, b.apart, b.apart_named, has_main and not b.in_main) for b in blocks]
    marks = np.array(marks, float).reshape(len(blocks), 5)
    sides = [words[1:-1], share[1:-1], words[:-2], share[:-2], words[2:], share[2:]]
    return np.column_stack([*sides, marks])


@dataclass(frozen=True)
class Tree:
    """A leaf has no feature; otherwise `below` holds rows with feature <= limit."""

    main: bool
    feature: int | None = None
    limit: float = 0.0
    below: Tree | None = None
    above: Tree | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.main)
        low = x[:, self.feature] <= self.limit
        out = np.empty(len(x), bool)
        out[low], out[~low] = self.below(x[low]), self.above(x[~low])
        return out


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """A tree of binary splits, each the one that lowers Gini impurity most; ties to the later feature."""
    main = bool(y.mean() >= 0.5) if len(y) else False
    if depth == 0 or len(y) < 2 or y.all() or not y.any():
        return Tree(main)
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, None, 0.0)
    for feature in range(x.shape[1] - 1, -1, -1):
        values = np.unique(x[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] <= limit
            impurity = sum(part.mean() * 2 * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low))
            if impurity < best[0] - 1e-12:
                best = (impurity, feature, limit)
    if best[1] is None:
        return Tree(main)
    low = x[:, best[1]] <= best[2]
    return Tree(main, best[1], best[2], fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1))


_LONG = "The council agreed on the plan after a long debate in which every member spoke about the cost of the bridge and the time it needs."
_MORE = "Work begins in spring. Until then the old bridge stays open for carts, walkers and the two buses that serve the valley each day."
#: Labelled snippets: blocks whose text begins with "+" are main text.
LABELLED = (
    f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News today</a></li></ul></nav><div class='ad'>Buy two pay for one now at our shop</div>"
    f"<article><h1>+A bridge</h1><p>+{_LONG}</p><p>+Yes.</p><p>+{_MORE}</p></article><footer>Copyright by the paper</footer>",
    f"<div class='header'>The daily valley paper</div><div id='content'><h2>+News</h2><p>+{_MORE}</p><p>+Short one.</p><ul><li>+first point of it</li>"
    f"<li>+second</li></ul></div><div class='sidebar'><p>{_LONG}</p><p>More</p></div><div id='comments'><p>{_MORE}</p><p>I agree</p></div>",
    f"<main><p>+{_LONG}</p><p>+See <a href=/x>+the earlier report</a> for +more on it.</p><aside><p>{_MORE}</p></aside>"
    f"<form><p>Your name and mail, please</p></form><p>+{_MORE}</p></main><div class='cookie-notice'><p>{_LONG}</p></div>",
    f"<p>+{_LONG}</p><p>+{_MORE}</p><p>+It opens soon, they say, and few doubt it now.</p><p><a href=/a>About us</a> <a href=/b>Contact</a></p><p><a href=/c>Next page</a></p>",
    f"<ul><li><a href=/1>One</a></li><li><a href=/2>Two and more</a></li></ul><p>+{_MORE}</p><p>+{_LONG}</p><p>Imprint</p>",
    f"<article><header><h1>+Rain</h1></header><p>+{_MORE}</p><p>+<a href=/w>+Weather</a></p><div class='related'><p>Snow</p><p>{_LONG}</p></div>"
    f"<section class='comments'><p>{_MORE}</p><p>Nice</p></section><p>+{_LONG}</p><p class='share'>Share this with a friend</p></article>",
    f"<nav><a href=/>Home</a></nav><article><h1>+Wind</h1><p>+{_LONG}</p><p>+{_MORE}</p></article>",
    f"<div class='main'><p>+{_MORE}</p><p>+So be it.</p></div>",
    f"<article><p>+{_MORE}</p><p>+Yes.</p><p>+No</p></article>",
    f"<div><p>{_LONG}</p><p>{_MORE}</p></div><article><p>+{_MORE}</p><p>+Yes.</p></article><div><p>{_LONG}</p><p>So I think</p></div>",
    f"<main><h2>+Two</h2><p>+{_LONG}</p><p>+End</p></main>",
    f"<p>+{_LONG}</p><p>Imprint</p>",
    f"<p>+{_MORE}</p><p>+{_LONG}</p><p>+It will not be the last bridge here, the mayor said on Friday.</p>",
    f"<article><p>+{_LONG}</p><p>+Yes.</p></article><div class='footer'><p>Write to us at any time of day or night</p></div>",
    f"<header><p>{_LONG}</p></header><article><p>+One</p><p>+{_MORE}</p><div class='newsletter'>Get it by mail</div></article><footer><p>{_LONG}</p></footer>",
)


@functools.cache
def trained_tree(labelled: tuple[str, ...] = LABELLED) -> Tree:
    x, y = [], []
    for page in labelled:
        blocks = flat_blocks(page)
        x.append(block_features(blocks))
        y += [block.joined().startswith("+") for block in blocks]
    return fit_tree(np.concatenate(x), np.array(y, float) > 0)


def main_text(page: str, tree: Tree) -> str:
    blocks = flat_blocks(page)
    if not blocks:
        return ""
    return "\n".join(block.joined() for block, keep in zip(blocks, tree(block_features(blocks)), strict=True) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of `pages`: page_id, url, text and n_chars (code points).

    Blocks of main text are joined by a line break; null and empty pages have an empty text,
    repeated rows come back repeated, a null page_id or url stays null.
    """

    def work():
        tree = trained_tree()

        def batch(part: pa.RecordBatch) -> dict:
            texts = [main_text(page or "", tree) for page in part.column("html").to_pylist()]
            return {
                "page_id": part.column("page_id"),
                "url": part.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array(map(len, texts), pa.int64()),
            }

        return batch

    columns = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html")
    return map_slices(columns, work, "page_id long, url string, text string, n_chars long")
