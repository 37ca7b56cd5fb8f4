"""Main text of web pages by minimum cut.

A page is cut into blocks of text. A logistic classifier's log-odds for content and for boilerplate become capacities
from a block to the two terminals; smoothness edges join blocks that follow each other and blocks of one parent, the
stronger the nearer they are in the document's tree. The minimum cut, found by maximum flow, is the labelling of least cost. Blocks whose
terminal capacity outweighs all their edges are settled beforehand, which leaves the cut as it is. The classifier is
trained here on pages generated with labels.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import map_slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("script style noscript template title textarea select option button svg iframe object canvas head math".split())
RAW = frozenset("script style noscript template title textarea svg iframe object canvas math select button".split())
EMPTY = frozenset("hr br img input meta link base area col embed source track wbr".split())
#: Tags of an ancestor and words of its attributes that count as features.
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "table", "p", "li", "blockquote", "pre", "dialog", "address", "figure")
START, END = r"(?:^|[\s_-])", r"(?=$|[\s_\d-])"
HINTS = {
    "advert": rf"{START}(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|dfp|outbrain|taboola){END}",
    "menu": rf"{START}(?:\w*menu|nav|navbar|\w*navigation|breadcrumbs?|tabs|toolbar|pagination|pager|skip){END}",
    "side": rf"{START}(?:side|sidebar|aside|widgets?|related|recommend\w*|popular|trending|more|teasers?|rail){END}",
    "notice": rf"{START}(?:cookies?|consent|notice|gdpr|alert|popup|modal|overlay|subscribe|newsletter|paywall|signup|login){END}",
    "reader": rf"{START}(?:comments?|comment(?:list|ary-thread)|disqus|reply|replies|respond|discussion|feedback|reviews){END}",
    "foot": rf"{START}(?:foot|footer|copyright|legal|colophon|masthead|header|logo|share|social|follow|meta|byline|tags){END}",
    "content": rf"{START}(?:content|article|story|post|entry|main|body|text|prose|page){END}",
}
HINT = {k: re.compile(v, re.I) for k, v in HINTS.items()}
PLAIN = ("links", "words", "short", "stops", "first", "last", "heading", "mark", "siblings", "bias")
NAMES = tuple(f"in_{t}" for t in TAGS) + tuple(HINTS) + PLAIN
#: Strengths of the edges between blocks that follow each other, and between blocks of one parent, as ``choose_strengths`` finds them.
FOLLOW, KIN = 1.0, 1.0


class Block:
    __slots__ = ("flags", "linked", "parent", "path", "tag", "text")

    def __init__(self, text, tag, path, parent, flags, linked):
        self.text, self.tag, self.path, self.parent, self.flags, self.linked = text, tag, path, parent, flags, linked


def blocks_of(html: str) -> list[Block]:
    """Blocks of visible text in page order; broken markup is read as far as it goes."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, number, flags of it and its ancestors, depth of unseen elements
    number, at, linking, linked = 0, 0, False, 0
    parts: list[str] = []

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = [s[1] for s in stack]
                parent = next((s[1] for s in reversed(stack) if s[0] not in ("p", "li", "td", "th", "dt", "dd") and not s[0][1:].isdigit()), 0)
                out.append(Block(text, stack[-1][0] if stack else "", path, parent, stack[-1][2] if stack else 0, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(text):
        nonlocal linked
        if text and not (stack and stack[-1][3]):
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if linking:
                linked += len(text.strip())

    while m := TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                linking = False
            elif tag in BLOCKS or tag in UNSEEN:
                flush()
                linking = False
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html) if tag in ("script", "style") else at
            parts.append(" ")
            continue
        if tag == "a":
            linking = "href" in attributes
        elif tag in EMPTY:
            if tag == "hr":
                flush()
            parts.append(" ")
        elif tag in BLOCKS or tag in UNSEEN:
            flush()
            linking = False
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("li", "dd", "dt", "tr", "td", "th"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ("ul", "ol", "dl", "table", "menu"):
                        break
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            if tag == "body":
                stack = [s for s in stack if s[0] == "html"]
            number += 1
            flags = (stack[-1][2] if stack else 0) | (1 << TAGS.index(tag) if tag in TAGS else 0)
            if attributes and (names := ATTRIBUTE.findall(attributes)):
                said = " ".join(a or b or c for a, b, c in names)
                for i, hint in enumerate(HINT.values()):
                    if hint.search(said):
                        flags |= 1 << (len(TAGS) + i)
            hidden = (stack[-1][3] if stack else 0) or tag in UNSEEN or (" hidden" in attributes.lower() and bool(re.search(r"\shidden(?:\s|=|$)", attributes, re.I)))
            stack.append((tag, number, flags, hidden))
    add(html[at:])
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row of NAMES for each block."""
    n, kin = len(blocks), {}
    for b in blocks:
        kin[b.parent] = kin.get(b.parent, 0) + (b.tag == "p")
    x = np.zeros((n, len(NAMES)))
    span = len(TAGS) + len(HINTS)
    for i, b in enumerate(blocks):
        for j in range(span):
            if b.flags >> j & 1:
                x[i, j] = 1
        size = b.text.count(" ") + 1
        x[i, span:] = (b.linked, min(np.log1p(size), 5) / 5, size < 4, b.text[-1] in ".!?…\"”»:;", i < 2, i >= n - 2, b.tag[:1] == "h" and b.tag[1:].isdigit(), "©" in b.text, min(kin[b.parent], 4) / 4, 1)
    return x


def edges_of(blocks: list[Block], follow: float | None = None, kin: float | None = None) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next, and with the last block before that of the same parent."""
    follow, kin = FOLLOW if follow is None else follow, KIN if kin is None else kin
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            common = 0
            for x, y in zip(a.path, b.path, strict=False):
                if x != y:
                    break
                common += 1
            out.append((i - 1, i, follow / (1 + max(0, len(a.path) + len(b.path) - 2 * common - 2))))
        j = last.get(b.parent)
        if j is not None and j < i - 1:
            out.append((j, i, kin))
        last[b.parent] = i
    return out


def minimum_cut(net: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True where a node is on the source's side of the least cut. ``net``: capacity from the source less that to the sink."""
    n = len(net)
    label: list[bool | None] = [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    left = [float(v) for v in net]
    todo = deque(range(n))
    while todo:  # a node that outweighs its open edges takes its side in some least cut, and pulls its neighbours
        i = todo.popleft()
        if label[i] is None and abs(left[i]) >= sum(near[i].values()):
            label[i] = left[i] > 0
            for j, w in near[i].items():
                left[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    flow_nodes = [i for i in range(n) if label[i] is None]
    if flow_nodes:
        room = {i: dict(near[i]) for i in flow_nodes}
        excess, need = {i: max(left[i], 0.0) for i in flow_nodes}, {i: max(-left[i], 0.0) for i in flow_nodes}
        while True:  # shortest augmenting paths from any node with excess to any that needs
            came = {i: None for i in flow_nodes if excess[i] > 1e-12}
            queue, end = deque(came), None
            while queue:
                i = queue.popleft()
                if need[i] > 1e-12:
                    end = i
                    break
                for j, w in room[i].items():
                    if w > 1e-12 and j not in came:
                        came[j] = i
                        queue.append(j)
            if end is None:
                for i in flow_nodes:
                    label[i] = i in came
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            amount = min(need[end], excess[path[-1]], *[room[b][a] for a, b in zip(path, path[1:], strict=False)])
            need[end] -= amount
            excess[path[-1]] -= amount
            for a, b in zip(path, path[1:], strict=False):
                room[b][a] -= amount
                room[a][b] = room[a].get(b, 0) + amount
    return np.array(label, bool)


def generated_page(r: np.random.Generator) -> tuple[str, set[str]]:
    """A page, and the texts of its content blocks; every block's text is its own. Tags and classes often say little: many pages are built of plain divs,
    sections hold articles as well as comments, and some pages are nothing but a few paragraphs."""
    letters, content = "abcdefghijklmnopqrstuvwxyz", set()
    pick = lambda *a: a[int(r.integers(len(a)))]
    word = lambda: "".join(letters[int(k)] for k in r.integers(0, 26, int(r.integers(2, 9))))
    words = lambda a, b: " ".join(word() for _ in range(int(r.integers(a, b))))
    maybe = lambda p: r.random() < p
    neutral = lambda: pick("box", "c1", "wrap", "row", "inner", "commentary", "block", "grid", "x" + word(), "navy", "responsive", "trail")

    def keep(text):
        content.add(" ".join(text.split()))
        return text

    brief, linky, silent = maybe(0.2), maybe(0.12), maybe(0.3)

    def sentence():
        return ". ".join(words(3, 14).capitalize() for _ in range(int(r.integers(1, 6)))) + pick(".", ".", "!", "?")

    def prose():
        if brief:
            return keep(words(1, 5).capitalize() + pick(".", ""))
        if linky and maybe(0.7):
            parts = [(words(2, 6), maybe(0.6)) for _ in range(int(r.integers(2, 6)))]
            keep(" ".join(t for t, _ in parts) + ".")
            return " ".join(f'<a href="/{word()}">{t}</a>' if a else t for t, a in parts) + "."
        return keep(sentence())

    def listed(k):  # now and then an entry without a link, as the page that one is on, or with a teaser's text
        entry = lambda: words(1, 4) if maybe(0.12) else f'<a href="/{word()}">{words(1, 4)}</a>' + (f" {words(3, 9)}" if maybe(0.1) else "")
        return "".join(f"<li>{entry()}</li>" for _ in range(k))

    def mine(a, b):  # an entry of the article's own list, which may be a link
        t = keep(words(a, b))
        return f'<a href="/{word()}">{t}</a>' if linky or maybe(0.15) else t

    def wrap(tag, names, inner, said=0.7):
        name = pick(*names) if maybe(said) else neutral() if maybe(0.5) else ""
        return f"<{tag}{f' {pick("class", "id")}="{name}"' if name else ''}>{inner}</{tag}>"

    def body_parts():
        out = [f"<h1>{keep(words(2, 12))}</h1>"] if maybe(0.8) else []
        if maybe(0.12):  # text parted by line breaks is one block
            lines = [sentence() for _ in range(int(r.integers(2, 6)))]
            keep(" ".join(lines))
            return [*out, f"<div>{pick('<br>', '<br><br>', '<br/>').join(lines)}</div>"]
        for _ in range(int(r.integers(1, 3 if brief else 12))):
            k = r.random()
            if k < 0.66:
                out.append(f"<p>{prose()}</p>")
            elif k < 0.74:
                out.append(f"<h2>{keep(words(1, 6))}</h2><p>{prose()}</p>")
            elif k < 0.81:
                out.append("<ul>" + "".join(f"<li>{mine(2, 14)}</li>" for _ in range(int(r.integers(2, 7)))) + "</ul>")
            elif k < 0.85:
                out.append(f"<blockquote>{prose()}</blockquote>")
            elif k < 0.88:
                out.append("<table>" + "".join(f"<tr><td>{mine(1, 4)}</td><td>{mine(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.91:
                out.append(f"<pre>{keep(words(3, 12))}</pre>")
            elif k < 0.94:
                out.append(f"<div>{prose()}</div>")
            elif k < 0.96:
                out.append(ad())
            else:
                out.append(f"<p>{keep(words(1, 4) + pick('.', '', '!'))}</p>")
        return out

    ad = lambda: wrap("div", ("ad", "advert", "ads-top", "sponsored", "promo-box", "ad-slot"), ". ".join(words(2, 9).capitalize() for _ in range(int(r.integers(1, 4)))) + ".", 1)
    if maybe(0.08):  # nothing but text
        if maybe(0.4):
            return keep(sentence()), content
        return "".join(f"<p>{prose()}</p>" for _ in range(int(r.integers(1, 5)))), content
    parts = []
    if maybe(0.5):
        parts.append(wrap(pick("header", "header", "div"), ("header", "masthead", "site-header", "logo"), f"<p>{words(1, 5)}</p>", 1))
    if maybe(0.85):
        parts.append(wrap(pick("nav", "nav", "div"), ("menu", "main-nav", "navbar", "breadcrumbs"), f"<ul>{listed(int(r.integers(2, 8)))}</ul>"))
    if maybe(0.4):
        parts.append(wrap("div", ("cookie-notice", "consent", "alert notice", "newsletter-popup"), pick(f"<p>{words(6, 20)}.</p>", words(6, 20) + "."), 1))
    if maybe(0.6):
        parts.append(ad())
    inner = "".join(body_parts())
    if maybe(0.15):
        half = "".join(f"<p>{prose()}</p>" for _ in range(int(r.integers(1, 4))))
        inner = f"<section>{inner}</section><section>{half}</section>"
    names = ("content", "post", "story", "entry-content", "article-body", "text")
    if silent:
        shell = wrap(pick("div", "div", "section", "main"), (neutral(),), inner)
    else:
        shell = inner if maybe(0.1) else wrap(pick("article", "article", "main", "div", "section"), names, inner)
    if maybe(0.25):
        shell = wrap(pick("main", "section", "div"), names, shell, 0.3)
    parts.append(shell)
    if maybe(0.25):  # links to other pages in a box without a telling name
        parts.append(wrap("div", (neutral(),), f"<h3>{words(1, 4)}</h3><ul>{listed(int(r.integers(3, 8)))}</ul>"))
    if maybe(0.4):
        tag = pick("aside", "div")
        parts.append(wrap(tag, ("sidebar", "related", "widget", "popular"), pick(f"<h3>{words(1, 3)}</h3><ul>{listed(4)}</ul>", f"<p>{words(4, 25)}.</p>"), 0.6 if tag == "aside" else 1))
    if maybe(0.3):
        said = "".join(f"<{t}>{words(4, 30).capitalize()}{pick('.', '!', '')}</{t}>" for t in [pick("p", "p", "div", "li")] * int(r.integers(1, 5)))
        parts.append(wrap(pick("section", "div", "ul"), ("comments", "comment-list", "disqus", "replies", "comment-thread"), said, 1))
    if maybe(0.3):
        parts.append(f"<form><label>{words(1, 4)}</label><p>{words(3, 12)}</p><input></form>")
    if maybe(0.85):
        tag = pick("footer", "footer", "div")
        parts.append(wrap(tag, ("footer", "site-footer", "copyright", "legal"), pick(f"&copy; {words(1, 3)} &middot; {words(3, 14).capitalize()}. {words(2, 8)}.", f"<p>{words(3, 14)}. All rights reserved.</p>"), 0.6 if tag == "footer" else 1))
    whole = "".join(parts)
    return f"<html><head><title>{words(2, 6)}</title></head><body>{wrap('div', ('page', 'site'), whole, 0.3) if maybe(0.3) else whole}</body></html>", content


def generated(pages: int, seed: int) -> list[tuple[list[Block], np.ndarray, np.ndarray]]:
    """(blocks, features, labels) of generated pages."""
    r, out = np.random.default_rng(seed), []
    for _ in range(pages):
        html, content = generated_page(r)
        blocks = blocks_of(html)
        out.append((blocks, features(blocks), np.array([b.text in content for b in blocks])))
    return out


def train(pages: int = 800, seed: int = 21, decay: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights of the classifier (log-odds of content) from generated pages: Newton's steps on the likelihood, with a ridge that keeps the odds of any one sign modest."""
    made = generated(pages, seed)
    x, y = np.concatenate([f for _, f, _ in made]), np.concatenate([c for _, _, c in made]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (y - p) - decay * w)
    return w


def wrong(made: list, weights: np.ndarray, follow: float, kin: float) -> int:
    """Blocks that the cut labels wrongly."""
    return sum(int((minimum_cut(f @ weights, edges_of(b, follow, kin)) != c).sum()) for b, f, c in made)


def choose_strengths(pages: int = 300, grid: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0), seed: int = 51) -> dict[tuple[float, float], int]:
    """Wrong blocks for each (follow, kin) of a grid, by twofold cross-validation over generated pages."""
    out = dict.fromkeys([(a, b) for a in grid for b in grid], 0)
    for k in (0, 1):
        weights, test = train(pages, seed + k), generated(pages, seed + 1 - k)
        for pair in out:
            out[pair] += wrong(test, weights, *pair)
    return out


def main_text(html: str | None, weights: np.ndarray) -> str:
    """The content blocks in page order, parted by an empty line."""
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    inside = minimum_cut(features(blocks) @ weights, edges_of(blocks))
    return "\n\n".join(b.text for b, c in zip(blocks, inside, strict=True) if c)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), weights: np.ndarray | None = None) -> DataFrame:
    """(id, keep..., text, n_chars) for each row, from its whole page.

    A null or empty page, and one without content, gives an empty text. Rows are independent of each other: repeated rows give
    repeated results, and a null id is kept. Other columns play no part. White space of any kind inside a block becomes one space.
    """
    weights = train() if weights is None else weights
    kinds = dict(pages.dtypes)
    cols = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("__html"), *keep)
    schema = f"id {kinds[id_col]}" + "".join(f", `{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long"

    def make():
        def f(b: pa.RecordBatch):
            texts = [main_text(h, weights) for h in b["__html"].to_pylist()]
            return pa.RecordBatch.from_arrays([b["id"], *[b[c] for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", *keep, "text", "n_chars"])

        return f

    return map_slices(cols, "__html", schema, make)
