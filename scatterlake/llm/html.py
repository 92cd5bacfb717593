"""Main text of web pages by minimum cut.

A page is cut into text blocks. A logistic classifier, fitted on generated page
templates (header, menu, notice, advert, sidebar, form, comments, footer around
an article, in many markups), gives each block the cost of being content and of
being boilerplate; these are its terminal capacities. Neighbours in page order
and under one parent get smoothness edges that weaken with their distance in the
tree. The minimum cut separates content from boilerplate: blocks whose own cost
outweighs their edges are fixed first (they lie on that side of a minimum cut),
augmenting paths solve the rest.

Blocks: every element but the inline ones starts one; <br> is white space inside
it, and so are drawings and formulas with all that is in them, until a tag that
can't stand there ends them. Only scripts, styles, text areas and titles are
dropped, unclosed ones to the end of the page. Character references are decoded, white space becomes one space, blocks are
trimmed and joined in page order by one line feed. Defined results: null or empty
html, and pages without content, give an empty text; unclosed and crossed tags,
unclosed comments and tags cut off by the end of the page are tolerated; repeated
rows give equal results; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.llm.tables import table

ADJACENT, SIBLING, TEMPLATES = 0.8, 0.5, 400

_TOKEN = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)
      |(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
      |(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)
      |[a-zA-Z/!?][^>]*(?:>|\Z))""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|style|data-testid)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr link meta base picture source svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open drawing or formula.
_BREAKOUT = frozenset("address article aside b big blockquote body br center code dd div dl dt em embed figure footer form h1 h2 h3 h4 h5 h6 head header hr i img li listing main menu meta nav nobr ol p pre ruby s section small span strike strong sub sup table tt u ul var".split())
#: An opening tag of the key closes open elements of the value, up to the listed barriers.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Words of class, id, role and itemprop, by what they say about an element.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager skip topbar toolbar tabs tablist",
    "header": "header masthead banner hero branding logo topbar",
    "footer": "footer foot colophon copyright contentinfo legal disclaimer",
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular more complementary teaser teasers",
    "advert": "ad ads adv advert advertisement advertising adsense adslot adbox sponsor sponsored promo promotion promoted outbrain taboola dfp",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog alertdialog banner paywall toast",
    "form": "form search searchform login signup signin register subscribe subscription newsletter optin contact poll",
    "comment": "comment comments commentlist respond reply replies disqus discussion feedback reader",
    "share": "share sharing social follow like tags tagcloud byline meta author",
    "content": "article articlebody content post entry story main body text maincontent prose page blogpost",
}
_OF_WORD = {w: k for k, kind in enumerate(WORDS) for w in WORDS[kind].split()}
_ABOUT = frozenset("has no with without not".split())
_TAGS = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 6, "fieldset": 6, "dialog": 5, "article": 9, "main": 9}
_NOTES = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved|cookies?\b|privacy|subscribe|sign (?:in|up)|log ?in|advertisement|sponsored", re.I)
KINDS = len(WORDS)
#: kinds of ancestors (as tag, as word), then the block's own figures
FEATURES = 2 * KINDS + 12
#: Flag of what stands in a drawing or formula.
_FOREIGN = 1 << 2 * KINDS + 1


class Place:
    """A block element with the one around it and the number of those around both."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Place | None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 1


class Block:
    __slots__ = ("parts", "linked", "place", "flags", "tag", "comment_inside")

    def __init__(self, place: Place | None, flags: int, tag: str):
        self.parts: list[str] = []
        self.linked, self.place, self.flags, self.tag = 0, place, flags, tag


def _flags(name: str, attrs: str) -> int:
    """Bits of the kinds that an element is of: by tag, by words (shifted), hidden (last)."""
    bits = 1 << _TAGS[name] if name in _TAGS else 0
    if attrs and "=" in attrs or "hidden" in attrs:
        if name not in ("body", "html"):
            for m in _ATTRIBUTE.finditer(attrs):
                key = m[1].lower()
                if key == "style":
                    continue
                before = ""
                for w in _SPLIT.split(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()):
                    k = _OF_WORD.get(w)
                    if k is not None and before not in _ABOUT:  # has-sidebar isn't a sidebar
                        bits |= 1 << KINDS + k
                    before = w
        if _HIDDEN.search(attrs):
            bits |= 1 << 2 * KINDS
    return bits


_flags = functools.lru_cache(1 << 14)(_flags)


def blocks(page: str) -> list[tuple[str, Block]]:
    """The text blocks of a page in order, white space normalised, with where they stand."""
    out: list[tuple[str, Block]] = []
    # name, flags so far, and the innermost block element: its place and name
    stack: list[tuple[str, int, Place | None, str]] = []
    depth: Counter[str] = Counter()  # open elements by name
    links, head = 0, False
    now = Block(None, 0, "")

    def cut(k: int) -> None:
        nonlocal links
        for x in stack[k:]:
            links -= x[0] == "a"
            depth[x[0]] -= 1
        del stack[k:]

    def within(x: tuple) -> bool:
        return x[0] in INLINE or x[1] & _FOREIGN > 0

    def close() -> None:
        nonlocal now
        if now.parts:
            text = " ".join("".join(now.parts).split())
            if text:
                out.append((text, now))
        _, flags, place, tag = stack[-1] if stack else ("", 0, None, "")
        now = Block(place, flags, tag)

    def take(raw: str) -> None:
        if head:
            return
        text = html.unescape(raw) if "&" in raw else raw
        now.parts.append(text)
        if links:
            now.linked += len("".join(text.split()))

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                take(" ")
                end = page.find(">", m.start()) + 1
                if stack and stack[-1][1] & _FOREIGN and page[end - 2 : end] == "/>":
                    at = end  # empty in a drawing
            continue
        name = name.lower()
        foreign = bool(stack and stack[-1][1] & _FOREIGN)
        if foreign and name in _BREAKOUT and not m["end"]:
            k = max(k for k in range(len(stack)) if not k or not stack[k - 1][1] & _FOREIGN)
            cut(k)
            foreign = False
        inline = name in INLINE or foreign and name not in _BREAKOUT
        if m["end"]:
            if name == "head":
                head = False
            if name in ("body", "html", "br"):
                take(" ") if name == "br" else None
                continue
            for k in range(len(stack) - 1, -1, -1) if depth[name] else ():
                if stack[k][0] == name:
                    break
                if inline and not within(stack[k]):
                    k = -1
                    break
            else:
                k = -1
            if k >= 0:
                cut(k)
            if not inline:
                close()
            continue
        if name == "head":
            head = True
            continue
        if head and not inline:
            head = False
        if not inline:
            # an open paragraph ends at a new block; open inline elements end with it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    cut(k)
                    break
                if not within(stack[k]):
                    break
            if name in _CLOSES:
                ends, barrier = _CLOSES[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        cut(k)
                        break
                    if stack[k][0] in barrier:
                        break
        attrs = m["attrs"]
        if name == "br":
            take(" ")
        if name not in VOID and not attrs.endswith("/"):
            _, flags, place, tag = stack[-1] if stack else ("", 0, None, "")
            flags |= _flags(name, attrs)
            if name in ("svg", "math"):
                flags |= _FOREIGN
            elif name == "foreignobject":
                flags &= ~_FOREIGN
            one = (name, flags, place, tag)
            stack.append(one if within(one) else (name, flags, Place(place), name))
            depth[name] += 1
            links += name == "a"
        if not inline:
            close()
    if at < len(page):
        take(page[at:])
    close()
    return out


def describe(found: list[tuple[str, Block]]) -> list[list[float]]:
    """Features of each block of one page."""
    total = sum(len(t) for t, _ in found) or 1
    rows = []
    for k, (text, b) in enumerate(found):
        flags = b.flags
        row = [float(flags >> i & 1) for i in range(2 * KINDS)]
        n = len(text) - text.count(" ")
        words = text.count(" ") + 1
        heading = b.tag[:1] == "h" and b.tag[1:].isdigit()
        row += [
            float(flags >> 2 * KINDS & 1), min(1.0, b.linked / max(1, n)), min(words, 60) / 20, float(words < 4), float(text[-1] in ".!?…。\"”»:"), float(heading),
            float(b.tag == "p"), float(b.tag == "li"), float(bool(_NOTES.search(text)) and words < 60), float(flags & 1 << 9 > 0 and flags & (1 << 1 | 1 << 2 | 1 << 3) > 0), len(text) / total, k / len(found),
        ]
        rows.append(row)
    return rows


def template(rnd: random.Random) -> list[tuple[str, bool]]:
    """A generated page as (markup, is content) pieces; block texts are marked by their label."""
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("bcdlmnrst") for _ in range(rnd.randrange(1, 5)))
    text = lambda a, b: " ".join(word() for _ in range(rnd.randrange(a, b)))
    ended = lambda x: x.rstrip(".") + rnd.choice(["", ".", "."])  # noqa: E731  no side is told by its punctuation
    yes, no = (lambda x: "\1" + ended(x)), (lambda x: "\2" + ended(x))
    link = lambda: f'<a href="/{word()}">{no(text(1, 3))}</a>'
    attr = lambda kind: rnd.choice(["class", "id"]) + f'="{rnd.choice(kind.split())}{rnd.choice(["", "", "-" + word(), " " + word()])}"'
    some = lambda p: rnd.random() < p

    def wrap(tag: str, kind: str, inner: str, plain: float = 0.4) -> str:
        if some(plain):
            return f"<{tag}>{inner}</{tag}>"
        return f"<div {attr(kind)}>{inner}</div>" if some(0.7) else f"<{tag} {attr(kind)}>{inner}</{tag}>"

    menu = lambda: wrap("nav", WORDS["menu"], "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randrange(2, 9))) + "</ul>")
    advert = lambda: f"<div {attr(WORDS['advert'])}>{rnd.choice(['<p>', ''])}{no(text(2, 30))}</div>"
    notice = lambda: f"<div {rnd.choice([attr(WORDS['notice']), 'role=' + rnd.choice(['dialog', 'alert'])])}><p>{no(text(4, 40) + rnd.choice(['', ' cookies']))}</p>{'<p>' + link() + '</p>' if some(0.5) else ''}</div>"
    share = lambda: f"<div {attr(WORDS['share'])}>{rnd.choice([link() + link(), no(text(1, 6)), '<span>' + no(text(1, 6)) + '</span>'])}</div>"
    hidden = lambda: f"<div {rnd.choice(['hidden', 'style=\"display:none\"', 'aria-hidden=\"true\"'])}><p>{no(text(1, 40))}</p></div>"
    side = lambda: wrap("aside", WORDS["side"], f"<h3>{no(text(1, 4))}</h3>" + "".join(rnd.choice([f"<p>{no(text(4, 60))}</p>", f"<p>{link()}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul>"]) for _ in range(rnd.randrange(1, 4))))
    form = lambda: rnd.choice([f"<form><label>{no(text(1, 5))}</label> <input><p>{no(text(2, 15))}</p></form>", f"<div {attr(WORDS['form'])}><form><p>{no(text(2, 20))}</p></form></div>"])
    comment = lambda: rnd.choice([f"<div {attr('comment comments')}><p>{no(text(3, 60))}</p></div>", f"<article {attr('comment')}><p>{no(text(3, 60))}</p></article>", f"<li {attr('comment')}><p>{no(text(3, 60))}</p></li>"])
    comments = lambda: rnd.choice(["<section id=\"comments\">", f"<div {attr('comments commentlist discussion')}>", f"<ol {attr('commentlist comments')}>"]) + (f"<h3>{no(text(1, 4))}</h3>" if some(0.6) else "") + "".join(comment() for _ in range(rnd.randrange(1, 5)))

    def closed(markup: str) -> str:
        return markup + {"<s": "</section>", "<d": "</div>", "<o": "</ol>"}[markup[:2]]

    def body() -> str:
        parts = []
        for _ in range(rnd.randrange(1, 9)):
            parts.append(
                rnd.choices(
                    [f"<p>{yes(text(1, 90))}</p>", f"<h2>{yes(text(1, 8))}</h2>", "<ul>" + "".join(f"<li>{yes(text(1, 20))}</li>" for _ in range(rnd.randrange(2, 5))) + "</ul>", f"<blockquote><p>{yes(text(3, 40))}</p></blockquote>", f"<pre>{yes(text(2, 30))}</pre>",
                     f"<table><tr><td>{yes(text(1, 4))}</td><td>{yes(text(1, 4))}</td></tr></table>", f"<figure><figcaption>{yes(text(2, 14))}</figcaption></figure>", rnd.choice([advert, side, share, hidden])(), f'<p>{yes(text(2, 30))} <a href="x">{yes(text(1, 6))}</a> {yes(text(1, 9))}</p>'],
                    [10, 2, 1, 1, 0.6, 0.6, 0.6, 1, 2],
                )[0]
            )
        return "".join(parts)

    title = f"<h1>{yes(text(1, 12))}</h1>" if some(0.8) else ""
    title = f"<header>{title}</header>" if title and some(0.15) else title
    inner = title + body() + (closed(comments()) if some(0.2) else "")
    article = rnd.choice([f"<article>{inner}</article>", f"<main>{inner}</main>", f"<article {attr(WORDS['content'])}>{inner}</article>", f"<div {attr(WORDS['content'])}>{inner}</div>", f"<main><article>{inner}</article></main>", f"<div>{inner}</div>", inner])
    page = wrap("header", WORDS["header"], rnd.choice([f"<p>{no(text(1, 30))}</p>", link(), menu(), f"<div>{no(text(1, 5))}</div>"])) if some(0.5) else ""
    page += "".join(x() for x in (menu, notice, advert, side, form, hidden) if some(0.3)) + article
    page += "".join(x() for x in (lambda: closed(comments()), side, advert, form, notice, menu, hidden, share) if some(0.3))
    page += wrap("footer", WORDS["footer"], rnd.choice([f"<p>{no('© ' + text(1, 30))}</p>", no("&copy; " + text(2, 20)), "<ul><li>" + link() + "</li></ul>" + f"<p>{no(text(3, 30))}</p>"])) if some(0.8) else ""
    return f"<html><body>{page}</body></html>"


@functools.lru_cache(1)
def classifier(pages: int = TEMPLATES, seed: int = 5) -> np.ndarray:
    """Weights of the block classifier, the constant last: logistic regression by Newton steps."""
    rnd, x, y = random.Random(seed), [], []
    for _ in range(pages):
        found = blocks(template(rnd))
        for (text, _), row in zip(found, describe([(t.replace("\1", "").replace("\2", "") or "x", b) for t, b in found]), strict=True):
            x.append([*row, 1.0])
            y.append("\1" in text)
    x, y = np.array(x), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    return w


def _apart(a: Place | None, b: Place | None, most: int = 200) -> int:
    """Steps between two elements over the innermost one around both; ``most`` if there are no fewer."""
    steps = 0
    while a is not b and steps < most:
        if b is None or a is not None and a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[tuple[str, Block]]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and the last block before under the same parent."""
    out, last = [], {}
    for k, (_, b) in enumerate(found):
        if k:
            away = _apart(found[k - 1][1].place, b.place)
            out.append((k - 1, k, ADJACENT / (1 + 0.5 * max(0, away - 2))))
        parent = b.place.parent if b.place else None
        if parent in last and last[parent] != k - 1:
            out.append((last[parent], k, SIBLING))
        last[parent] = k
    return out


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise sum(-gain of the chosen) + sum of weights of cut links; True: content."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    gain, label = list(gain), [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(gain[k]) >= sum(near[k].values()):
            label[k] = gain[k] > 0
            for j, w in near[k].items():
                del near[j][k]
                gain[j] += w if label[k] else -w
                if label[j] is None:
                    queue.append(j)
            near[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if not rest:
        return label
    # residual graph: -1 source (content), -2 sink (boilerplate)
    room = {k: dict(near[k]) for k in rest} | {-1: {}, -2: {}}
    for k in rest:
        if gain[k] > 0:
            room[-1][k], room[k][-1] = gain[k], 0.0
        else:
            room[k][-2], room[-2][k] = -gain[k], 0.0
    while True:
        back, todo = {-1: None}, deque([-1])
        while todo and -2 not in back:
            a = todo.popleft()
            for b, w in room[a].items():
                if w > 1e-12 and b not in back:
                    back[b] = a
                    todo.append(b)
        if -2 not in back:
            break
        path, b = [], -2
        while back[b] is not None:
            path.append((back[b], b))
            b = back[b]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow
    for k in rest:
        label[k] = k in back
    return label


def extract(pages: list[str | None], weights: np.ndarray) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) if p else [] for p in pages]
    rows = [r for f in found for r in describe(f)]
    gains = np.clip(np.array(rows) @ weights[:-1] + weights[-1], -8, 8).tolist() if rows else []
    out, at = [], 0
    for f in found:
        keep = minimum_cut(gains[at : at + len(f)], edges(f))
        at += len(f)
        out.append("\n".join(t for (t, _), k in zip(f, keep, strict=True) if k))
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(classifier())

    def run(batches):
        for batch in batches:
            text = []
            for lo in range(0, batch.num_rows, 200):
                text += extract(batch.column("html").slice(lo, 200).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
