"""Main text of web pages by a minimum cut.

A page is cut into blocks at its block elements.  For each block a logistic classifier gives the odds that it is content; their logarithms are
the capacities of the block's edges to the terminals.  Smoothness edges join neighbours in page order and blocks under the same parent, heavier the closer they are
in the tree.  A maximum flow then separates content from boilerplate at the least total cost.

The classifier has fixed evidence for what elements say of themselves (navigation, footers, forms, advert or comment classes, articles) and weights for what the text looks
like (length, links, punctuation, kind of element).  The latter are learned on a bounded sample of pages, at most ``SAMPLE``, from blocks for which the fixed evidence is
clear.

Defined results: a null or empty page, and one without content, has an empty text; unclosed and misnested elements close as browsers would close them, or at the end;
repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches

#: Parameters: pages to learn from at most; cost of a cut between neighbours, and its decay for each step between them in the tree.
SAMPLE, SMOOTH, DECAY = 2_000, 2.0, 0.55

#: Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
RAW_TEXT = frozenset("script style textarea title".split())
DROPPED = frozenset("noscript template select iframe object svg math canvas audio video button".split())
CLOSED_BY_BLOCKS = frozenset(("p",))
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements, roles and words in class and id that tell boilerplate or content.
BOILERPLATE_TAGS = frozenset("nav footer aside form fieldset menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail footer foot header masthead topbar comment comments commentlist respond reply replies discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register form search share sharing social related recommended recommendations widget copyright legal disclaimer pager pagination skip toolbar tags".split()
)
CONTENT_WORDS = frozenset("article content entry post story main body text prose".split())
NEUTRAL_FOR_WORDS = frozenset("html body main article".split())

_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


_NAME, _GAP, _SPACE, _KEY, _PLAIN = (re.compile(p) for p in (r"[a-zA-Z][^\s/>]*", r"[\s/]*", r"\s*", r"=?[^\s/>=]*", r"[^\s>]*"))


class Tokens:
    """A page as a stream of text, start tags and end tags; a state machine that passes each character once.

    Comments and what a page hides as raw text are left out.  Of elements in ``DROPPED`` all goes up to the end tag that belongs to it, or the tag alone where none follows; script, style and
    textarea without end tag run to the end of the page, a title to the body.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.unclosed: set[str] = set()

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """The attributes from ``at`` on, the place after the tag's end, and whether the tag closes itself."""
        page, found, start = self.page, [], at
        while True:
            at = _GAP.match(page, at).end()
            if at >= len(page):  # a quote ran past the end: the tag ends at the next bracket after all
                return found, page.find(">", start) + 1, False
            if page[at] == ">":
                return found, at + 1, page[at - 1] == "/"
            m = _KEY.match(page, at)
            key, at = m[0].lower(), m.end()
            equals = _SPACE.match(page, at).end()
            if not page.startswith("=", equals):
                found.append((key, ""))
                continue
            at = _SPACE.match(page, equals + 1).end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and self.last[quote] > at:
                end = page.find(quote, at + 1)
                found.append((key, page[at + 1 : end]))
                at = end + 1
            else:
                m = _PLAIN.match(page, at)
                found.append((key, m[0]))
                at = m.end()

    def end_of(self, name: str, at: int) -> int:
        """Where an element in ``DROPPED`` ends, elements of its name within it counted; ``at`` itself if no end tag follows."""
        if name in self.unclosed:
            return at
        depth, end = 1, at
        for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(self.page, at):
            depth += -1 if m[1] else 1
            if m[1]:
                end = m.end()
            if not depth:
                return end
        if end == at:
            self.unclosed.add(name)
        return end

    def __iter__(self) -> Iterator[tuple[str, str, list]]:
        """``("text", text, [])``, ``("start", name, attributes)``, ``("end", name, [])``; ``("gap", name, [])`` for what is dropped."""
        page, at = self.page, 0
        while at < len(page):
            i = page.find("<", at)
            if i < 0 or self.last[">"] < i and not page.startswith("<!--", i):
                yield "text", page[at:], []
                return
            if i > at:
                yield "text", page[at:i], []
            closing = page.startswith("</", i)
            m = _NAME.match(page, i + 1 + closing)
            if not m:
                if page.startswith("<!--", i):
                    end = page.find("-->", i + 2)
                    at = end + 3 if end >= 0 else len(page)
                elif page.startswith("<![CDATA[", i):
                    end = page.find("]]>", i)
                    at = end + 3 if end >= 0 else len(page)
                elif closing or page[i + 1 : i + 2] in ("!", "?"):
                    at = page.find(">", i) + 1
                else:
                    yield "text", "<", []
                    at = i + 1
                continue
            name = m[0].lower()
            attributes, at, empty = self.attributes(m.end())
            if closing:
                yield "end", name, []
            elif name in RAW_TEXT:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at) or (re.compile(r"(?=<body[\s>])", re.I).search(page, at) if name == "title" else None)
                at = close.end() if close else len(page)
                yield "gap", name, []
            elif name in DROPPED:
                if not (empty and name in ("svg", "math")):
                    at = self.end_of(name, at)
                yield "gap", name, []
            else:
                yield "start", name, attributes


class Element:
    """An open element: its name, place, and evidence for (+) or against (-) content from it and those around it."""

    __slots__ = ("evidence", "inside", "name", "parent", "place")

    def __init__(self, name, parent, place, evidence, inside):
        self.name, self.parent, self.place, self.evidence, self.inside = name, parent, place, evidence, inside


def _word_evidence(words: list[str], own: float, inside: bool) -> float:
    """The evidence once a class or id of these words is known.  The outer words of a compound name the thing itself: site-footer, nav-item, comment-list."""
    if not words or words[-1] in ("content", "body", "text") and words[0] in ("main", "article", "post", "entry"):
        return 1.5 if words and own == 0 else own
    if words[-1] in BOILERPLATE_WORDS or words[0] in BOILERPLATE_WORDS and len(words) < 3:
        return own if inside and words[-1] in ("header", "head", "body", "tags", "text") else min(own, -5.0)
    if words[0] in BOILERPLATE_WORDS:  # of longer compounds the first word says less (notice-of-intent), and within an article nothing
        return own if inside else min(own, -2.0)
    return 1.5 if words[-1] in CONTENT_WORDS and own == 0 else own


def _evidence(name: str, attributes: list[tuple[str, str]], parent: Element) -> tuple[float, bool]:
    """The evidence of a new element, and whether it lies in an article: what lies in boilerplate stays boilerplate."""
    inside = parent.inside or name in CONTENT_TAGS
    own = 0.0
    if name in BOILERPLATE_TAGS or name == "header" and not parent.inside:
        own = -6.0
    elif name in CONTENT_TAGS:
        own = 4.0
    for kind, value in attributes:
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and _HIDDEN.search(value):
            own = -6.0
        elif kind == "role" and value.lower() in BOILERPLATE_ROLES:
            own = -6.0
        elif kind in ("class", "id") and name not in NEUTRAL_FOR_WORDS:
            for token in value.split():
                own = _word_evidence([w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token))], own, parent.inside)
    if parent.evidence <= -3:
        return min(parent.evidence, own), inside
    return (own if own else parent.evidence), inside


def blocks(page: str) -> list[tuple]:
    """The blocks of a page in order: ``(text, words, linked words, kind, element)``."""
    root = Element("", None, 0, 0.0, False)
    out: list[tuple] = []
    current, link, parts, linked, made = root, False, [], [], 0

    def flush():
        if parts:
            raw = "".join(parts)
            parts.clear()
            words = (html.unescape(raw) if "&" in raw else raw).split()
            if words:
                n = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append((" ".join(words), len(words), min(n, len(words)), current.name, current))
            linked.clear()

    def close(name: str, scope) -> None:
        nonlocal current
        e = current
        while e is not root and e.name != name:
            if e.name in scope:
                return
            e = e.parent
        if e is not root:
            flush()
            current = e.parent

    for kind, name, attributes in Tokens(page):
        if kind == "text":
            parts.append(name)
            if link:
                linked.append(name)
        elif kind == "gap":
            parts.append(" ")
        elif name in BLOCKS:
            closing = kind == "end"
            flush()
            link = link and not closing and name != "li"
            if closing:
                close(name, ())
            else:
                if name not in ("html", "body") or current is root:
                    close("p", ("td", "th", "table", "button", "body"))
                for other in CLOSED_BY_SAME.get(name, ()):
                    close(other, SCOPES[name] - {other})
                made += 1
                evidence, inside = _evidence(name, attributes, current)
                if name not in VOID:
                    current = Element(name, current, made, evidence, inside)
        elif name == "a":
            link = kind == "start"
        elif name in ("br", "img", "input"):
            parts.append(" ")
            if link:
                linked.append(" ")
    flush()
    return out


#: Weights learned from text alone, used where a sample teaches nothing: intercept, log words, share of linked words, ends like a sentence, heading, list item, paragraph, leads a longer text.
DEFAULT_WEIGHTS = (-1.2, 0.7, -4.0, 0.8, 0.6, -0.8, 0.8, 1.2)


def text_features(found: list[tuple]) -> Iterator[tuple[float, ...]]:
    """For each block what its text and the block after it look like."""
    for (text, words, linked, kind, _), after in zip(found, [*found[1:], None], strict=False):
        leads = words <= 12 and not linked and text[-1] not in ".!?" and after is not None and after[1] > max(words, 5) and not after[2]
        yield (1.0, min(words, 60) ** 0.5 / 3, linked / words, float(text[-1] in ".!?…:;\"'”»)"), float(kind[:1] == "h" and kind[1:].isdigit()), float(kind in ("li", "option", "td", "th", "dt", "dd")), float(kind in ("p", "blockquote", "pre")), float(leads))


def costs(found: list[tuple], weights) -> list[float]:
    """For each block the logarithm of the odds that it is content."""
    return [max(-12.0, min(12.0, b[4].evidence + sum(w * v for w, v in zip(weights, x, strict=True)))) for b, x in zip(found, text_features(found), strict=True)]


def _steps(a: Element, b: Element) -> int:
    """Steps between two elements in the tree, at most 8."""
    above, n = {}, 0
    while a is not None and n < 9:
        above[a.place] = n
        a, n = a.parent, n + 1
    n = 0
    while b is not None and n < 9:
        if b.place in above:
            return min(8, n + above[b.place])
        b, n = b.parent, n + 1
    return 8


def edges(found: list[tuple]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and each block with the one before it under the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        e = b[4]
        if i:
            out.append((i - 1, i, SMOOTH * DECAY ** _steps(found[i - 1][4], e)))
        parent = (e.parent or e).place
        before = last.get(parent)
        if before is not None and before < i - 1:
            out.append((before, i, SMOOTH * DECAY ** (2 + (i - before) ** 0.5)))
        last[parent] = i
    return out


def minimum_cut(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut: a positive entry of ``odds`` is capacity from the source, a negative one to the sink.

    A node whose capacity exceeds all its edges is on its own side in every minimum cut; its edges then add to its neighbours' capacities, which may settle those too.  What is left falls into
    stretches between settled nodes, and a maximum flow through each settles them.
    """
    n, eps = len(odds), 1e-9
    odds, edges_of = list(odds), [{} for _ in range(n)]
    for i, j, c in links:
        edges_of[i][j] = edges_of[i].get(j, 0.0) + c
        edges_of[j][i] = edges_of[j].get(i, 0.0) + c
    held, side, todo = [sum(e.values()) for e in edges_of], [None] * n, [*range(n)]
    while todo:
        i = todo.pop()
        if side[i] is None and abs(odds[i]) > held[i] + eps:
            side[i] = odds[i] > 0
            for j, c in edges_of[i].items():
                if side[j] is None:
                    odds[j] += c if side[i] else -c
                    held[j] -= c
                    todo.append(j)
    for start in range(n):
        if side[start] is not None:
            continue
        stretch, side[start] = [start], False
        for i in stretch:
            for j, c in edges_of[i].items():
                if side[j] is None and c > eps:
                    side[j] = False
                    stretch.append(j)
        for i in _source_side(stretch, odds, edges_of):
            side[i] = True
    return side


def _source_side(nodes: list[int], odds: list[float], edges_of: list[dict[int, float]]) -> list[int]:
    """The nodes on the source's side of the minimum cut of connected ``nodes``, by blocking flows along shortest paths."""
    eps, inside = 1e-9, set(nodes)
    gives = {i: max(0.0, odds[i]) for i in nodes}
    takes = {i: max(0.0, -odds[i]) for i in nodes}
    rest = {i: {j: c for j, c in edges_of[i].items() if j in inside} for i in nodes}
    if max(gives.values()) <= eps:
        return []
    if max(takes.values()) <= eps:
        return nodes
    while True:
        level = {i: 0 for i in nodes if gives[i] > eps}
        queue, met = [*level], False
        for i in queue:
            met = met or takes[i] > eps
            for j, c in rest[i].items():
                if c > eps and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not met:
            return queue
        arcs = {i: iter([*rest[i]]) for i in queue}
        for start in [i for i in queue if level[i] == 0]:
            path = [start]
            while path and gives[start] > eps:
                i = path[-1]
                if takes[i] > eps:
                    push = min([gives[start], takes[i], *(rest[a][b] for a, b in zip(path, path[1:], strict=False))])
                    gives[start] -= push
                    takes[i] -= push
                    for a, b in zip(path, path[1:], strict=False):
                        rest[a][b] -= push
                        rest[b][a] += push
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if rest[a][b] <= eps), None)
                    if full is not None:
                        del path[full + 1 :]
                    continue
                j = next((j for j in arcs[i] if rest[i][j] > eps and level[j] == level[i] + 1), None)
                if j is None:
                    path.pop()
                else:
                    path.append(j)


def main_text(page: str | None, weights=DEFAULT_WEIGHTS) -> str:
    """The content blocks of a page, joined by empty lines."""
    found = blocks(page) if page else []
    if not found:
        return ""
    odds = costs(found, weights)
    if min(odds) >= 0 or max(odds) < 0:
        kept = [x >= 0 for x in odds]
    else:
        kept = minimum_cut(odds, edges(found))
    return "\n\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def learn_weights(rows: list[tuple[tuple[float, ...], int]]) -> tuple[float, ...]:
    """Logistic regression by Newton steps towards ``DEFAULT_WEIGHTS``; those alone if the rows have one label only."""
    import numpy as np

    if len({y for _, y in rows}) < 2:
        return DEFAULT_WEIGHTS
    x, y, prior = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array(DEFAULT_WEIGHTS)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, pull = prior.copy(), 0.02 * len(y)
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull * (w - prior)
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + pull * np.eye(len(w)), gradient)
    return tuple(w.tolist())


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> tuple[float, ...]:
    """Weights from blocks of a bounded sample of pages (the least hashes of the page) for which the elements' own evidence is clear."""
    column = F.col(quoted(html_col))
    some = pages.where(column.isNotNull()).select(F.xxhash64(column).alias("place")).distinct().orderBy("place").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict = {}
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                for b, x in zip(found, text_features(found), strict=True):
                    if abs(b[4].evidence) >= 3:
                        key = tuple(round(v, 1) for v in x), int(b[4].evidence > 0)
                        totals[key] = totals.get(key, 0) + 1
            yield pa.RecordBatch.from_pydict({"x": pa.array([list(k[0]) for k in totals], pa.list_(pa.float64())), "y": pa.array([k[1] for k in totals], pa.int32()), "n": pa.array(list(totals.values()), pa.int64())})

    # The sample is bounded, so its hashes may be broadcast; its pages stay on the executors.
    texts = pages.select(column.alias("page"), F.xxhash64(column).alias("place")).join(F.broadcast(some), "place", "left_semi").select("page")
    rows = texts.mapInArrow(run, "x array<double>, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).orderBy("y", "x").collect()
    return learn_weights([(tuple(r["x"]), r["y"]) for r in rows for _ in range(min(r["n"], 50))])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """``page_id, url, text`` of each row; learns the weights on a sample of the rows unless given."""
    small_batches(pages.sparkSession)
    learned = fit(pages, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p, learned) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    shown = pages.select(F.col(quoted(id_col)).alias("page_id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(html_col)).alias("html"))
    schema = shown.select("page_id", "url").schema.add("text", "string")
    return shown.mapInArrow(run, schema)
