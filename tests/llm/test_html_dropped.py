"""Dropped elements end where HTML says they end."""

import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from lingweave.llm import html_extract as H


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>a</p><svg-icon></svg-icon><p>b</p>", ["a", "b"]),
        ("<p>a</p><button-group><p>b</p></button-group><video-player></video-player><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><svg width='1'/><p>b</p><math/><p>c</p>", ["a", "b", "c"]),
        ("<html><head><title>t</title><meta charset=utf-8><style>s</style><p>a</p><p>b</p>", ["a", "b"]),
        ("<head><title>t</title></head><body><p>a</p><svg><text>x</text></svg><button>y</button><p>b</p>", ["a", "b"]),
        ("<p>a</p><object><p>b</p>", ["a", "b"]),
        ("<p>a</p><script>x <p>y</p>", ["a"]),
        ("<p>a</p><textarea>x <p>y</p>", ["a"]),
        ("<script>var a = '<body><p>x</p>';</script><p>a</p>", ["a"]),
        ("<p>a</p><svg><svg></svg><text>x</text></svg><p>b</p>", ["a", "b"]),
        ("<p title='a>b'>a</p><!--><p>b</p><p class=x'y>c</p>1 < 2", ["a", "b", "c", "1 < 2"]),
    ],
)
def test_dropped_elements(page, expected):
    assert [b[0] for b in H.blocks(page)] == expected


def test_headlines_and_compounds():
    long = "A sentence that is long enough to be part of an article, for it has many words in it."
    assert H.main_text(f"<body><div>Title</div><p>{long}</p><p>{long}</p></body>") == f"Title\n\n{long}\n\n{long}"
    assert H.main_text(f"<article><p>{long}</p><p class='notice-of-intent'>{long}</p><p class='ad-slot'>{long}</p></article>") == f"{long}\n\n{long}"


def test_long_and_broken_pages_take_little_time():
    rng = random.Random(1)
    page = "".join(f"<div{rng.choice(('', ' class=post-text', ' class=promo-of-day'))}>{'word ' * rng.randint(1, 30)}{rng.choice('.,')}</div>" for _ in range(20_000))
    for broken in (page, "<p '" * 20_000, "<p x='" * 20_000, "<object>" * 20_000, "<svg>" * 20_000, "<" * 50_000, "<!-" * 50_000, "<p>word</p>" * 20_000):
        began = time.process_time()
        H.main_text(broken)
        assert time.process_time() - began < 4


def test_large_cuts_equal_single_paths():
    """Against the plain algorithm: one shortest augmenting path at a time."""
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(10, 120)
        odds = [rng.gauss(0, 1) for _ in range(n)]
        links = [(i - 1, i, rng.random() * 2) for i in range(1, n)] + [(i - rng.randint(2, 8), i, rng.random()) for i in range(8, n, 3)]
        supply, demand, rest = [max(0.0, x) for x in odds], [max(0.0, -x) for x in odds], [{} for _ in odds]
        for i, j, c in links:
            rest[i][j] = rest[i].get(j, 0) + c
            rest[j][i] = rest[j].get(i, 0) + c
        while True:
            came = {i: -1 for i in range(n) if supply[i] > 1e-9}
            queue, end = [*came], -1
            for i in queue:
                if demand[i] > 1e-9:
                    end = i
                    break
                for j, c in rest[i].items():
                    if c > 1e-9 and j not in came:
                        came[j] = i
                        queue.append(j)
            if end < 0:
                break
            path, i = [], end
            while came[i] >= 0:
                path.append((came[i], i))
                i = came[i]
            push = min([supply[i], demand[end], *(rest[a][b] for a, b in path)])
            supply[i] -= push
            demand[end] -= push
            for a, b in path:
                rest[a][b] -= push
                rest[b][a] += push
        assert H.minimum_cut(odds, links) == [i in came for i in range(n)]


class Article(HTMLParser):
    """What the pages of the test data hold as article, by another parser: the texts of h1 and p within article."""

    def __init__(self):
        super().__init__()
        self.out, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("h1", "p"):
            self.out.append("")
        if tag == "br" and self.out:
            self.out[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and self.out:
            self.out[-1] += data


def test_pages_precision_and_recall(spark):
    right = kept = true = 0
    for r in H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        parser = Article()
        parser.feed(r.html or "")
        expected, got = Counter(w for x in parser.out for w in x.split()), Counter(r.text.split())
        right, kept, true = right + (expected & got).total(), kept + got.total(), true + expected.total()
    assert right >= 0.999 * kept and right >= 0.999 * true
