"""HTML extraction: windows against brute force, and pages on which they decide."""

import random
import time

import pytest

from silvaframe.llm import html_text

LONG = "This paragraph is long enough for its window to reach the bar of a surge, whatever stands around it on the page."
MENU = "<div>Home</div><div>News</div><div>Shop</div>"
PLAIN = f"<body>{MENU}<section><div><div><div><div></div></div></div></div></section><h1>Title here</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><section><div><div><div><div></div></div></div></div></section><div>Imprint</div></body>"


def brute(weight, bar):
    """Lines that lie in a stretch, by looking at every pair of a surge line and a line below it."""
    n, w = len(weight), html_text.WINDOW
    window = [sum(weight[i : i + w]) for i in range(n)]
    kept = set()
    for s in (i for i in range(n) if weight[i] and window[i] >= bar):
        for e in range(s, n):
            if all(window[k] > 0 for k in range(s, e + 1)) and any(weight[k] for k in range(e, n) if all(window[q] for q in range(s, k + 1))):
                kept.add(e)
        k = s
        while k and weight[k - 1]:
            k -= 1
        kept |= set(range(k, s))
    return kept


def test_stretches_equal_brute_force():
    rng = random.Random(3)
    for _ in range(2000):
        weight = [rng.choice([0, 0, rng.randint(1, 30), rng.randint(1, 200)]) for _ in range(rng.randint(0, 25))]
        bar = min(html_text.SURGE, max(html_text.windows(weight), default=0) / 2) if rng.random() < 0.5 else 60
        if not any(weight):
            continue
        got = {k for a, b in html_text.stretches(weight, bar) for k in range(a, b)}
        assert got == {k for k in brute(weight, bar)}, (weight, bar)


def test_windows_decide(monkeypatch):
    assert html_text.main_text(PLAIN) == f"Title here\n{LONG}\nShort.\n{LONG}"
    monkeypatch.setattr(html_text, "windows", lambda weight: [1000] * len(weight))  # every line surges, none dives
    assert html_text.main_text(PLAIN).startswith("Home\nNews")


def test_marked_lines_outweigh_the_rest():
    page = f"<body><div>{LONG}</div><div>{LONG}</div><main><p>Tiny.</p></main><div>{LONG}</div></body>"
    assert html_text.main_text(page) == "Tiny."
    # a part of the article below an advert stays, however short, and so do lines of links inside
    page = f"<article><p>{LONG}</p><div class='ad'>Buy!</div><p><a href='x'>All of this is a link</a></p><p>End.</p></article><footer>x</footer>"
    assert html_text.main_text(page) == f"{LONG}\nAll of this is a link\nEnd."


def test_links_at_the_edges_go_and_stay_inside():
    link = "<p><a href='a'>one link after another</a></p>"
    page = f"<body>{link * 3}<p>{LONG}</p>{link}<p>{LONG}</p>{link * 3}</body>"
    assert html_text.main_text(page) == f"{LONG}\none link after another\n{LONG}"


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000, "<article>" * 50_000 + "</b>" * 100_000, "<p><b>x</i>" * 50_000, "<ul><li>" * 50_000])
def test_stray_tags_take_linear_time(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 5
