"""Main text of pages that the tree was not grown from, and what its features are for."""

import html
import time

import numpy as np
import pandas as pd
import pytest

from nearfield.llm import html_text

TREE = html_text.grow(*html_text.labelled_rows())
#: A page and its main text, blocks parted by bars.
HELD_OUT = [
    (
        "<body><nav><a href=/>Home</a><a href=/b>Blog</a></nav><div class='wrapper no-sidebar'><h1>Kites</h1><p>A kite needs wind and a tail, and the longer the tail is the steadier the kite will fly in it.</p><p>Run.</p><p>Let out the line when it rises, and pull it in when it falls, until it hangs in the wind.</p></div><footer>All rights reserved</footer>",
        'Kites|A kite needs wind and a tail, and the longer the tail is the steadier the kite will fly in it.|Run.|Let out the line when it rises, and pull it in when it falls, until it hangs in the wind.',
    ),
    (
        '<head><title>x</title><p>The text of a page whose head was never closed is as good as any other text on the web.</p><p>So read it.</p>',
        'The text of a page whose head was never closed is as good as any other text on the web.|So read it.',
    ),
    (
        "<div class='sidebar-layout'><ul><li><a href=/1>Go</a></li><li><a href=/2>Come</a></li></ul><p>Menu</p><p><a href=/3>Stay</a></p><p>When the tide is out you can walk to the island in an hour, but you must be back before it turns.</p><p>Do not run.</p><p>The sand is soft near the channel, and a guide will show you where it holds and where it does not.</p><p><a href=/4>Guides</a></p><p>Prices</p><p><a href=/5>Dates</a></p></div>",
        'When the tide is out you can walk to the island in an hour, but you must be back before it turns.|Do not run.|The sand is soft near the channel, and a guide will show you where it holds and where it does not.',
    ),
    (
        "<div class='form-content'><h1>Tax</h1><p>Whoever has a dog pays for it by the end of March, at the desk on the ground floor of the town hall.</p></div>",
        'Tax|Whoever has a dog pays for it by the end of March, at the desk on the ground floor of the town hall.',
    ),
    (
        "<div class='social-history'><p>Weavers were paid by the piece, and a piece took as long as the light of three winter days would last.</p><p>No more.</p></div>",
        'Weavers were paid by the piece, and a piece took as long as the light of three winter days would last.|No more.',
    ),
    (
        '<body><article><h1>T</h1><p><a href=/x>Links only</a></p><p>Word.</p></article><div class=comments><article><p>I do not agree with a word of this and I never will, whatever is said.</p></article></div>',
        'T|Links only|Word.',
    ),
    (
        '<form id=aspnet><div><a href=/>Home</a></div><p>A page that lies in a form as a whole is still a page, and its text is what a reader wants from it.</p></form>',
        'A page that lies in a form as a whole is still a page, and its text is what a reader wants from it.',
    ),
    (
        '<div>Only a few words here</div>',
        'Only a few words here',
    ),
    (
        '<h1>Hello</h1>',
        'Hello',
    ),
    (
        'plain text',
        'plain text',
    ),
    (
        '<p>One short.</p><p>Two.</p>',
        'One short.|Two.',
    ),
]


@pytest.mark.parametrize("page,want", HELD_OUT, ids=range(len(HELD_OUT)))
def test_held_out_pages(page, want):
    assert html_text.main_text(page, TREE).replace("\n", "|") == want


def _used(tree):
    return set() if len(tree) == 1 else {html_text.NAMES[tree[0]]} | _used(tree[2]) | _used(tree[3])


def test_the_tree_uses_counts_and_neighbours():
    assert {"words", "link_density", "words_before", "link_density_before", "link_density_after"} <= _used(TREE)


@pytest.mark.parametrize("names", [["words"], ["words_before", "link_density_before", "words_after", "link_density_after"]])
def test_without_counts_or_neighbours_results_change(names):
    x, y = html_text.labelled_rows()
    blind = x.copy()
    blind[:, [html_text.NAMES.index(n) for n in names]] = 0
    tree = html_text.grow(blind, y)
    wrong = lambda t, rows: sum(html_text.says(t, r) != bool(v) for r, v in zip(rows, y))
    assert wrong(TREE, x) < wrong(tree, blind)


def test_a_wrapper_is_no_sidebar_whatever_its_name():
    body = "<h1>Head</h1><p>Some words that go on for long enough to be a sentence of their own here.</p><p>End.</p>"
    want = html_text.main_text(f"<div>{body}</div>", TREE)
    for name in ("page no-sidebar", "sidebar-layout", "social-history", "form-content", "menu-open", "has-comments"):
        assert html_text.main_text(f'<body><nav><a href="/">x</a></nav><div class="{name}">{body}</div></body>', TREE) == want


def test_long_and_odd_pages_take_linear_time():
    long = "<article>" + "<p>A line of text.</p>" * 100_000 + "</article>"
    assert html_text.main_text(long, TREE).count("\n") == 99_999
    for odd in ("<svg>" * 100_000, "<" * 300_000, "<p class='" * 50_000, "<div>" * 20_000 + "x"):
        html_text.main_text(odd, TREE)
    assert html_text.main_text("<title>never closed<p>The text is read all the same, as it would be without the title.</p>", TREE)


def test_features_of_no_blocks():
    assert html_text.features([], []).shape == (0, len(html_text.NAMES)) and np.isfinite(html_text.labelled_rows()[0]).all()


JUDGED = [f'<article><h1>Head</h1><section id="{name}"><p>A sentence of some seventeen words stands here, and it goes on until it has all of them now.</p><p>Short.</p></section></article>' for name in ("side-effects", "legal-history", "form-section", "top-side-section", "rail-section", "bottom-section")]
JUDGED += ['<main><section class="social-science-dept"><h1>Dept</h1><p>We teach and we learn in the old house near the river since the war.</p></section></main>', '<article><p class="lead-promo">In short, the town has decided to keep its old bridge after all, said the mayor.</p><p>More.</p></article>']


@pytest.mark.parametrize("page", JUDGED)
def test_sections_of_an_article_stay_whatever_they_are_called(page):
    assert html_text.main_text(page, TREE).split("\n") == [b.text for b in html_text.blocks(page)[0]]


@pytest.mark.parametrize("name,want", [("side-effects", 0), ("legal-history", 0), ("form-section", 1), ("form", 2), ("comments-area", 2), ("cookieNotice", 2), ("content", 0), ("ad-300", 2)])
def test_strength_of_names(name, want):
    assert html_text.strength(name) == want


@pytest.mark.parametrize("page", ["<div class=ad>x" * 130_000, "<div>…</p>" * 180_000, "<article><nav>" * 140_000 + "x", "</div>" * 300_000, "<div class='ad share'><p>x</div>" * 60_000], ids=range(5))
def test_pages_of_two_megabytes_with_open_containers(page):
    began = time.perf_counter()
    html_text.main_text(page, TREE)
    assert time.perf_counter() - began < 5  # about one second; the square of the containers took an hour


def _plain_blocks(page):
    """The same blocks by plain scans: every block lists the containers around it, and every end tag looks for its start."""
    h, out, stack, every, parts = html_text, [], [], [], []
    state = {"link": 0, "link_words": 0, "heading": 0, "marked": 0}
    suspect = lambda c: c.chrome or c.named

    def close():
        text = " ".join(html.unescape("".join(parts)).split())
        if parts and text:
            out.append((text, state["link_words"], [c for c in stack if suspect(c)], sum(c.article for c in stack), state["heading"]))
        if parts:
            state["link_words"] = 0
        parts.clear()

    def mark(weight):
        if state["marked"] < weight:
            for c in every:
                c.wraps = any(c is o for o in stack)
            state["marked"] = weight

    def pop():
        if suspect(stack[-1]) or stack[-1].article:
            close()
        return stack.pop()

    silent = ""
    for m in h._TOKEN.finditer(page):
        name = m[2] or m[5]
        if name is None:
            if not silent and not (m[0].startswith("<") and len(m[0]) > 1):
                parts.append(m[0])
                state["link_words"] += len(m[0].split()) if state["link"] else 0
            continue
        tag, ends, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if silent:
            silent = "" if ends and tag == silent else silent
        elif tag in h.SILENT_TAGS:
            close()
            if not ends and not attrs.endswith("/") and (tag in ("script", "style") or f"</{tag}" in page[m.start() + 1 :].lower()):
                silent = tag
        elif tag == "a":
            state["link"] = int(not ends)
        elif tag == "br":
            parts.append(" ")
        else:
            if tag in h.BLOCK_TAGS:
                close()
                state["heading"] = int(tag[0] == "h" and tag[1:].isdigit() and not ends)
                state["link"] = state["link"] if tag == "p" else 0
                if tag == "h1" and not ends:
                    mark(1)
            if tag in h.TRACKED and tag not in h.VOID_TAGS:
                if not ends:
                    if tag == "p" and stack and stack[-1].tag == "p":
                        pop()
                    c = h._opened(tag, attrs, any(c.article for c in stack))
                    if suspect(c) or c.article:
                        close()
                    if suspect(c):
                        every.append(c)
                    if c.article and not any(o.chrome and o.tag != "form" for o in [*stack, c]):
                        stack.append(c)
                        mark(2)
                        stack.pop()
                    stack.append(c)
                elif any(c.tag == tag for c in stack):
                    while pop().tag != tag:
                        pass
    close()
    if not state["marked"]:
        total = sum(len(t.split()) for t, *_ in out)
        for c in every:
            c.wraps = 2 * sum(len(t.split()) for t, _, within, *_ in out if any(c is o for o in within)) > total
    return out


def _plain_text(page, tree):
    found = _plain_blocks(page)
    rows = []
    held = lambda within, of: max([0] + [int(of(c)) for c in within if not c.wraps])
    has = any(a and not held(w, lambda c: c.chrome) and held(w, lambda c: c.named) < 2 for _, _, w, a, _ in found)
    counts = [(min(len(t.split()), html_text.ENOUGH), min(1.0, n / len(t.split()))) for t, n, *_ in found]
    for k, (_, _, w, a, heading) in enumerate(found):
        near = [counts[j] if 0 <= j < len(counts) else (0, 0.0) for j in (k, k - 1, k + 1)]
        rows.append([*near[0], *near[1], *near[2], heading, min(a, 1), has and not a, held(w, lambda c: c.chrome), held(w, lambda c: c.named)])
    return "\n".join(t for (t, *_), row in zip(found, rows) if html_text.says(tree, row))


def test_like_plain_scans(sf_dir):
    pages = [h or "" for h in pd.read_parquet(f"{sf_dir}/pages.parquet")["html"]] + [p for p, _ in HELD_OUT] + JUDGED + html_text.LABELLED
    pages += ["<div class=ad>x<p>y</div>z</p>" * 30, "<article><nav>a</article>b<main>c</nav>d", "<p>a<p>b<h1>c</p>d</h1><aside>e<h1>f"]
    for page in pages:
        assert html_text.main_text(page, TREE) == _plain_text(page, TREE), page[:200]
