"""HTML main-text extraction: flat text blocks, classified by a decision tree.

A page is read once into flat blocks: stretches of text between block-level tags. A block's features are its own word
count and link density, those of the blocks before and after it, and where it stands: within an article, beside one,
within a tag or a named container that usually holds no main text. A name counts only if it has no word beside those of such
containers and of layout, and as a weak one if it may name a part of an article too. A decision tree, grown on the driver from the small
labelled pages below, says which blocks are main text. Counts are asked first where they split as well as places do; on
pages without an article, or with misleading names, they decide.

A container that holds the beginning of the page's first article (or, on a page without one, its first heading of the first
level, or else most of its words) is a wrapper, whatever it is called.

Defined cases: null html is the empty page; an unclosed comment, script or style runs to the end of the page, any other tag
that is never closed hides nothing; repeated rows give equal texts; a very long page is read whole, in time linear in its
length; an empty table gives an empty result; further columns are ignored. Ties between splits go to the first feature.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches, table

#: Tags that end a block, tags whose content is no text, and containers that hold no main text.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea title".split())
AWAY_TAGS = frozenset("nav footer aside form menu button select dialog fieldset search".split())
TRACKED = frozenset("article aside button details dialog div fieldset footer form header main menu nav ol section select span table td tr ul li p blockquote figure".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in a class, id or role that name what is no main text.
AWAY_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side rail aside nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot bottom cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser comment comments commentlist respond reply replies discussion disqus form search pagination pager widget toolbar copyright legal disclaimer contentinfo complementary dialog tags".split())

#: Those of them that may as well name a part of an article.
VAGUE_NAMES = frozenset("alert bottom dialog discussion foot form header legal notice notices rail respond side tags".split())
#: Words that say how a page is laid out and not what it holds; a name of them and of VAGUE_NAMES is a weak one.
LAYOUT_NAMES = frozenset("area bar bars block blocks body bottom box boxes btn button buttons card cards center col column columns container content contents cta desktop div element entry fixed footer full grid group header holder icon icons id inline inner input item items js label layout left link links list lists main message middle mobile module outer page pane panel placeholder post posts primary region right row rows secondary section sections slot small stories story text title top unit ui view wide wrap wrapper zone".split())
_NEITHER = re.compile(r"^[0-9]*$")

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    """A stretch of text, its words and those in links, the innermost open container that may hold no main text (or -1), the
    articles it is in, and whether it is a heading."""

    text: str
    words: int
    link_words: int
    within: int
    article: int
    heading: int


class Container:
    """An open tag: whether it may hold no main text by its tag or by its name (1: weakly, 2), the container around it that
    may, the words it holds, and if it is an article."""

    __slots__ = ("tag", "chrome", "named", "article", "words", "wraps", "parent")

    def __init__(self, tag: str, chrome: bool, named: int, article: bool):
        self.tag, self.chrome, self.named, self.article, self.words, self.wraps, self.parent = tag, chrome, named, article, 0, False, -1


def strength(name: str, in_article: bool = False) -> int:
    """How much a class, id or role says that a container holds no main text.

    0: it has no word of AWAY_NAMES, or one that is neither of them nor of layout (``side-effects``, ``legal-history``);
    1: its words are of VAGUE_NAMES and of layout (``form-section``); 2: any other.
    """
    words = [w.lower() for w in _SPLIT_NAME.split(name) if not _NEITHER.match(w)]
    away = [w for w in words if w in AWAY_NAMES and not (in_article and w == "header")]
    if not away or not all(w in AWAY_NAMES or w in LAYOUT_NAMES for w in words):
        return 0
    return 1 if len(away) < len(words) and VAGUE_NAMES.issuperset(away) else 2


@lru_cache(1 << 14)
def _described(attrs: str, in_article: bool) -> tuple[int, bool]:
    """What the attributes of a tag say: how much its names are against it, and whether it is hidden."""
    named = 0
    if "=" in attrs:
        for m in _NAMED.finditer(attrs):
            named = max([named, *(strength(n, in_article) for n in (m[1] or m[2] or m[3] or "").split())])
    return named, ("hidden" in attrs or "display" in attrs) and _HIDDEN.search(attrs) is not None


def _opened(tag: str, attrs: str, in_article: bool) -> Container:
    """A container as its tag and its class, id and role name it; the head of an article is part of it."""
    named, hidden = _described(attrs, in_article) if len(attrs) < 256 else _described.__wrapped__(attrs, in_article)
    chrome = hidden or tag in AWAY_TAGS or (tag == "header" and not in_article)
    return Container(tag, chrome, named, tag in ("article", "main") and not named)


def blocks(page: str | None) -> tuple[list[Block], list[Container]]:
    """The flat text blocks of a page, in order, and the containers they name; one pass over its tags."""
    page = page or ""
    out: list[Block] = []
    stack: list[Container] = []
    suspects: list[Container] = []  # containers that may hold no main text
    within: list[int] = []  # those that are open
    opened: dict[str, int] = {}  # open containers by tag
    chromes = 0  # open ones that hold no main text by their tag, but for forms
    parts: list[str] = []
    article = link = heading = link_words = 0
    marked = 0  # 2: the first article was met; 1: only a heading of the first level
    silent = ""
    last_end: dict[str, int] = {}

    def close() -> None:
        nonlocal parts, link_words
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                n = text.count(" ") + 1
                out.append(Block(text, n, link_words, within[-1] if within else -1, article, heading))
                if within:
                    suspects[within[-1]].words += n
            parts, link_words = [], 0

    def mark(weight: int) -> None:
        nonlocal marked
        if marked < weight:
            for c in suspects:
                c.wraps = False
            for k in within:
                suspects[k].wraps = True
            marked = weight

    def pop() -> Container:
        nonlocal article, chromes
        c = stack.pop()
        opened[c.tag] -= 1
        if c.chrome or c.named:
            close()
            within.pop()
            chromes -= c.chrome and c.tag != "form"
        if c.article:
            close()
            article -= 1
        return c

    for m in _TOKEN.finditer(page):
        token = m[0]
        name = m[2] or m[5]
        if name is None:
            if not silent and not (token.startswith("<") and len(token) > 1):
                parts.append(token)
                if link:
                    link_words += len(token.split())
            continue
        tag, ends, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if silent:  # nothing counts until its end
            if ends and tag == silent:
                silent = ""
            continue
        if tag in SILENT_TAGS:
            close()
            if not ends and not attrs.endswith("/"):
                if tag not in last_end:
                    last_end[tag] = max((x.start() for x in re.finditer(f"</{tag}", page, re.I)), default=-1)
                if tag in ("script", "style") or last_end[tag] > m.start():
                    silent = tag
            continue
        if tag == "a":
            link = 0 if ends else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
            heading = int(tag[0] == "h" and tag[1:].isdigit() and not ends)
            if tag != "p":
                link = 0
            if tag == "h1" and not ends:
                mark(1)
        if tag in TRACKED and tag not in VOID_TAGS:
            if not ends:
                if tag == "p" and stack and stack[-1].tag == "p":
                    pop()
                c = _opened(tag, attrs, article > 0)
                if c.chrome or c.named:
                    close()
                    c.parent = within[-1] if within else -1
                    within.append(len(suspects))
                    suspects.append(c)
                    chromes += c.chrome and c.tag != "form"
                if c.article:
                    close()
                    article += 1
                    if not chromes:
                        mark(2)
                stack.append(c)
                opened[tag] = opened.get(tag, 0) + 1
            elif opened.get(tag):
                while pop().tag != tag:
                    pass
    close()
    total = sum(b.words for b in out)
    for c in reversed(suspects):  # a container comes after the one around it
        if c.parent >= 0:
            suspects[c.parent].words += c.words
    if not marked:
        for c in suspects:
            c.wraps = 2 * c.words > total
    return out, suspects


#: Words beyond which a block counts as long, however long it is; fewest labelled blocks of a leaf.
ENOUGH, LEAF = 12, 3
NAMES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "article", "beside", "chrome", "named"]


def features(found: list[Block], suspects: list[Container]) -> np.ndarray:
    """One row of NAMES for each block; ``beside``: the page has its article elsewhere."""
    if not found:
        return np.zeros((0, len(NAMES)))
    words = np.array([min(b.words, ENOUGH) for b in found], float)
    density = np.array([min(1.0, b.link_words / b.words) for b in found])
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    chrome, named = [0], [0]  # of no container, then of each one and those around it
    for c in suspects:
        chrome.append(max(chrome[c.parent + 1], int(c.chrome and not c.wraps)))
        named.append(max(named[c.parent + 1], 0 if c.wraps else c.named))
    has_article = any(b.article and not chrome[b.within + 1] and named[b.within + 1] < 2 for b in found)
    rest = np.array([[b.heading, min(b.article, 1), has_article and not b.article, chrome[b.within + 1], named[b.within + 1]] for b in found], float)
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), rest])


# ---------------------------------------------------------------- the decision tree
def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> tuple:
    """A tree by Gini impurity: (feature, threshold, left, right), or (share of ones,) at a leaf. Ties: the first feature."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for k in range(x.shape[1]):  # counts before places, if they split equally well
        cuts = np.unique(x[:, k])
        for t in (cuts[1:] + cuts[:-1]) / 2:
            left = x[:, k] <= t
            if not LEAF <= left.sum() <= len(y) - LEAF:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, t)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return (share,)
    left = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def says(tree: tuple, row: np.ndarray) -> bool:
    """Whether the tree takes a block for main text."""
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] > 0.5


#: The labelled pages. A block whose text starts with + is main text; the sign is no part of it.
LABELLED = [
    """<html><head><title>Tea</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="ad">Buy the best tea in town at half the price today only.</div>
    <article><h1>+History of tea</h1><p>+Tea was first grown in the hills of the south, where leaves were dried in the sun and kept for winter.</p><p>+It spread.</p><p>+Traders carried it over land and sea, and by the end of the century it was drunk in every port.</p></article><footer>Copyright 2020 Tea House. <a href="/c">Contact</a></footer></body></html>""",
    """<body><header>The Daily Page <a href="/login">Log in</a></header><main><h2>+Weather</h2><p>+Rain.</p><p>+Wind from the west will bring rain to the coast by noon, and snow to the hills by night.</p><aside>Read more: <a href="/x">Storm of the year</a> and other long stories of wind and rain</aside><ul><li>+Take a coat.</li><li>+Keep off the pier.</li></ul></main>
    <div id="comments"><p>I think that it never rains here, whatever you all say about the coast.</p><p>Agreed!</p></div><form>Your name Your mail <button>Send</button></form></body>""",
    """<body><div class="menu"><a href="/a">Start</a> <a href="/b">Shop</a> <a href="/c">Help</a></div><div class="cookie-notice">We use cookies to make this site work and to measure how it is used. <a href="/ok">Accept</a></div>
    <div class="content"><h1>+Bread</h1><p>+Mix flour and water and leave the dough to rest for an hour in a warm place.</p><p>+Bake it.</p><p>+Let it cool on a rack, then cut it; a <a href="/k">good knife</a> helps.</p></div><div class="sidebar"><h3>Popular</h3><p>Ten cakes that you can bake in less than an hour with what you have at home.</p></div></body>""",
    """<body><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a><hr><p>+The bridge was built by hand over nine years, and it has stood for three hundred more without a crack.</p><p>+It is still in use, by carts and cars and by all who live on either side of the river.</p><hr><a href="/4">Back</a> | <a href="/5">Next</a></body>""",
    """<body><div><a href="/">Home</a></div><table><tr><td>+The museum opens at nine every day but on Monday, and entry is free for all children under twelve.</td></tr></table><p>+Groups should call ahead so that a guide can show them the older rooms on the upper floor.</p><div><a href="/m">Map</a> <a href="/t">Tickets</a></div></body>""",
    """<body><nav>Menu</nav><article><p>+Yes.</p><p>+No.</p><p>+The vote went on until late, and no one in the hall could say which side would win in the end.</p><div class="share"><a href="/f">Share</a></div><p>+It was close.</p><section class="comments"><p>What a night that was, I will never forget how we all waited for the count.</p></section></article><footer>All rights reserved</footer></body>""",
    """<body><div class="banner">Sale! Everything must go by Friday, come and see our shop in the old town.</div><article><blockquote>+All is well that ends well.</blockquote><p>+<a href="/s">Shakespeare</a></p><p>+So the saying goes, and so it has gone for more than four hundred years in many tongues.</p></article><div role="contentinfo">Imprint and privacy</div></body>""",
    """<body><article><h1>+Short</h1><p>+One.</p></article><div class="related"><p>Another story that you may like to read about the town and its people</p></div></body>""",
    """<body><div>The site will be closed for repairs on Sunday night from ten until two in the morning.</div><article><h2>+Owls</h2><p>+They hunt.</p><p>+An owl can turn its head almost all the way round, for its eyes cannot move.</p></article><p>Join us on our next walk in the woods, which starts at dawn by the mill.</p></body>""",
    """<body><p>+Moss grows on the north side of stones where the sun does not reach it in summer.</p><p>+It needs rain.</p></body>""",
    """<body><p>+Rust.</p><p>+Iron left out in the rain turns red within a few days unless it is oiled.</p><div><a href="/q">More</a></div></body>""",
    """<div class="page no-sidebar"><div class="topnav"><a href="/a">News</a> <a href="/b">Sport</a> <a href="/c">Arts</a></div><h1>+Salt</h1><p>By our staff</p><p>+For a thousand years the town lived on salt, which was cut from the hill in blocks and sold as far as the sea.</p><p>+No more.</p><p>+The last mine was shut when the price fell, and the galleries were filled with water from the spring.</p><p><a href="/x">Next story</a></p><p>Share this</p><p><a href="/f">Here</a> <a href="/t">There</a></p></div>""",
    """<head><title>Unclosed</title><meta charset=utf-8><div id="sidebar-layout"><a href="/">Home</a><br><a href="/w">Work</a><p>+The ferry leaves at six in summer and at seven in winter, when the ice allows it to leave at all.</p><p>+Bring food.</p><p>+There is no shop on the island, and the ferry comes back only when the captain thinks that it should.</p><div>Contact</div><div><a href="/i">Imprint</a></div></div>""",
    """<body><ul><li><a href="/1">Soup</a></li><li><a href="/2">Fish</a></li><li><a href="/3">Cakes</a></li></ul><p>Menu</p><ul><li><a href="/4">About</a></li></ul><p>+Clean the fish under cold water and dry it with a cloth before you rub it with salt and oil.</p><ul><li>+Two onions</li><li>+One lemon</li><li>+Some thyme</li></ul><p>+Put it all in the oven for half an hour, turn it once, and serve it with bread while it is hot.</p><ul><li><a href="/5">Print</a></li><li>Rate</li><li><a href="/6">Save</a></li></ul></body>""",
    """<form id="page-form"><div class="content"><h1>+Orders</h1><p>+An order that is placed before noon leaves the house on the same day and arrives on the next.</p><p>+Parcels to the islands take two days more than that, and in a storm they wait at the harbour.</p></div><div>Search <input> <a href="/s">Go</a></div></form>""",
    """<div class="social-history"><h1>+Guilds</h1><p>+A guild set the price of bread, the length of the day and the number of apprentices that a master could take.</p><p>+Few left.</p><p>+Those who did had to leave the town as well, since no one within the walls would buy from them.</p></div><div class="share"><p>Send this page to a friend who might like to read it over a cup of tea tonight.</p></div>""",
    """<div><p><a href="/h">Start</a></p><p>You are here</p><p><a href="/g">Gardens</a></p></div><div><p>+Roses want clay, sun and a hard cut in spring; all else is a matter of taste and of patience.</p><p>+Cut low.</p><p>+By June the first flowers open, and if the dead ones are taken off they go on until the frost.</p></div><div><p><a href="/p">Ponds</a></p><p>Also good</p><p><a href="/l">Lawns</a></p></div>""",
    """<div>Log in or make an account</div><div><a href="/r">Register</a></div><table><tr><td>+Dear all, the meeting is on Monday at nine, in the large room, and we shall talk of the new roof.</td></tr><tr><td>+Please come.</td></tr><tr><td>+Whoever cannot come should send word by Friday, so that we know how many chairs we need for it.</td></tr></table><div><a href="/o">Older</a> <a href="/n">Newer</a></div><div>Page 1 of 9</div>""",
    """<header><h2>Town Crier</h2><p>News for all who live between the river and the wall, every day since the year of the flood.</p></header><div><h1>+Fire</h1><p>+The mill burned down on Tuesday night, and by the time that help came only the wheel was left.</p><p>+No one was hurt.</p></div><aside><p>More on fires of the last ten years, and on what was done to prevent the next one.</p></aside><div class="comments"><p>My father worked in that mill for thirty years and I can still smell the flour.</p><p>So sad.</p></div>""",
    """<main><h1>+Ink</h1><p>+Oak galls, iron and wine.</p><p>+<a href="/o">Oak galls</a></p><p>+<a href="/i">Iron salts</a> and <a href="/w">white wine</a></p><p>+Stir.</p></main><p>Copyright of all texts and pictures lies with the authors unless it is said otherwise on the page.</p>""",
    """<div><h1>+Note</h1><p>+Closed.</p></div><div><a href="/z">Zoo</a></div>""",
    """<article><p>+On.</p></article><nav><a href="/q">Q</a></nav><p>This site is run by volunteers who give their evenings to it, and it is paid for by your gifts.</p>""",
    """<article><h1>+Poll</h1><p>+Half of those who were asked said yes, a third said no, and the rest did not know what to say.</p><form><p>What do you say to the plan that the council has put before the town this week?</p></form><p>+So be it.</p></article>""",
    """<article><nav><a href="#a">Origins</a> <a href="#b">Use</a></nav><h1>+Wax</h1><p>+<a href="/b">Bees</a></p><p>+They make it from honey in glands under the belly and chew it until it is soft enough to build with.</p><p>+<a href="/c">Candles</a> <a href="/d">Polish</a></p><p>+Smell.</p><p>+<a href="/e">Seals</a></p><aside><a href="/m">More on bees</a></aside><div class="related"><a href="/n">Honey</a> <a href="/o">Mead</a></div></article>""",
    """<main><ul class="tags"><li><a href="/t">craft</a></li><li><a href="/u">wood</a></li></ul><p>+<a href="/v">Veneer</a></p><p>+A thin sheet of good wood is glued to a thick one of cheap wood, so that both look good.</p><p>+<a href="/w">Glue</a></p><p>+Press.</p><ul><li>+<a href="/x">Oak</a></li><li>+<a href="/y">Ash</a></li></ul><form><a href="/z">Report a fault</a></form></main>""",
    """<div><a href="/1">Spring</a></div><div>+In the valley the snow melts in the first days of March, and the road to the pass is closed until the end of May.</div><div><a href="/2">Summer</a></div><div>+The herds are taken up to the high meadows in June, and they stay there with the children until the schools begin.</div><div><a href="/3">Autumn</a></div><div>+When the first storm comes they are brought down again, with flowers on their horns and bells round their necks.</div><div><a href="/4">Winter</a></div><div>See also</div><div><a href="/5">Maps</a></div><div>Follow us</div><div><a href="/6">Post</a></div>""",
    """<p><a href="/k">Back</a></p><p>+The lock has eleven gates, and a boat that goes through all of them climbs as high as the tower of the church.</p><p><a href="/l">Pictures of it</a></p><p>+In a dry year the upper basin is closed, and whoever wants to go on must have the boat carried over the hill.</p><p><a href="/j">Timetable</a></p><p>Tickets</p><p><a href="/h">Buy them</a></p><p>Help</p><p><a href="/g">Ask</a></p>""",
    """<div><h1>+Frost</h1><p>+Cold.</p><p>+Water that freezes in a crack widens it, and in a hundred winters a wall of stone comes down that way.</p><p>+Wait.</p></div><div class="newsletter"><p>Get our letter once a week and never miss a story about stones, walls and winters again.</p></div><div class="ad">Warm boots for less</div><div id="comments"><p>Mine came down last year.</p><p>Nice one.</p></div>""",
    """<section class="hero banner"><p>Everything for the garden, from the seed to the spade, at prices that you will like.</p></section><article><p>+Dig.</p><p>+Then dig again, and take out each root that you find, since those that stay will grow before your seeds do.</p></article><section class="promo"><p>Spades</p><p>Order by noon and dig by night, with our new spade of Swedish steel.</p></section>""",
    """<article><h1>+List</h1><ul><li>+<a href="/a1">One</a></li><li>+<a href="/a2">Two</a></li><li>+<a href="/a3">Three</a></li></ul></article><p><a href="/a4">Four</a></p><p>Five</p><p><a href="/a6">Six</a></p><footer><a href="/a7">Seven</a></footer>""",
]

LABELLED += [
    """<div class="topnav"><a href="/a">Home</a> <a href="/b">Work</a></div><div><h1>+Glass</h1><p>+Sand, ash and fire make glass, and whoever blows it must not stop until the neck is closed.</p><p>+Wait.</p></div><p>Follow us</p><p><a href="/f">Here</a></p>""",
    """<main><div class="top-box"><h1>+Tides</h1><p>+Twice a day the sea comes up to the wall and twice a day it leaves the boats on the sand.</p></div><div class="bottom-section"><p>+In spring it comes higher than at any other time, and the cellars near the harbour are cleared for it.</p><p>+Look out.</p></div><div class="side-box"><a href="/t">Table of tides</a></div></main><div class="footer-links"><a href="/a">About</a> <a href="/i">Imprint</a></div>""",
    """<div class="content"><h1>+Rail</h1><div class="rail-section"><p>+The line was laid through the marsh on bundles of wood, and it sinks by a finger each year.</p></div><div class="notice-text"><p>+No train may go faster than a horse between the two bridges, and none may stop there.</p><p>+Slow.</p></div><div class="tag-list"><a href="/r">rail</a> <a href="/m">marsh</a></div><div class="subscribe-box"><p>Get our letter</p><a href="/l">Sign up</a></div></div>""",
]


def labelled_rows(pages: list[str] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    x, y = [], []
    for page in pages:
        marked, suspects = blocks(page)
        x.append(features(marked, suspects))
        y += [b.text.startswith("+") for b in marked]
    return np.concatenate(x), np.array(y, float)


def main_text(page: str | None, tree: tuple) -> str:
    """The main text of a page: its blocks in order, each on a line."""
    found, suspects = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found, suspects).tolist()) if says(tree, row))


def extract(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page, from its whole html; no shuffle."""
    tree = tree or grow(*labelled_rows())
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h, tree) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
