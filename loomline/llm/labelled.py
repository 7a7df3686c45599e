"""The labelled table of text blocks that the page classifier is trained on.

Pages are put together, by a seeded rule, from the regions that pages are made of: each region in its usual markups, blocks of
many lengths, articles of one to two thousand paragraphs, and names that mislead. From half of the pages all names are taken: no
classes or ids, and only tags that tell nothing. The text of a block begins with + if it is main text and with - if it
isn't. The words mean nothing; only their number and the links are features.
"""

from __future__ import annotations

import random
import re

PAGES, SEED = 300, 11
#: Articles of so many paragraphs at most, with the share of pages that have them.
LENGTHS = ((8, 0.8), (60, 0.98), (400, 0.995), (2000, 1.0))
WORD = "lorem"


class Writer:
    """Writes blocks of random length with a label."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int, label: str) -> str:
        return label + " ".join([WORD] * self.rng.randint(low, high))

    def main(self, low: int, high: int) -> str:
        return self.words(low, high, "+")

    def other(self, low: int, high: int) -> str:
        return self.words(low, high, "-")

    def links(self, n: int) -> str:
        return "".join(f"<li><a href='#'>{self.other(1, 5)}</a></li>" for _ in range(n))


def menu(w: Writer) -> str:
    items = w.links(w.rng.randint(2, 6))
    return w.rng.choice(("<nav><ul>{}</ul></nav>", "<div id='menu'><ul>{}</ul></div>", "<ul>{}</ul>", "<div class='main-nav'>{}</div>", "<div role='navigation'><ul>{}</ul></div>")).format(items)


def head(w: Writer) -> str:
    title, motto = f"<h1>{w.other(1, 4)}</h1>", f"<p>{w.other(3, 14)}</p>"
    return w.rng.choice(("<header>{}</header>", "<div class='site-header'>{}</div>", "<div id='masthead'>{}</div>")).format(w.rng.choice((title, title + motto, motto)))


def advert(w: Writer) -> str:
    return w.rng.choice(("<div class='ad'>{}</div>", "<div class='ad-box'><p>{}</p></div>", "<div class='sponsored'><p>{}</p></div>", "<aside><p>{}</p></aside>", "<div class='promo-banner'>{}</div>")).format(w.other(3, 30))


def notice(w: Writer) -> str:
    return w.rng.choice(("<div class='cookie-notice'><p>{}</p></div>", "<div id='consent'>{}</div>", "<div class='newsletter'><p>{}</p></div>", "<form><p>{}</p></form>", "<div class='alert'>{}</div>")).format(w.other(4, 35))


def side(w: Writer) -> str:
    body = "".join(f"<p>{w.other(4, 30)}</p>" for _ in range(w.rng.randint(1, 3))) + w.rng.choice(("", f"<ul>{w.links(3)}</ul>"))
    return w.rng.choice(("<aside>{}</aside>", "<div id='sidebar'>{}</div>", "<div class='widget'>{}</div>", "<div class='related-content'>{}</div>")).format(body)


def talk(w: Writer) -> str:
    said = "".join(w.rng.choice(("<p>{}</p>", "<div class='comment-body'>{}</div>", "<article class='comment'><p>{}</p></article>")).format(w.other(1, 60)) for _ in range(w.rng.randint(1, 6)))
    return w.rng.choice(("<section id='comments'>{}</section>", "<div class='comment-list'>{}</div>", "<div id='disqus-thread'>{}</div>", "<div class='replies'>{}</div>")).format(said)


def foot(w: Writer) -> str:
    return w.rng.choice(("<footer>{}</footer>", "<div id='footer'><p>{}</p></div>", "<div class='page-footer'>{}</div>", "<footer><p>{}</p></footer>")).format(w.other(2, 25))


def bare(w: Writer) -> str:
    """Small blocks that no name tells of."""
    return w.rng.choice((f"<p>{w.other(1, 2)}</p>", f"<p><a href='#'>{w.other(1, 12)}</a></p>", f"<div><a href='#'>{w.other(5, 16)}</a></div>"))


def story(w: Writer, named: bool) -> str:
    """An article's blocks; without a name around them its first and last are long, as nothing else tells them apart, and most of
    the others."""
    u = w.rng.random()
    n = w.rng.randint(1, next(most for most, share in LENGTHS if u < share))
    out = [f"<h{w.rng.randint(1, 2)}>{w.main(1, 10)}</h1>"] if named or w.rng.random() < 0.5 else []
    for k in range(n):
        low = 1 if named else 16 if k in (0, n - 1) or w.rng.random() < 0.8 else 2
        out.append(w.rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>")).format(w.main(low, 120)))
        if named and w.rng.random() < 0.12:
            out.append(f"<p><a href='#'>{w.main(1, 9)}</a></p>")
        if named and w.rng.random() < 0.12:
            out.append(w.rng.choice((advert, notice, menu))(w))
        if named and w.rng.random() < 0.08:
            out.append(f"<div class='{w.rng.choice(('legal', 'has-sidebar', 'category-ads', 'step', 'note'))}'><p>{w.main(1, 40)}</p></div>")
    return "".join(out)


NAMED = (
    "<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<div class='post-content'>{}</div>", "<article class='post search-engine-news'>{}</article>",
    "<form id='wholeForm'><div id='content'>{}</div></form>", "<main><article class='entry no-comments'>{}</article></main>", "<div class='header-wrapper'><article>{}</article></div>",
)
BODIES = ("<body>", "<body>", "<body class='single has-sidebar'>", "<body class='no-comments'>", "<body id='search'>", "<body class='menu'>")


def nameless(html: str) -> str:
    """A page without its names: classes, ids and roles go, and regions become plain elements."""
    html = re.sub(r""" (class|id|role)=('[^']*'|"[^"]*")""", "", html)
    return re.sub(r"<(/?)(article|main|nav|header|footer|aside|form|section)>", r"<\1div>", html)


def page(rng: random.Random) -> str:
    w = Writer(rng)
    told, named = rng.random() < 0.5, rng.random() < 0.75
    before = [f(w) for f in rng.sample((menu, head, advert, notice, bare, side), rng.randint(0, 4))]
    after = [f(w) for f in rng.sample((side, talk, foot, bare, advert, notice), rng.randint(0, 4))]
    if told:
        body = (rng.choice(NAMED) if named else rng.choice(("<div>{}</div>", "{}", "<div class='row'><div>{}</div></div>"))).format(story(w, named))
        return "<html>" + rng.choice(BODIES) + "".join(before) + body + "".join(after) + "</body></html>"
    if rng.random() < 0.25:  # a page of a few words, with nothing but links around them
        short = "".join(f"<p>{w.main(1, 14)}</p>" for _ in range(rng.randint(1, 6)))
        return nameless("<html><body>" + rng.choice((menu, bare_links))(w) * rng.randint(0, 1) + f"<div>{short}</div>" + bare_links(w) * rng.randint(0, 1) + "</body></html>")
    before = [f(w) for f in rng.sample((menu, menu, small, small, bare), rng.randint(0, 4))]
    after = [f(w) for f in rng.sample((menu, small, small, bare, bare), rng.randint(0, 4))]
    return nameless("<html><body>" + "".join(before) + f"<div>{story(w, False)}</div>" + "".join(after) + "</body></html>")


def bare_links(w: Writer) -> str:
    return f"<div>{''.join(f'<p><a>{w.other(1, 12)}</a></p>' for _ in range(w.rng.randint(1, 4)))}</div>"


def small(w: Writer) -> str:
    """What stands around an article in a few words: a site's name, a notice, an advert, a line at the foot."""
    return "".join(w.rng.choice(("<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>")).format(w.other(1, 14)) for _ in range(w.rng.randint(1, 3)))


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
