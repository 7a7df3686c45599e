"""Page extraction on pages that the tree has not seen."""

import time
from html.parser import HTMLParser

import pytest

from loomline.llm import html
from loomline.llm.labelled import labelled_pages

#: Pages written by hand; each block's text begins with + (main text) or - (not).
PAGES = (
    "<body><nav><ul><li><a href='/'>-Home</a></li><li><a href='/n'>-News of the day</a></li></ul></nav><div class='ad'>-Buy two pairs and get the third one free.</div>"
    "<article><h1>+A short walk by the river</h1><p>+We went out early.<p>+It rained.</p><p>+The path along the water was empty but for a heron, and we walked it to the end without a word.</p></article>"
    "<footer>-Copyright of the site, all rights reserved by its owner</footer></body>",
    "<body><header><a href='/'>-Site</a> <p>-The paper of record since long ago</p></header><main><h2>+Storm warning</h2><p>+Winds of great force are expected on the coast tonight, said the <a href='#'>weather office</a>.</p>"
    "<aside><p>-Read also what happened last year when the storm came</p></aside><form><p>-Your mail address please</p></form><p>+Stay in.</p></main><div class='comments'><p>-I do not believe a word of this, as usual they exaggerate everything</p></div></body>",
    "<body><div id='menu'><a>-One</a> <a>-Two</a></div><div><p>+The committee met for a full day and heard from fourteen speakers, none of whom agreed with the last.</p>"
    "<p>+It will meet again in spring, when the report on the harbour and its cost to the town is due.</p><p>+Members thanked the chair for her patience during a long and at times heated session of questions.</p></div>"
    "<div class='footer'>-Contact and imprint</div></body>",
    "<body><ul><li><a>-Sports</a></li><li><a>-Money</a></li><li><a>-Travel and more</a></li></ul><div>+A long paragraph without any region around it tells of the early days of the railway and of the men who built it by hand.</div>"
    "<div>+The line was opened in the autumn, and within a year carried more people than all the coaches of the county together.</div><p><a>-Next page</a></p><p>-Terms</p></body>",
    "<body><article><p>+No.</p><p>+Yes, said the boy, and he went.</p><div class='newsletter'>-Get our best stories in your mail box every single morning, free of charge.</div>"
    "<p>+They ate.</p><p><a href='#'>+The whole paragraph is one link to a source</a></p></article><div class='sidebar'><p>-Most read this week by our members and by other readers</p></div></body>",
    "<body><div class='cookie-notice'><p>-We and our partners keep small files on your device to remember what you like and to count visits to this site.</p></div>"
    "<article><h1>+Title</h1><p>+Body text of some length that speaks of nothing much in particular.</p><section class='comments'><p>-First!</p><p>-Great piece, thanks for writing it down so clearly for all of us.</p></section></article></body>",
    "<body><p>-Log in</p><p>+Bread needs flour, water, salt and time; everything else is a matter of taste and of what the shop had on that day.</p><p>-Share</p></body>",
    "<body><div><p>+The bridge was closed for two years while its arches were mended, and the town learned to walk the long way round.</p></div>"
    "<div><a>-Ten ways to make your garden grow faster this summer without any effort at all</a></div><div><a>-What the mayor said about the bridge when he thought that nobody was there to listen</a></div></body>",
    "<body><ul><li><a>-Weather</a></li><li><a>-Traffic and roads</a></li></ul><table><tr><td>+The council voted on Monday to keep the old library open for at least another year while it looks for a cheaper roof.</td></tr>"
    "<tr><td>+Readers had gathered more than four thousand names in its favour, the largest petition that the town has seen.</td></tr></table><p>-Print</p></body>",
    "<body><main><p>+Add the onions.</p><p>+Stir.</p><p>+Leave the pot on a low flame until the water is gone and the rice has taken all of the colour.</p><nav><a>-Next recipe</a></nav></main>"
    "<div class='promo'><p>-Order our cook book today and have it at your door before the weekend, with no charge for postage.</p></div></body>",
    "<body><div id='sidebar'><p>-Our archive goes back to the very first issue and may be read by all members</p></div><article><p>+She left at dawn.</p><p><a>+Her diary of those days</a></p></article>"
    "<div id='comments'><p>-What a fine piece, I read it twice and will pass it on to my sister who lives there.</p><p>-Agreed</p></div></body>",
    "<body><div class='banner'>-This site is best seen on a large screen, please turn your phone on its side or come back later.</div><div><p>+In the spring the snow melts on the high meadows and the cattle are driven up by the whole village.</p>"
    "<p>+They stay until the first frost.</p></div><p>-Top</p><div><a>-Five things that you did not know about cows, and one that you knew but had forgotten</a></div></body>",
    "<body><form><p>-Search this site for words, names, places and dates of any kind here</p></form><article><h2>+Short news</h2><p>+Shop reopens.</p><p>+Bus late.</p></article><footer><p>-Written and printed by the school's own press club in the old gym hall since the war</p></footer></body>",
    "<body><header><h1>-The Daily Example</h1><p>-News and views for all who live between the two rivers and beyond them</p></header><div><p>+A new well was dug behind the church last week, and by Friday its water ran clear and cold.</p><p>-Send</p></div></body>",
    "<body><nav>-All topics</nav><article><p>+One.</p></article><footer>-About the site and those who make it, with a long list of names that goes on for a while</footer></body>",
)




def wrong(tree, pages):
    rows, labels = html.labelled(pages)
    return sum(html.is_main(tree, r) != y for r, y in zip(rows, labels)) / len(labels)


def test_held_out_blocks():
    tree = html.trained()
    assert len(html.labelled(labelled_pages())[1]) > 300
    assert wrong(tree, PAGES) < 0.05
    assert wrong(tree, labelled_pages(200, seed=5)) < 0.05


def test_words_and_links_decide_where_no_name_does():
    """Of pages that don't name their article, words and links of the block and of those around it decide."""

    def used(tree):
        return set() if isinstance(tree, bool) else {tree[0]} | used(tree[2]) | used(tree[3])

    root, _, nameless, named = html.trained()
    assert root == html.ANYWHERE and {0, 1, 6, 7} <= used(nameless) and {10, 11} <= used(named)


PROSE = " ".join(["word"] * 40)
BOILERPLATE = (
    "Copyright 2024 Example Inc. All rights reserved.", "We use cookies to improve your experience on this site.", "Terms of use and privacy policy", "Sign in", "Share this page",
    "<a href='/a'>A long list of links to other stories on this site that may be of interest to its readers</a>",
)


@pytest.mark.parametrize("count", [1, 2, 30, 240, 400, 5000])
def test_pages_of_any_length_keep_their_text(count):
    """Equal paragraphs in a plain element: all stay, however many there are, and what stands around them goes."""
    tree = html.trained()
    article = f"<div>{f'<p>{PROSE}</p>' * count}</div>"
    assert html.main_text(f"<body>{article}</body>", tree).split("\n") == [PROSE] * count
    around = "<body>" + "".join(f"<div><p>{b}</p></div>" for b in BOILERPLATE) + article + "".join(f"<p>{b}</p>" for b in BOILERPLATE) + "</body>"
    assert html.main_text(around, tree).split("\n") == [PROSE] * count
    boxed = f"<body><div class='sidebar-left'><p>{PROSE}</p></div>{article}</body>"
    assert html.main_text(boxed, tree).split("\n") == [PROSE] * count


def test_pages_of_a_few_words():
    tree = html.trained()
    for page, text in (("Hello", "Hello"), ("<p>Hello <b>world</b></p>", "Hello world"), ("<p>a</p><p>b c</p>", "a\nb c"), ("<ul><li><a>Home</a></li></ul><p>Just a few words.</p>", "Just a few words.")):
        assert html.main_text(page, tree) == text


def test_broken_markup():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<p class=\"x>Hello</p><p class=\"y\">World</p>") == ["Hello", "World"]
    assert texts("<p class='x>Hello") == ["Hello"]
    assert texts("<div data-x=\"<b>hi</b>\">in</div><a title='a > b'>t</a>") == ["in", "t"]
    assert texts("a < b & 3 <4 </ x>c <!doctype html>d<!-- e > -- f -->g<![CDATA[<p>h</p>]]>i") == ["a < b & 3 <4 c dgi"]
    assert texts("kept <p title='a") == ["kept"] and texts("kept <!-- lost") == ["kept"] and texts("kept <scr") == ["kept"]
    assert texts("<b><i>x</b>y</i>z</i></b></p><p>q") == ["xyz", "q"]
    nested = html.blocks("<nav><div><article>a</article></div></nav><article>b<nav>c<p>d</nav>e</article>f")
    assert [(b.text, b.in_main) for b in nested] == [("a", True), ("b", True), ("c", True), ("d", True), ("e", True), ("f", False)]


@pytest.mark.parametrize(
    "part",
    ["<a ", "<!-- -->", "<!--", "<div></p>", "<b>", "<nav>x", "<nav><article>x", "<p class=\"x>y", "<", "&", "<ul><li>a", "<table><tr><td>x", "<script>", "</p>", "<p ='", "= ", "<span class=ad>x</b>"],
)
def test_work_grows_with_the_length(part):
    """A page eight times as long takes about eight times as long: far from the square."""
    tree = html.trained()

    def seconds(size):
        page = part * (size // len(part))
        began = time.process_time()
        html.main_text(page, tree)
        return time.process_time() - began

    seconds(20_000)
    assert seconds(800_000) < 24 * max(seconds(100_000), 0.02)


LONG = "The harbour was built by the town itself, stone by stone, over the forty years that followed the great flood."


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single has-sidebar'><article><h1>A title</h1><p>Short.</p><p>{}</p></article></body>",
        "<body class='no-comments'><main><h1>A title</h1><p>Short.</p><p>{}</p></main></body>",
        "<form id='aspnetForm'><div id='content'><h1>A title</h1><p>Short.</p><p>{}</p></div></form>",
        "<article class='post search-engine-news'><h1>A title</h1><p>Short.</p><p>{}</p></article>",
        "<article><div class='legal'><h1>A title</h1><p>Short.</p><p>{}</p></div></article>",
        "<div class='header-wrapper'><header><a href='/'>The Site</a></header><article><header><h1>A title</h1></header><p>Short.</p><p>{}</p></article><div class='comment-list'><article><p>I was there when it was built and it was not like that at all.</p></article></div></div>",
        "<body id='search'><nav><a>One</a></nav><article class='hentry'><h1>A title</h1><aside><p>Read this as well, it is by the same author</p></aside><p>Short.<p>{}</article><footer>All rights reserved</footer>",
    ],
)
def test_names_are_no_verdict(page):
    assert html.main_text(page.format(LONG), html.trained()) == f"A title\nShort.\n{LONG}"


def test_page_without_names():
    page = f"<div><a>Home</a> <a>About us</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div><a>Ten more stories about harbours that you should read today</a></div><p>Terms</p>"
    assert html.main_text(page, html.trained()) == f"{LONG}\n{LONG}"


class Article(HTMLParser):
    """A plain reader of pages whose main text is what <article> holds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.lines[-1] += " "
        elif tag not in html.INLINE:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.lines.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def test_every_page_of_a_table(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    pages = spark.read.parquet(path)
    want = {}
    for r in pages.collect():
        reader = Article()
        reader.feed(r.html or "")
        reader.close()
        want[r.page_id] = "\n".join(t for t in (" ".join(x.split()) for x in reader.lines) if t)
    found = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert found == {k: (t, len(t)) for k, t in want.items()}
