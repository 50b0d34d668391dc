"""What the main text is, held against the standard library's parser and plain lists of what is left out."""

from html.parser import HTMLParser

import pytest

from lakeguard.llm import html_text

OUT = {"sidebar", "menu", "notice", "footer", "user-comments", "reader-comments", "author-comments-list", "promoted-content", "newsletter-signup-form", "page-header-x"}


class Plain(HTMLParser):
    """An extractor of its own: text outside elements of given tags, classes and ids, blocks joined by one space."""

    def __init__(self, out, tags=("script", "style", "nav", "footer", "aside", "form", "title")):
        super().__init__(convert_charrefs=True)
        self.out, self.tags, self.stack, self.parts = out, tags, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img"):
            self.parts.append("")
            return
        given = dict(attrs)
        names = set((given.get("class") or "").split()) | {given.get("id")}
        self.stack.append(tag in self.tags or bool(names & self.out))
        if tag not in ("b", "a", "i"):
            self.parts.append("")

    def handle_endtag(self, tag):
        self.stack.pop()
        if tag not in ("b", "a", "i"):
            self.parts.append("")

    def handle_data(self, data):
        if not any(self.stack):
            self.parts[-1] += data

    def text(self):
        return " ".join(t for t in (" ".join(p.split()) for p in self.parts) if t)


def plain(page, out=frozenset(OUT)):
    p = Plain(out)
    p.feed(page)
    p.close()
    return p.text()


PAGES = [
    '<body><main><div class="content"><p>Body</p></div><div class="sidebar">Side</div><div class="menu">Menu</div><div class="notice">Notice</div><div id="footer">Foot</div></main></body>',
    '<body><article><h1>T</h1><p>Body <b>bold</b> &amp; more</p><div class="user-comments"><p>First</p></div><div id="reader-comments">x</div><div class="author-comments-list">y</div><div class="promoted-content">z</div></article></body>',
    '<body><div class="article-header"><h1>Title</h1></div><div class="text"><p>Body</p></div><div class="newsletter-signup-form">Mail</div></body>',
    '<body><nav>N</nav><div class="post-header"><h1>Title</h1></div><main><div class="header"><h2>Own</h2></div><p>Text</p></main><footer>F</footer></body>',
]


@pytest.mark.parametrize("page", PAGES)
def test_names_inside_and_outside_main_elements(page):
    assert html_text.main_text(page) == plain(page)


def extract(spark, pages):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_lines_told_by_their_place(spark):
    """A bare paragraph at the end of pages with ever other numbers of paragraphs, and one at their beginning."""
    own = [" ".join(f"Own {i} part {k}." for k in range(1 + i % 5)) for i in range(30)]
    pages = [(i, f"http://h.example/{i}", "<body><article><p>Read this first</p>" + "".join(f"<p>Own {i} part {k}.</p>" for k in range(1 + i % 5)) + "<p>Subscribe to our daily letter</p></article></body>") for i in range(30)]
    assert extract(spark, pages) == dict(enumerate(own))


def test_paths_with_slashes(spark):
    """A branch below a name that begins like another's, both repeated."""
    pages = [(i, "http://h.example/x", f'<body><div class="w-1">Repeated head</div><div class="w-1/2">Repeated box</div><div class="w-1[1]">Repeated too</div><p>Own text {i}</p></body>') for i in range(20)]
    assert extract(spark, pages) == {i: f"Own text {i}" for i in range(20)}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 10, 40])
def test_few_pages_are_little_evidence(spark, n):
    """A repeated branch goes from five pages on, as nothing changes at any one size but the evidence."""
    pages = [(i, "http://h.example/x", f"<body><div class=box>Same box</div><p>Own {i}</p></body>") for i in range(n)]
    assert extract(spark, pages) == {i: (f"Own {i}" if n >= 5 else f"Same box Own {i}") for i in range(n)}


def test_given_pages_against_the_plain_extractor(spark):
    """All pages of the smallest table: an article of h1, p, b and br, next to a menu, an advert and a footer."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: plain(r.html or "", frozenset(("ad",))) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got.keys() == want.keys()
    assert [k for k in want if got[k] != want[k]] == []
