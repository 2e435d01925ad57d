import random
import time

import pyarrow.parquet as pq
import pytest

from emberloom.llm.html_text import BLOCK, Node, composite, extract, extract_pages, main_node, measure, parse

CASES = [
    (None, ""),
    ("", ""),
    ("<html><body></body></html>", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a<p>b<br>c", "a\nb\nc"),
    ("<body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>T &lt;1&gt;</h1><p>One  \n two.</p><p>Three</p></article><footer>(c)</footer></body>", "T <1>\nOne two.\nThree"),
    ("<body><header>Site</header><main><header><h1>Title</h1></header><p>Body text here.</p></main><aside>Side</aside></body>", "Title\nBody text here."),
    ("<body><div class='cookie-notice'>We use cookies</div><article><p>Long text of the article, which goes on.</p><div class=\"ad\">Buy</div><p>End.</p></article><div id=comments><p>First!</p></div></body>", "Long text of the article, which goes on.\nEnd."),
    ("<article><p>a</p><script>var t='</p>';</script><style>p{}</style><form><input value=1>Name</form><!-- <p>no</p> --><p>b <b>c</b></p>", "a\nb c"),
    ("<article><p>1 < 2 and <b>bold</p><table><tr><td>x<td>y<tr><td>z</table></article>", "1 < 2 and bold\nx\ny\nz"),
    ("<body><div class='header'>Site</div><div class='layout has-sidebar'><article><div class='article-header'><h1>Title</h1></div><p>Words of the text.</p></article></div></body>", "Title\nWords of the text."),
    ("<body><div><p>Main story with many words in it, told over two blocks.</p><p>The second block of the story is here.</p></div><div class='sidebar'><a href=/x>link</a></div></body>", "Main story with many words in it, told over two blocks.\nThe second block of the story is here."),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_cases(html, text):
    assert extract(html) == text


TEXT = "".join(f"<p>Paragraph {k} of the article goes on for a while, in words.</p>" for k in range(4))
LINES = "\n".join(f"Paragraph {k} of the article goes on for a while, in words." for k in range(4))


@pytest.mark.parametrize(
    "opening",
    [
        "class='overflow-hidden'", "style='overflow:hidden'", "aria-hidden='false'", "title='hidden places'", "data-hidden='1'", "class='elementor-widget-container'", "class='widget_text'",
        "class='layout-right-sidebar'", "class='comments-enabled'", "class='sidebar'", "class='comments'",
    ],
)
def test_names_that_are_not_of_page_parts(opening):
    assert extract(f"<body><div {opening}>{TEXT}</div><div class='site-footer'>(c)</div></body>") == LINES
    if "'sidebar'" not in opening and "'comments'" not in opening:
        assert extract(f"<body><article>{TEXT}<div {opening}>A box of it.</div></article></body>") == LINES + "\nA box of it."


def test_headings_and_links_keep_their_words():
    page = "<h2 id='related-work'>Related work</h2><h2 id=notice>Notice</h2><p id='comments'>See <a href='/hidden-gems'>gems</a>.</p>"
    assert extract(f"<body><article>{TEXT}{page}</article></body>") == LINES + "\nRelated work\nNotice\nSee gems."


@pytest.mark.parametrize("opening", ["hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; display : none'", "class='comment-list'", "class='main-nav'", "id=cookie-banner", "class='x related-posts'", "role=navigation"])
def test_page_parts_go(opening):
    assert extract(f"<body><article>{TEXT}<div {opening}>Not of it.</div></article></body>") == LINES


@pytest.mark.parametrize("wraps", [("", ""), ("<div>", "</div>")])
def test_an_article_in_several_boxes_is_whole(wraps):
    links = "<div><ul>" + "".join(f"<li><a href=/{k}>Link number {k} to elsewhere</a></li>" for k in range(20)) + "</ul></div>"
    parts = [[f"Paragraph {k} of the article goes on for quite a while, in words of its own." for k in range(a, b)] for a, b in ((0, 10), (10, 16))]
    boxes = [wraps[0] + "<div>" + "".join(f"<p>{x}</p>" for x in p) + "</div>" + wraps[1] for p in parts]
    assert extract(f"<body>{links}<div>{boxes[0]}{links}{boxes[1]}</div></body>") == "\n".join(parts[0] + parts[1])


def test_deep_and_long_pages():
    assert extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert extract("<article>" + "<p>x</p>" * 20_000 + "</article>").count("\n") == 19_999


def random_page(rng, depth=0):
    """Markup of boxes without names: only density can tell them apart."""
    if depth == 4 or (depth and rng.random() < 0.3):
        words = " ".join(rng.choice(["one", "word", "after", "another"]) for _ in range(rng.choice([1, 3, 40])))
        return f"<p>{words}</p>" if rng.random() < 0.6 else "".join(f"<a href=/x>{w}</a> " for w in words.split())
    tag = rng.choice(["div", "section", "ul", "span"])
    return f"<{tag}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"


def test_the_chosen_subtree_has_the_largest_sum_of_all():
    rng = random.Random(11)
    for _ in range(200):
        body = measure(parse("<body>" + "".join(random_page(rng) for _ in range(3)) + "</body>"))

        def counts(x):
            """Characters, tags, and both of links, by walking through the subtree."""
            c = t = lc = lt = 0
            for y in x.children:
                if isinstance(y, Node):
                    a, b, d, e = counts(y)
                    c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (y.tag == "a")
                else:
                    c += len(y.strip())
            return c, t, c if x.tag == "a" else lc, lt

        def all_of(x):
            return [x] + [z for y in x.children if isinstance(y, Node) for z in all_of(y)]

        c, _, lc, _ = counts(body)
        density = lambda x: composite(*counts(x), lc / max(c, 1)) if counts(x)[0] else 0.0  # noqa: B023, E731

        def total(x):
            inner = [density(y) for y in x.children if isinstance(y, Node) and y.tag in BLOCK and counts(y)[0]]  # noqa: B023
            return sum(inner) if inner else density(x)  # noqa: B023

        node, least = main_node(body)
        assert total(node) == pytest.approx(max(total(x) for x in all_of(body) if x is body or (x.tag in BLOCK and counts(x)[0])))
        path = [node]
        while path[-1] is not body:
            path.append(path[-1].parent)
        assert least == pytest.approx(min(density(x) for x in path))


def test_density_alone_finds_an_article_among_boxes_without_names():
    links = "<div><ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(12)) + "</ul></div>"
    page = f"<body><div><a href=/>Site</a> <a href=/b>About</a></div>{links}<div><h1>The title of it</h1>{TEXT}</div>{links}<div>All rights of this site.</div></body>"
    assert extract(page, lists=False) == extract(page) == "The title of it\n" + LINES
    assert extract(page, density=False) != extract(page)


def test_long_comments_do_not_become_the_article():
    talk = "".join(f"<p>Comment {k} says a great deal more about this than the article does.</p>" for k in range(30))
    assert extract(f"<body><article><h1>Title</h1>{TEXT}</article><div id=comments>{talk}</div></body>") == "Title\n" + LINES


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a '" * 250_000, "<script></script" * 60_000, "<div>" * 50_000 + "</x>" * 100_000, "<ul><li><ul>" + "<div>" * 50_000 + "</li><li>" * 50_000, "<p><button>" + "<ul>" * 100_000, "<!--" * 250_000, "<" * 500_000])
def test_pages_of_unfinished_markup_take_time_by_their_length(page):
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 5


def test_pages_table(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    html = {r["page_id"]: r["html"] for r in pq.read_table(path).to_pylist()}
    got = extract_pages(spark.read.parquet(path)).collect()
    assert len(got) == len(html)
    for r in got:
        # these pages mark their article, which the extraction doesn't look at
        inner = extract(html[r.page_id].split("<article>")[1].split("</article>")[0], lists=False, density=False)
        assert r.text == inner == extract(html[r.page_id].replace("article>", "div>")) and r.n_chars == len(r.text)
        assert "track(" not in r.text and "©" not in r.text.split("\n")[-1]


def test_other_columns_and_empty_table(spark):
    d = spark.createDataFrame([(1, "u", None, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in extract_pages(d).collect()] == [(1, "u", "", 0)]
    assert extract_pages(d.limit(0)).count() == 0


def made_page(rng):
    """A page of boxes without names around an article whose text is known: html and that text."""
    words = "river stone house market garden letter winter signal carpet window engine harbour".split()
    sentence = lambda: (" ".join(rng.choices(words, k=rng.randint(9, 16))) + ", as they said.").capitalize()
    paragraphs = [" ".join(sentence() for _ in range(rng.randint(3, 6))) for _ in range(rng.randint(3, 7))]
    links = lambda n: "".join(f"<li><a href='/{k}'>{rng.choice(words)}</a></li>" for k in range(n))
    title = rng.choice(words).capitalize() + " and more"
    article = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    box = rng.choice(["div", "section", "article", "main"])
    body = f"<div><ul>{links(rng.randint(4, 9))}</ul></div><{box}>{article}</{box}><div><ul>{links(rng.randint(3, 8))}</ul></div>"
    wrapped = rng.choice(["{}", "<form id='f' method='post'><input type='hidden' value='x'>{}</form>", "<div><form>{}</form></div>", "<nav><ul><li><a href='/'>Home</a></li></ul>{}", "<aside>{}", "<menu><a href='/'>Home</a>{}", "<div class='wrapper'>{}</div>"])
    end = rng.choice(["", "<footer><a href='/a'>About</a> Some company</footer>", "<div class='comments'><p>" + sentence() + "</p></div>"])
    inside = rng.random() < 0.5
    page = wrapped.format(body + end) if inside or wrapped[:5] in ("<nav>", "<asid", "<menu") else wrapped.format(body) + end
    return f"<html><head><title>x</title></head><body>{page}</body></html>", "\n".join([title, *paragraphs])


def test_pages_of_known_text_come_out_whole():
    rng = random.Random(9)
    for _ in range(400):
        html, text = made_page(rng)
        assert extract(html) == text, html


def test_wrappers_and_parts_that_are_never_closed_lose_no_page():
    p = "<p>" + "A sentence of the article, with commas, and words. " * 6 + "</p>"
    text = ("A sentence of the article, with commas, and words. " * 6).strip()
    for start in ("<form>", "<form><h1>T</h1>", "<nav>", "<aside>", "<menu>", "<nav><a href='/'>Home</a><a href='/x'>More</a>", "<dialog>"):
        assert extract(f"<body>{start}{p}{p}").removeprefix("T\n") == f"{text}\n{text}"
    # closed parts stay parts, and so does what an article stands beside
    assert extract("<body><footer>2024 only a footer here</footer></body>") == "" and extract(f"<body>{p}<aside>{p}{p}</aside></body>") == text
    assert extract(f"<body><div><h1>T</h1>{p}</div><div class='comments'>{p * 20}</div></body>") == f"T\n{text}"
