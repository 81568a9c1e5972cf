import random
import time

from docloom.llm import html_extract

SCHEMA = "page_id long, url string, html string, id string, text string, n_blocks string"
WRAP = '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">{}</body></html>'
LONG = "A sentence, with a comma, of the article; it goes on and on. "


def text(source):
    return "\n\n".join(html_extract.content_blocks(source))


def test_tables_make_of_page(spark):
    page = WRAP.format('<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this now.</div><article><h1>Head &amp; line &am</h1><p><b>Bold.<br><p>One&nbsp;two\n  three &lt;x&gt; &#8364;.</p><p>Short</p></article><footer>&copy; me</footer>')
    want = "Head & line &am\n\nBold.\n\nOne two three <x> €.\n\nShort"
    assert text(page) == want
    rows = [(1, "u", page, "a", "b", "c"), (1, "u", page, "a", "b", "c"), (2, None, None, None, None, None), (None, "v", "", "", "", ""), (3, "w", "plain & simple", "", "", "")]
    got = html_extract.main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["id", "url", "text", "n_blocks"]
    assert sorted((r.id or 0, r.text, r.n_blocks) for r in got.collect()) == [(0, "", 0), (1, want, 4), (1, want, 4), (2, "", 0), (3, "plain & simple", 1)]
    assert html_extract.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_articles_without_the_element_and_what_surrounds_them():
    body = f"<h1>Title</h1><p>{LONG * 3}</p><p>Short.</p><h2>Part</h2><ul><li>one item</li><li>two</li></ul><blockquote>{LONG}</blockquote><table><tr><td>a<td>b</table>"
    want = "\n\n".join(["Title", (LONG * 3).strip(), "Short.", "Part", "one item", "two", LONG.strip(), "a", "b"])
    around = (
        '<header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies, as all do, to track, sell and bore you.</div><div class="menu"><a href=/>Home</a> <a href=/b>B</a></div>{}'
        f'<div class="sidebar"><p>{LONG * 2}</p></div><section id="comments"><h3>2 comments</h3><p>{LONG * 9}</p></section><form><p>Name</p><input value="x"></form><div class="footerNav">Imprint</div><aside>{LONG}</aside>'
    )
    for holder in ('<div class="content">{}</div>', '<main id="main">{}</main>', "<article class=post>{}</article>", "<div><section>{}</section></div>", '<form id="aspnetForm"><article>{}</article></form>', '<div class="content-with-sidebar">{}</div>'):
        assert text(WRAP.format(around.format(holder.format(body)))) == want, holder
    # the heading may stand before the container
    assert text(WRAP.format(around.format(f'<h1>Title</h1><div class="content">{body[14:]}</div>'))) == want


def test_inside_an_article():
    page = f'<article><header><h1>T</h1></header><p>{LONG}<span class="share">Share me</span><a href="x">link</a>d</p><div class="advert">Buy</div><figure><figcaption>Cap</figcaption></figure><nav>x</nav><article>Answer by a reader.</article><footer>by me</footer><p hidden>no</p><p style="display: none">no</p></article>'
    assert text(page) == f"T\n\n{LONG}linkd\n\nCap"
    assert text(f"<main><h1>T</h1><article><p>{LONG}</p></article></main>") == f"T\n\n{LONG.strip()}"
    assert text(f'<article class="teaser"><p>{LONG}</p></article><article><p>{LONG}!</p></article>') == f"{LONG.strip()}\n\n{LONG}!"


def test_broken_markup():
    assert text("<p>a<p>b<div>c</p>d</div>e</p>f") == "\n\n".join("abcdef")
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "\n\n".join("abcd")
    assert text("<p>cut off <b attr='x") == "cut off" and text("a < b && c <3 d</ >") == "a < b && c <3 d"
    assert text("<p title='a>b' data-x=\"<p>\">x</p><!-- open <p>y") == "x"
    assert text("<script>if (a</script >b") == "b" and text("<style>never closed <p>x") == ""
    assert text("<nav><p>only a menu</p></nav>") == "" and text("<p> \n &nbsp; </p>") == ""


def test_hostile_pages_take_linear_time():
    n = 20_000
    kinds = ["<div>x" * n, "<p>" * n, "<p>a</div>" * n, "<table><td>" * n, "<a href='" * n, "<" * n, "<!--" * n, "&" * n, "<span class=ad>x" * n, "<li>x" * n, "<p a b c= =" * n, "</p>" * n, "<script>" * n, "<div class='a b'>x</div>" * n, "<ul>" * n + "<li>x" * n]
    for piece in kinds:
        html_extract.content_blocks(piece[: len(piece) // 20])
        took = []
        for part in (piece[: len(piece) // 2], piece):
            start = time.process_time()
            html_extract.content_blocks(part)
            took.append(time.process_time() - start)
        assert took[1] < 4 * took[0] + 0.2, (piece[:20], took)


def test_random_pages_keep_every_word_of_the_article():
    rng = random.Random(5)
    for _ in range(200):
        blocks = [" ".join(rng.choice(["one", "two,", "three.", "x &lt; y", "é"]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))]
        tags = [rng.choice(["p", "h2", "li", "div", "blockquote"]) for _ in blocks]
        inner = "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, blocks, strict=True))
        page = WRAP.format(f'<nav>{"<a href=x>menu item</a> " * rng.randrange(40)}</nav><article>{inner}</article><div class="comments">{LONG * rng.randrange(20)}</div>')
        assert text(page) == "\n\n".join(b.replace("&lt;", "<") for b in blocks)


def test_path_values():
    # two paths: long blocks with marks, short ones all links
    value = html_extract.path_values([1, 1, 2], [100, 80, 20], [4, 2, 0], [0, 0, 20], [-1, 0, 0])
    assert value[2] == 0 and value[1] > 50
