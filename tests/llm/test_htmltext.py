"""Main text of pages: written pages with their text, generated ones against the list of their blocks, broken markup."""

import html
import random
import time

import pytest

from millrace.llm.htmltext import extract_text, main_text

LONG = "A paragraph that is long enough for anyone to see that it belongs to the main text of the page, and to nothing else."
PAGES = [
    ("<article><h1>T</h1><p>a <b>b</b>\n c<p>d&amp;e &lt;x&gt; &copy; &#233;</article><footer>f</footer>", ["T", "a b c", "d&e <x> © é"]),
    ("<nav>n</nav><main><h2>T</h2><div class='ad'>buy</div><p>one<br>two<br><br>three</p></main>", ["T", "one two", "three"]),
    ("<article><header><h1>T</h1></header><p>x</p><aside>y</aside><form>z</form><section id=comments><p>c</p></section></article>", ["T", "x"]),
    ("<article>a<article class='comment'>c</article>b</article>", ["a", "b"]),
    ("<article>one<script>if (a < b) '<p>x</p>'</script><style>p{}</style><!-- <p>no</p> -->two</article>", ["onetwo"]),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p></p></article>", ["a", "b", "c", "d"]),
    ("<article><p><a href=x>only a link</a></p><p><a>and one more</a></p><p><a>and a third</a></p><p><a>and a fourth</a></p></article>", ["only a link", "and one more", "and a third", "and a fourth"]),
    (f"<body class='has-sidebar'><header>h</header><div><a>m</a><a>n</a></div><div class=content><h2>T</h2><p>{LONG}</p><p>Short.</p></div><div class='site-footer'>f</div>", ["T", LONG, "Short."]),
    (f"<div id=cookieBanner>{LONG}</div><p>{LONG}</p><div role=contentinfo>{LONG}</div>", [LONG]),
    (f"<p>{LONG}</p><div><a>x</a></div><div><a>x</a></div><div><a>x</a></div><div><a>x</a></div><p>lonely</p>", [LONG]),
    (f"<div class=newsletter><p>x</p><div>y</div></div><p>{LONG}</p><p>{LONG}", [LONG, LONG]),
    ("<p>only this", ["only this"]),
    ("text without markup &amp; more", ["text without markup & more"]),
    ("<ARTICLE><P CLASS=x>A</P></ARTICLE>", ["A"]),
    ("<article><p title='a > b'>x</p><p title=it's>y</p></article>", ["x", "y"]),
    ("<article><p>cut <a href=", ["cut"]),
    ("<article><p>a</p></div></span><p>b</article>", ["a", "b"]),
    ("<article>&am &ampx &unknown; &#xD800; a &lt; b</article>", ["&am &x &unknown; � a < b"]),
    ("<nav>n</nav><footer>f</footer>", []),
    ("<script>never ended <p>x</p>", []),
    ("", []),
    (" \n\t ", []),
    ("<>< > a <3 b", ["<>< > a <3 b"]),
]


@pytest.mark.parametrize("page, blocks", PAGES)
def test_written_pages(page, blocks):
    assert main_text(page) == blocks


def generated(r, marked):
    """A page and its blocks: paragraphs, headings, lists and parts that don't belong to it, some tags left open."""
    blocks, body = [], []
    words = lambda n: html.escape(plain(n))
    plain = lambda n: " ".join(r.choice(["lorem", "Ünter", "a&b", "x<y", '"q"', "été", "it's"]) for _ in range(n))
    for _ in range(r.randint(1, 12)):
        t = plain(r.choice([1, 4, 30])) if marked else plain(30)
        blocks.append(t)
        name = r.choice(["p", "h2", "div", "blockquote"])
        inner = html.escape(t, quote=r.random() < 0.5).replace(" ", r.choice([" ", "\n  ", " <i> </i>"]), 1)
        body.append(f"<{name} class='x{r.randrange(9)}'>{inner}" + ("" if name == "p" and r.random() < 0.3 else f"</{name}>"))
        if r.random() < 0.4:
            junk = plain(40)
            body.append(r.choice(["<div class='ad-box'><p>{}</p></div>", "<aside><div>{}</div></aside>", "<form><input name=a>{}</form>", "<div id='user-comments'><p>{}<p>{}</div>", "<!-- {} -->", "<nav><ul><li><a href='/'>{}</a></ul></nav>"]).replace("{}", html.escape(junk)))
    inner = "".join(body)
    inner = f"<article>{inner}</article>" if marked else f"<div class=content>{inner}</div>"
    return f"<!doctype html><html><head><title>{words(3)}</title><meta charset=utf-8><script>var a='<p>'</script></head><body><header><p>{words(40)}</header>{inner}<footer>&copy; {words(30)}</footer></body></html>", blocks


@pytest.mark.parametrize("marked", [True, False])
def test_generated_pages(marked):
    r = random.Random(6)
    for _ in range(300):
        page, blocks = generated(r, marked)
        assert main_text(page) == blocks


def test_table_of_pages(spark):
    rows = [(i, f"u{i}", p, "t", 1) for i, (p, _) in enumerate(PAGES)] + [(50, None, None, "t", 1), (None, "u", "<p>x", "t", 1), (3, "u3", PAGES[3][0], "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(3)
    want = [(i, u, "\n".join(main_text(p or ""))) for i, u, p, *_ in rows]
    got = [tuple(r) for r in extract_text(pages).collect()]
    assert sorted(got, key=repr) == sorted([(*w, len(w[2])) for w in want], key=repr)
    none = spark.createDataFrame([], pages.schema)
    assert extract_text(none).columns == ["page_id", "url", "text", "n_chars"] and extract_text(none).isEmpty()


def test_time_grows_with_length():
    started = time.monotonic()
    for page in ("<a " * 200_000, '<a ="' * 200_000 + ">", "<p><b>" * 50_000 + "x", "<div>" * 50_000 + "</p>" * 50_000, "<!--" * 200_000, "&" * 200_000, "<p>" + "word " * 2_000_000 + "</p>"):
        main_text(page)
    assert time.monotonic() - started < 60
