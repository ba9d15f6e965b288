"""Main text of hand-written pages."""

import pytest

from toolwarden.llm import html as H

LEAD = "The river rises in the hills, crosses two counties, and reaches the sea after ninety miles."
REST = "Its mills, locks and ferries were busy until the railway came, and few of them remain today."
MORE = "Walkers follow the old towpath, which is open all year, to the ruins of the last mill."
WANT = f"A river\n\n{LEAD}\n\n{REST}"


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>A river</h1><p>{LEAD}</p><p>{REST}</p></article>",
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav>"
        f"<div class=ad>Buy, buy, buy this wonderful thing now, today</div><article><h1>A river</h1><p><b>{LEAD}<br><p>{REST}</article>"
        f"<footer>&copy; us</footer>",
        f"<body><header><h2>Site name</h2></header><div id=content><h1>A river</h1><p>{LEAD}</p><script>var p='<p>x</p>';</script>"
        f"<p>{REST}</p></div><aside><p>{MORE}</p></aside><div class='comments'><p>{MORE}</p><p>{MORE}</p></div></body>",
        f"<main><h1>A  river\n</h1><p>{LEAD.replace(' ', '&#32;&nbsp;')}</p><form><input><p>{MORE}</p></form><p>{REST}</p>"
        f"<div class='cookie-notice'>{MORE}</div></main>",
        f"<div class=wrap><div class='post-body'><h1>A river</h1><div><p>{LEAD}</p></div><div><p>{REST}</p></div></div>"
        f"<div class='sidebar widget'><p>{MORE}</p></div><ul class=menu><li><a href=1>one</a></li></ul></div>",
    ],
)
def test_articles(page):
    assert H.main_text(page) == WANT


def test_siblings_and_links():
    links = "".join(f"<li><a href={i}>{MORE}</a></li>" for i in range(20))
    page = f"<body><div><p>{LEAD}</p><p>{REST}</p><p>{MORE}</p></div><ul>{links}</ul></body>"
    assert H.main_text(page) == f"{LEAD}\n\n{REST}\n\n{MORE}"


def test_short_blocks_lists_and_tables_stay():
    page = f"<article><p>{LEAD}</p><p>Yes.</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>x\n y</pre><p>{REST}</p></article>"
    assert H.main_text(page).split("\n\n") == [LEAD, "Yes.", "one", "two", "a", "b", "x y", REST]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("a &lt; b &amp;amp; c", "a < b &amp; c"),
        ("<div hidden>x</div>y", "y"), ("<a title='a>b'>t</a>", "t"), ("<p>a<!-- c --> b", "a b"), ("<script>never ends", ""),
        ("x < y and <b>bold", "x < y and bold"), ("<p>one<p>two", "one\n\ntwo"),
    ],
)
def test_small_pages(page, want):
    assert H.main_text(page) == want


LONG = "".join(f"<p>{LEAD} {REST}</p>" for _ in range(30))
LONG_WANT = [f"{LEAD} {REST}"] * 30


@pytest.mark.parametrize("open_", ["article", "main", "div", "div class=content", "main><div", "main><div><div"])
@pytest.mark.parametrize("name", ["section", "div", "figure", "details", "h5", "h6", "blockquote"])
def test_uneven_sections_stay(open_, name):
    page = f"<body><nav><a href=x>Home</a></nav><{open_}><section>{LONG}</section><{name}>{LEAD}</{name}><{name}>Yes.</{name}></div></main></body>"
    assert H.main_text(page).split("\n\n") == [*LONG_WANT, LEAD, "Yes."]


def test_parts_of_a_main_stay():
    page = f"<body><nav><a href=x>Home</a></nav><main><div><article>{LONG}</article><hr><article><p>{MORE}</p></article></div><div>Yes.</div></main>"
    assert H.main_text(page).split("\n\n") == [*LONG_WANT, MORE, "Yes."]
    page = f"<nav><a href=x>Home</a></nav><div id=content><div><section>{LONG}</section></div><div class=ad>buy</div><div>{MORE}</div></div>{REST}<footer>f</footer>"
    assert H.main_text(page).split("\n\n") == [*LONG_WANT, MORE]
    page = f"<nav><a href=x>Home</a></nav><section>{LONG}</section><section>{LEAD}</section><h5>{MORE}</h5><div>Slogan</div>"
    assert H.main_text(page).split("\n\n") == [*LONG_WANT, LEAD, MORE]


@pytest.mark.parametrize("open_", ["article", "main", "div", "body", ""])
def test_loose_text_and_definitions_stay(open_):
    page = f"{f'<{open_}>' if open_ else ''}Before<section>{LONG}</section><dl><dt>a</dt><dd>b</dd></dl>between<div>Short</div>after"
    assert H.main_text(page).split("\n\n") == ["Before", *LONG_WANT, "a", "b", "between", "Short", "after"]


def test_parts_left_out_stay_out_beside_uneven_sections():
    links = "".join(f"<li><a href={i}>{MORE}</a></li>" for i in range(9))
    page = f"<body><div>Slogan of the site</div><main><div><section>{LONG}</section><section><p>{MORE}</p></section><ul>{links}</ul></div>"
    page += f"<div class=sidebar>{MORE}</div></main><div><ul>{links}</ul></div><div>All rights reserved</div></body>"
    assert H.main_text(page).split("\n\n") == [*LONG_WANT, MORE]
    page = page.replace("<main>", "<div>").replace("</main>", "</div>")
    assert H.main_text(page).split("\n\n") == [*LONG_WANT, MORE]


@pytest.mark.parametrize(
    "code",
    ["for(i=0;i<n;i++){f()}", "if(a<b&&c)d()", "s='<!--'", "x='<![CDATA['", "x<y", "a='<b title=\"'", "x='<p>x</p></b>'", "i<n</script ><script>j<m"],
)
def test_text_after_raw_elements_stays(code):
    want = f"{LEAD}\n\n{REST}\n\n{MORE}"
    assert H.main_text(f"<article><p>{LEAD}</p><script>{code}</script><p>{REST}</p><p>{MORE}</p></article>") == want
    assert H.main_text(f"<article><p>{LEAD}</p><SCRIPT>{code}</Script\n><p>{REST}</p><style>a<b</style><p>{MORE}</p></article>") == want
    assert H.main_text(f"<script>{code}</script>text") == "text"


def test_bad_markup_takes_linear_time():
    assert H.main_text("<a '" * 50_000) is not None
    assert H.main_text("<div>" * 50_000 + LEAD) == LEAD
    assert H.main_text("<!--" * 50_000) == ""


def test_rows(spark):
    rows = [(1, "u", None, "k"), (1, "u", None, "k"), (None, None, f"<p>{LEAD}", "k"), (2, "v", "<p>é👩", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in H.extract(pages).collect()))
    assert got == [(0, LEAD, len(LEAD)), (1, "", 0), (1, "", 0), (2, "é👩", 2)]
    assert H.extract(pages.limit(0)).collect() == [] and H.extract(pages).columns[:4] == pages.columns
