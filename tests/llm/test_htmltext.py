from __future__ import annotations

import html as entities
import re

import pytest

from lociweave.llm import htmltext

SENTENCE = "The river is wide and it was cold in the morning, so that we had to wait for the boat to come over with the others. "


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("part", ["<nav><ul><li><a href=/>Home</a></ul></nav>", "<header><h1>Site</h1></header>", "<footer>&copy; us</footer>", "<aside><p>{s}</p></aside>", '<div class="ad">{s}{s}</div>', '<div id="sideBar" class="side-bar sidebar"><p>{s}{s}</p></div>', '<div class="cookie-notice"><p>{s}{s}</p></div>', "<form><label>Mail</label><input name=x><p>{s}</p></form>", '<section id="comments"><article class="comment"><p>{s}{s}</p></article></section>', '<p hidden>{s}</p>', '<p style="display: none">{s}</p>', "<script>if (a<b) {s}</script>", "<style>{s}</style>", "<!-- {s} -->", "<noscript>{s}</noscript>", '<ul class="social share"><li>{s}</ul>'])
@pytest.mark.parametrize("inside", [True, False])
def test_parts_that_are_never_main_text(part, inside):
    part = part.format(s=SENTENCE)
    if inside and part.startswith("<header"):
        return  # an article's own header
    body = f"<h1>Head</h1><p>{SENTENCE * 2}</p>{part if inside else ''}<p>Short one.</p><p>{SENTENCE}</p>"
    got = htmltext.main_text(page((part if not inside else "") + f"<article>{body}</article>" + (part if not inside else "")))
    assert got == "\n".join(["Head", (SENTENCE * 2).strip(), "Short one.", SENTENCE.strip()])


def test_undecided_blocks_go_by_their_neighbours():
    """Without an article element: short blocks between good ones stay, those between bad ones and at the ends go."""
    body = f"<p>Top</p><p>{SENTENCE * 2}</p><h2>Between</h2><p>Short.</p><p>{SENTENCE * 2}</p><p>x</p><p><a href=/>{SENTENCE}</a></p><p>After</p>"
    assert htmltext.main_text(page(body)).split("\n") == [(SENTENCE * 2).strip(), "Between", "Short.", (SENTENCE * 2).strip()]
    long = "qpzx wvut rsnm " * 20
    assert htmltext.main_text(page(f"<div>{long}</div>")) == "" and htmltext.main_text(page(f"<main>{long}</main>")) == long.strip()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain", ""), ("<article>a &lt;b&gt; &amp;amp; &#65;&#x42;&nbsp;c &copy &euro</article>", "a <b> &amp; AB c © &euro"), ("<article><p>a<p>b<br>c <i>d</i>e</article>", "a\nb c de"), ("<article><p>cut &am", "cut &am"), ("<article><p>cut <im", "cut"),
        ("<article><p><b>one<br><p>two</article>", "one\ntwo"), ("<article><h1>H</h1><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "H\nx\ny\n1\n2"), ("<article></p></div>x</article></article>", "x"), ("<head><title>t</title><article>no end of head</article>", "no end of head"),
        ("<article>a<!-- x -->b<!-- open", "ab"), ("<div class='has-sidebar'><main>m</main></div>", "m"), ("<ARTICLE><P>Up", "Up"),
    ],
)
def test_markup(html, want):
    assert htmltext.main_text(html) == want


def test_pages_of_the_table(spark):
    """Every page's text is that of its article element, cut by a plain expression."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    got = htmltext.extracted(pages, ["page_id", "url"]).collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", rows[r["page_id"]], re.S)[1]
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert r["text"] == "\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    long = "<article>" + f"<p>{SENTENCE}</p>" * 20_000
    rows = [(None, None, None, "t", 1), (1, "u", "", "t", 1), (2, "u", long, "t", 1), (2, "u", long, "t", 1), (3, "u", "<div>" * 50_000 + "<article>deep", "t", 1)]
    got = htmltext.extracted(spark.createDataFrame(rows, schema), ["page_id", "url"])
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = "\n".join([SENTENCE.strip()] * 20_000)
    assert sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == [(0, ""), (1, ""), (2, want), (2, want), (3, "deep")]
    assert htmltext.extracted(spark.createDataFrame([], schema), ["page_id"]).count() == 0
