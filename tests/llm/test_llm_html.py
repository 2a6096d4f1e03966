"""Main text of pages."""

import html

import pytest

from wearline.llm.common import table
from wearline.llm.html_text import kept_lines, main_text

LONG = "long text here " * 12


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("a < b", "a < b"), ("<script>x", ""), ("<!-- never closed <p>x", ""),
    ("<article><h1>T</h1><p>one<br>two\n three<p>four &amp; &lt;five&gt;</article>", "T\n\none two three\n\nfour & <five>"),
    ("<nav>menu</nav><article><p>x</p></article><footer>f</footer>", "x"),
    ("<article><p class='notice'>n<p>one<p>two</article><div id=comments><p>bad</div>", "one\n\ntwo"),
    ("<main><header><h1>Head</h1></header><p>x</p><aside>side<p>more</p></aside><p>end</p></main>", "Head\n\nx\n\nend"),
    ("<ARTICLE><H1>T</H1><FORM>f <input></FORM><TABLE><TR><TD>a<TD>b</TABLE>", "T\n\na b"),
    ("<header>site</header><article>x<div class='ad-box'>buy<div>now</div></div>y</article>", "x\n\ny"),
    ("<article><p>a<style>p{}</style>b<script>var t='</p>';</script>c</p></article>", "a b c"),
    ("<article><p title='a>b'>x</p><div style='display:none'>h</div></article>", "x"),
    ("<head><title>t</title><body><article>x", "x"),
])
def test_cases(page, text):
    assert main_text(page) == text


def test_surge_and_dive_points_without_a_named_article():
    page = (f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><a href=3>More</a></div>"
            f"<p>{LONG}</p><p>{LONG}</p><p>end.</p><div class=sidebar>side</div><p>{LONG}</p></body>")
    assert main_text(page) == "\n\n".join([LONG.strip(), LONG.strip(), "end.", LONG.strip()])


BODY = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
TEXT = "\n\n".join([LONG.strip()] * 2)
CARDS = "<article><h3>Card</h3><p>teaser words</p></article>" * 3


@pytest.mark.parametrize("page", [
    f"{BODY}<div class=comments><article class=comment><p>{LONG}reader</p></article></div>",
    f"{BODY}<article class=comment><p>{LONG}reader</p></article>",
    f"<aside>{CARDS}</aside>{BODY}",
    f"{BODY}<div class=related>{CARDS}</div>",
    f"<article>{BODY}<article class=comment><p>reader</p></article></article>",
    f"<article>{BODY}<div id=comments><article><p>reader</p></article><p>more</p></div></article>",
    f"<nav>menu<article>{BODY}</article><footer><nav>more</nav></footer>",  # the first is never closed
])
def test_article_marks_within_boilerplate_name_nothing(page):
    assert main_text(page) == TEXT


def test_article_marks_are_outweighed_by_the_text_beside_them():
    assert TEXT in main_text(f"{BODY}<div>{CARDS}</div>")
    assert main_text(f"<article>{BODY}</article><div><p>{LONG}</p></div>") == TEXT


@pytest.mark.parametrize("page,text", [
    (f"<div class='content has-sidebar'>{BODY}</div>", TEXT),
    (f"<div class='content no-sidebar'>{BODY}<div class=sidebar>side<p>{LONG}</div></div>", TEXT),
    (f"<div class=widget>{BODY}<div class='widget ad'>buy</div></div><p>foot</p>", TEXT),
    (f"<article><div class=post-header><h1>Head</h1></div><h2 class=section-header>One</h2>{BODY}</article>",
     "Head\n\nOne\n\n" + TEXT),
    (f"<article><h2 class='notice-periods'>Notice</h2>{BODY}</article>", "Notice\n\n" + TEXT),
    (f"<article><p>{LONG}</p><section class=related-work><p>{LONG}</p></section></article>", TEXT),
    (f"<div><p>{LONG}</p><section id=search><p>{LONG * 2}</p></section></div>", LONG.strip() + "\n\n" + (LONG * 2).strip()),
    ("<article><pre>x = 1 <span class='token comment'># one</span></pre></article>", "x = 1 # one"),
    (f"<article>{BODY}<div class='related-reading'><ul><li><a href=1>{LONG}</a></ul></div></article>", TEXT),
    (f"{BODY}<div class=comment-list><p>{LONG * 2}</p></div><div class=site-footer>All rights reserved</div>", TEXT),
    (f"<table><tr><td class=sidebar>side<td><p>{LONG}</p><p>{LONG}</p></table>", TEXT),
])
def test_marks_are_evidence(page, text):
    assert main_text(page) == text


COMMENTS = f"<p>{LONG}reader</p>" * 4


@pytest.mark.parametrize("page", [
    f"<article><h1>Title</h1><p>{'short text ' * 6}</p></article><div id=comments>{COMMENTS}</div>",
    f"<div><h1>Title</h1><p>{'short text ' * 6}</p></div><div id=comments>{COMMENTS}</div>",
    f"<div class='cookie-notice'>{COMMENTS}</div><article><h1>Title</h1><p>{'short text ' * 6}</p></article>",
    f"<article><h1>Title</h1><p>{'short text ' * 6}</p><div class='notice'><p>{LONG * 3}</p></div></article>",
    f"<div><h1>Title</h1><p>{'short text ' * 6}</p></div><section class='reader-comments'>{COMMENTS}</section>",
    f"<div><h1>Title</h1><p>{'short text ' * 6}</p></div><div class='google-ads'>{COMMENTS}</div>",
    f"<article><h1>Title</h1><p>{'short text ' * 6}</p></article><div class=sidebar>{COMMENTS}</div><div class=menu>{COMMENTS}</div>",
    f"<div><h1>Title</h1><p>{'short text ' * 6}</p></div><div class=sidebar>{COMMENTS}</div>",
])
def test_short_articles_beside_long_comments_and_notices(page):
    assert main_text(page) == "Title\n\n" + ("short text " * 6).strip()


def test_window_sums():
    lines = [("ab", 0, False), ("", 0, False), ("", 0, False), ("", 0, False), ("x" * 50, 0, False), ("y", 0, False)]
    assert kept_lines(lines, window=3, surge=30, share=0.9) == ["x" * 50, "y"]
    assert kept_lines([("ab", 0, True), *lines[1:]], window=3, surge=30, share=0.9) == ["ab"]


def test_every_page_gives_its_article(spark, sf):
    """The given pages hold texts of ``documents``, a block for each line."""
    known = {"\n\n".join(b for line in (r.text or "").split("\n") if (b := " ".join(line.split())))
             for r in table(spark, sf, "documents").collect()}
    for r in table(spark, sf, "pages").collect():
        title, _, rest = main_text(r.html).partition("\n\n")
        assert rest in known and html.unescape(title)
