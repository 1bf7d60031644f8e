import random
import time

import pytest
from quillmill.llm import html

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">One</a></li></ul></nav>
<!-- x --><div class="ad">Buy the best of all the things that you want for your house now.</div><article><header><h1>Head &amp; line</h1></header>
<p><b>Short.<br><p>The  first&nbsp;paragraph of\nthe text &lt;here&gt; is this.<p>Is.</p><div class="related-links"><p>The other story that you may like to read.</p></div>
<form><input><label>The name of the user is wanted</label></form><p>See <a href="x">this</a> and that for the rest of it.</p></article>
<aside>The side of the page is here.</aside><div id="comments"><p>I like this article and all of the others that you wrote.</p></div>
<div class="cookie-notice">We use cookies for the good of the site.</div><footer>&copy; 2024</footer>"""


def test_article_without_its_surroundings():
    assert html.main_text(ARTICLE) == "Head & line\nShort.\nThe first paragraph of the text <here> is this.\nIs.\nSee this and that for the rest of it."


def test_two_passes_on_a_page_without_marks():
    long = "The quality of the text is what it is, and that is not to be changed by any of the rules which are in the book. " * 3
    page = f"<body><div><a href='/'>Home</a> <a href='/x'>All pages</a></div><h1>A title</h1><p>{long}</p><p>Yes.</p><p>{long}</p><div>Sign up</div><div>Contact © 2020</div></body>"
    assert html.main_text(page).split("\n") == ["A title", long.strip(), "Yes.", long.strip()]


def test_odd_pages():
    assert [html.main_text(x) for x in (None, "", "<", "<p", "<!-- open", "<script>x", "<article><p>a<b", "<article>x</p></div>y</article>z")] == ["", "", "", "", "", "", "a", "x\ny"]
    assert html.main_text("<article><p>&am; &copy; &#8364; &amp;lt;</p></article>") == "&am; © € &lt;"
    assert html.main_text("<article><p>" + "word " * 200_000 + "</p></article>").count("word") == 200_000


def test_columns(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE, "t"), (1, "u", ARTICLE, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html.extract(pages).collect()
    assert [r.n_chars for r in rows if r.page_id is None] == [0] and len(rows) == 3
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html.extract(pages.limit(0)).count() == 0


def test_undecided_blocks_on_a_page_without_marks():
    long = "The quality of the text is what it is, and that is not to be changed by any of the rules which are in the book. " * 3
    table = "Helsinki 1952, Melbourne 1956, Roma 1960, Tokyo 1964, Mexico 1968, Munich 1972"
    page = f"<body><div><a href='/'>Home</a></div><p>{long}</p><p>Then see <a href='/n'>note</a> for it.</p><p>{long}</p><div>{table}</div><p>{long}</p><div>{table}</div><div>Read <a href='/m'>more</a></div></body>"
    assert html.main_text(page).split("\n") == [long.strip(), "Then see note for it.", long.strip(), table, long.strip()]


def test_other_languages_on_a_page_without_marks():
    long = "Suomen kieli kuuluu uralilaisiin kieliin ja sen puhujia on noin viisi miljoonaa Suomessa sekä muissa maissa. " * 3
    page = f"<body><div><a href='/'>Etusivu</a></div><p>{long}</p><p>Lyhyt.</p><p>{long}</p><div><a href='/x'>Haku</a></div></body>"
    assert html.main_text(page).split("\n") == [long.strip(), "Lyhyt.", long.strip()]


SENTENCE = "The quality of the text is what it is, and that is not to be changed by any of the rules which are in the book."
THREE = f"<p>{SENTENCE}</p>" * 3


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="has-sidebar content"><article>{THREE}</article></div>',
        f'<article class="post comments-open">{THREE}</article>',
        f'<div class="elementor-widget-theme-post-content"><article>{THREE}</article></div>',
        f'<div class="elementor-widget-theme-post-content">{THREE}</div><div class="ad">Buy this now</div>',
        f"<article><svg><path/>{THREE}</article>",
        f"<article><video>{THREE}",
        f"<article><object data=x>{THREE}<select><option>one</select></article>",
        f"<article><noscript>{THREE}</article>",
        f'<article class="teaser"><p>Read the other one.</p></article><div id="story">{THREE}</div>',
        f'<main>{THREE}<div id="comments">{THREE * 5}</div></main>',
        f'{THREE}<div id="comments">{THREE * 5}</div>',
        f'<form id="all">{THREE}</form>',
        f'<header><a href="/">Home</a><main>{THREE}</main>',
        f'<nav><a href="/">Home</a><article>{THREE}</article>',
        f'<div class="page sidebar-left"><article>{THREE}</article><div class="related"><article>{THREE}</article></div></div>',
        f'<a href="/x"><div><p>{SENTENCE}</p></div></a>{THREE}<a href="/y"><h2>{SENTENCE}</h2></a>',
        f'<a href="/open">{THREE}<a href="/x">Next</a>',
    ],
)
def test_marks_are_evidence_and_text_decides(page):
    assert html.main_text(page).split("\n") == [SENTENCE] * 3


def random_page(seed):
    """A page of known main text: paragraphs, headings, lists and short lines, with and without marks, among menus, adverts, forms and comments."""
    r = random.Random(seed)
    good = lambda: " ".join(r.choice(["the of and a to in is it that this with for on".split(), "house water garden story number evening".split()][r.random() < 0.55]) for _ in range(r.randrange(45, 90)))
    body, text = [], []
    for k in range(r.randrange(3, 9)):
        kind = r.choice(["p", "p", "p", "h2", "short", "linked"]) if 0 < k else "p"
        x = good()
        if kind in ("short", "h2"):
            x = f"Part {k}"
            body.append(f"<{'h2' if kind == 'h2' else 'p'}>{x}")
            text.append(x)
            x = good()
        body.append(f"<p>{x[:40]}<a href='/w'>{x[40:60]}</a>{x[60:]}</p>" if kind == "linked" else f"<p>{x}</p>")
        text.append(x)
    links = "".join(f"<li><a href='/{k}'>{good()[: r.randrange(5, 90)]}</a></li>" for k in range(5))
    junk = [f"<nav><ul>{links}</ul></nav>", f"<div><ul>{links}</ul></div>", f"<footer>{good()}</footer>", f"<aside>{good()}</aside>", f"<div class='ad'>{good()}</div>", f"<div id=comments><p>{good()}</p></div>", f"<form><p>{good()}</p></form>", f"<script>'<p>{good()}</p>'</script>"]
    around = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class='with-sidebar'><article>{}</article></div>", "<div>{}</div>", "<div class='post-widget'><main>{}</main></div>"])
    before, after = r.sample(junk, 3), r.sample(junk, 3)
    return f"<html><head><title>x</title></head><body>{''.join(before)}{around.format(''.join(body))}{''.join(after)}</body></html>", text


def test_random_pages_of_known_text():
    for seed in range(300):
        page, text = random_page(seed)
        assert html.main_text(page).split("\n") == text, seed


def test_blocks_and_second_pass_decide_without_the_list_of_names(monkeypatch):
    monkeypatch.setattr(html, "NAMES", frozenset())
    monkeypatch.setattr(html, "COMMENTS", frozenset())
    page = f"<div class=menu><a href='/'>Home</a> <a href='/x'>All</a></div><div class=ad>Buy now</div><article><h1>Title</h1><p>Yes.</p>{THREE}<p>No.</p></article><div class=notice>We use cookies</div>"
    assert html.main_text(page).split("\n") == ["Title", "Yes.", *[SENTENCE] * 3, "No."]


def test_odd_pages_take_linear_time():
    start = time.time()
    for page in ["<div>" * 50_000 + "</section>" * 50_000, "<div class=ad>" * 50_000 + THREE, "<noscript>" * 50_000, "<a href=x>" * 50_000, "<svg>" * 50_000, "<p class=ad>x" * 20_000 + THREE]:
        html.main_text(page)
    assert time.time() - start < 60
