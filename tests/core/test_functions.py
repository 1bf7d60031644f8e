import html

import pytest
from pyspark.sql import functions as F

from quillmill.functions import dates, text, urls


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cells.items()) or "x string"
    return spark.createDataFrame([tuple(cells.values()) or ("x",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw", ["a &amp; b", "&lt;p&gt; &eacute;&#233;&#xE9; &#128512;", "no & reference &; &unknown; &#; &#x110000;", "&amp;amp; &apos;&quot;&nbsp;", None, ""])
def test_unescape_equals_the_standard_library(spark, raw):
    want = html.unescape(raw or "").replace("�", "&#x110000;")
    assert value(spark, text.unescape("c"), c=raw) == want


def test_clean_text_modes(spark):
    raw = "<p>One&nbsp;&amp;  two<br/>three</p><script>x</script>\n\n\n\nfour \x01"
    assert value(spark, text.clean_text("c", "feed"), c=raw) == "One\xa0& two\nthree\nfour"
    assert value(spark, text.clean_text("c", "page"), c="<b>a</b> <i>b</i>") == "a b"
    assert value(spark, text.clean_text("c", "plain", 5), c="abcd efgh") == "abcd..."
    assert value(spark, text.clean_text("c", "document"), c="a\r\nb\rc") == "a\nb\nc"
    assert value(spark, text.clean_text("c", "block"), c="<nav>menu</nav><div>a</div><div>b</div>") == "a\nb"
    assert value(spark, text.clean_text("c", "feed"), c=None) == ""


def test_ids_lists_slugs_and_titles(spark):
    import hashlib

    assert value(spark, text.stable_id("item", "a", "b", "c"), a="x", b=None, c="z") == "item-" + hashlib.sha1(b"x||||z").hexdigest()[:16]
    assert value(spark, text.split_list("c"), c="a, b，c\n\n d ,") == ["a", "b", "c", "d"]
    assert value(spark, text.slugify("c"), c="# Größe: *Open*  Data — 2024!") == "grösse-open-data-2024"
    assert value(spark, text.slugify("c"), c="!!!") == "page"
    assert value(spark, text.markdown_title("c"), c="intro line\n# The *Title*\nx").heading == "The Title"
    assert value(spark, text.first_paragraph("c", F.lit("T")), c="T\n\nshort\n\n" + "word " * 12) == ("word " * 12).strip()
    links = value(spark, text.extract_links("c"), c="see [One](https://a.org/1) and [Two](http://b.org/x?y=1)\n[no](ftp://c)")
    assert [(x.title, x.url) for x in links] == [("One", "https://a.org/1"), ("Two", "http://b.org/x?y=1")]


def test_languages(spark):
    assert value(spark, text.infer_language("c"), c="short") == ""
    assert value(spark, text.infer_language("c"), c="這是一個關於開放資料的長文章" * 10) == "zh"
    assert value(spark, text.infer_language("c"), c="これはひらがなのながいぶんしょうです" * 8) == "ja"
    assert value(spark, text.infer_language("c"), c="한국어로 된 긴 문장입니다 " * 12) == "ko"
    assert value(spark, text.infer_language("c"), c="this line has many plain words " * 10) == "en"
    for tag, want in [("zh_TW", "zh-Hant"), ("zh-cn", "zh-Hans"), ("EN-us", "en"), ("ja", "ja"), ("", ""), (None, "")]:
        assert value(spark, text.normalize_language("c"), c=tag) == want


def test_code_prompts_and_identifiers(spark):
    assert value(spark, text.is_code_like("c"), c="window.x = function(){ return [1]; };")
    assert not value(spark, text.is_code_like("c"), c="A plain paragraph about windows and functions in a house.")
    assert value(spark, text.is_access_prompt("c"), c="Just a moment... Enable JavaScript and cookies to continue")
    assert not value(spark, text.is_access_prompt("c"), c="Enable JavaScript and cookies to continue " + "word " * 300)
    i = value(spark, text.extract_identifiers("c"), c="Authors: A. *Writer*\nhttps://a.org/x. https://a.org/x, doi 10.1000/abc.1; arXiv: 2401.01234v2")
    assert (i.urls, i.dois, i.arxiv_ids, i.author) == (["https://a.org/x"], ["10.1000/abc.1"], ["2401.01234v2"], "A. Writer")
    assert value(spark, text.length_drift_ok("a", "b"), a="x" * 100, b="x" * 110) and not value(spark, text.length_drift_ok("a", "b"), a="x" * 100, b="x" * 120)
    assert value(spark, text.check_sections(F.lit("one a two b three c"), F.array(F.lit("one"), F.lit("two"), F.lit("zzz")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == 2


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Example.ORG/a/?utm_source=x&b=1&ref=q#frag", "http://example.org/a/?b=1"), ("https://a.org/x/", "https://a.org/x"), ("https://www.google.com/url?q=https://b.org/y%3Fz%3D1&sa=t", "https://b.org/y?z=1"),
        ("https://a.org/x?a=%20b&c", "https://a.org/x?a=+b&c="), ("Not A URL", "not a url"), ("", ""), (None, ""), ("https://münchen.de/a b", "https://münchen.de/a b"),
    ],
)
def test_normalize_url(spark, raw, want):
    assert value(spark, urls.normalize_url("c"), c=raw) == want


def test_join_url(spark):
    for link, want in [("/f", "https://a.org/f"), ("f", "https://a.org/d/f"), ("//b.org/f", "https://b.org/f"), ("http://c.org", "http://c.org")]:
        assert value(spark, urls.join_url(F.lit("https://a.org/d/e?x"), "c"), c=link) == want
    assert value(spark, urls.loose_url_key("c"), c="HTTPS://A.org/x/?q#f") == "a.org/x"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Wed, 02 Oct 2002 13:00:00 GMT", "2002-10-02 13:00:00"), ("2 Oct 2002 15:00:00 +0200", "2002-10-02 13:00:00"), ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"), ("2024-01-05T10:00:00+02:00", "2024-01-05 08:00:00"),
        ("2024-01-05", "2024-01-05 00:00:00"), ("on 2024/1/5 or so", "2024-01-05 00:00:00"), ("2024-13-40", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_parse_any_date(spark, raw, want):
    got = value(spark, dates.parse_any_date("c"), c=raw)
    assert (str(got) if got else None) == want


def test_other_dates(spark):
    assert str(value(spark, dates.parse_any_date("c", serials=True), c="45000"))[:10] == "2023-03-15"
    assert str(value(spark, dates.parse_page_date("c"), c="March 3rd, 2021")) == "2021-03-03"
    assert str(value(spark, dates.date_in_path(F.col("c")), c="/news/2024/02/03/slug")) == "2024-02-03"
    assert str(value(spark, dates.date_in_path(F.col("c")), c="/2024-02-03-some-slug")) == "2024-02-03"
    assert str(value(spark, dates.epoch_date("c"), c="1700000000000"))[:10] == "2023-11-14"


def test_terms(spark):
    assert value(spark, text.match_terms(text.fold("c"), ["Straße", "Open", "", "none", "open"]), c="An OPEN strasse") == ["Straße", "Open", "open"]
    assert value(spark, text.match_terms(text.fold("c"), F.col("t")), c="abc", t=["B", "x", "B"]) == ["B"]
