"""Metadata and main text of stored pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html import unescape as decode

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.batches import slabs
from quillmill.functions.dates import date_in_path, parse_page_date
from quillmill.functions.text import CODE_LINE, CODE_WORDS, PROMPT, clean_text, fold, infer_language, is_access_prompt, let, normalize_language, text, unescape
from quillmill.functions.urls import host, join_url, path
from quillmill.operators.summaries import BOILERPLATE

# The meta names that carry each piece of metadata, in order of trust.
META = {
    "author": ("author", "article:author", "twitter:creator", "dc.creator", "dcterms.creator", "parsely-author"),
    "published": ("article:published_time", "article:published", "og:published_time", "pubdate", "publishdate", "date", "dc.date", "dcterms.created", "dcterms.issued", "parsely-pub-date", "sailthru.date", "shareaholic:article_published_time"),
    "license": ("license", "dc.rights", "dcterms.rights", "rights", "copyright"),
    "language": ("og:locale", "language", "content-language", "dc.language", "dcterms.language"),
    "title": ("og:title", "twitter:title"),
    "image": ("og:image", "og:image:url", "twitter:image", "twitter:image:src"),
    "description": ("description", "og:description", "twitter:description"),
}


# The fields of structured data for each piece of metadata, and those that name an object.
LD_FIELDS = {
    "author": ("author", "creator"), "datePublished": ("datePublished",), "dateCreated": ("dateCreated",), "uploadDate": ("uploadDate",),
    "license": ("license", "copyrightNotice", "copyrightHolder"), "inLanguage": ("inLanguage",),
}
LD_NAMES = ("name", "headline", "@id", "url")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in either kind of quotes, as written; empty if it isn't there."""
    return F.trim(F.regexp_extract(tag, rf"""(?is)(?:^|[\s"'])(?:{name})\s*=\s*(["'])(.*?)\1""", 2))


def meta_table(html: Column | str) -> Column:
    """The page's meta tags with content, as structs of key (folded) and content, in order."""
    tags = F.regexp_extract_all(text(html), F.lit(r"(?is)<meta\b[^>]*>"), 0)
    key = lambda t: F.lower(F.coalesce(*[F.when(_attribute(t, a) != "", _attribute(t, a)) for a in ("property", "name", "itemprop")], F.lit("")))
    return F.filter(F.transform(tags, lambda t: F.struct(key(t).alias("key"), clean_text(_attribute(t, "content"), "page", 1200).alias("content"))), lambda m: m["content"] != "")


def first_meta(metas: Column, *names: str) -> Column:
    """(value, source) of the first name, in the order given, that some meta tag has; null if none."""
    found = lambda n: F.get(F.filter(metas, lambda m: m["key"] == n), F.lit(0))
    return F.coalesce(*[let(found(n), lambda m: F.when(m.isNotNull(), F.struct(m["content"].alias("value"), F.lit(n).alias("source")))) for n in names])


def first_link(html: Column | str, rel: str) -> Column:
    tags = F.filter(F.regexp_extract_all(text(html), F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), rel) & (_attribute(t, "href") != ""))
    return F.coalesce(unescape(_attribute(F.get(tags, F.lit(0)), "href")), F.lit(""))


def discover_feed_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, feed_url) of pages that name a feed: the first alternate link of a feed's type, as a full address."""
    tags = F.regexp_extract_all(text(html_col), F.lit(r"(?is)<link\b[^>]*>"), 0)
    good = F.filter(tags, lambda t: (_attribute(t, "href") != "") & F.contains(F.lower(_attribute(t, "rel")), F.lit("alternate")) & F.lower(_attribute(t, "type")).rlike("rss|atom|xml"))
    return pages.select(F.col(id_col).alias("id"), join_url(url_col, unescape(_attribute(F.get(good, F.lit(0)), "href"))).alias("feed_url"), F.size(good).alias("n")).filter("n > 0").drop("n")


def _nodes(data: object) -> Iterator[dict]:
    """All objects of a JSON document, each before what it holds, later members first."""
    todo = [data]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo += x.values()
        elif isinstance(x, list):
            todo += x


def _said(value: object) -> str:
    """A field's words: its own, those of an object's name, or of the first entry of a list that has some."""
    if isinstance(value, list):
        return next(filter(None, map(_said, value)), "")
    if isinstance(value, dict):
        return next((v.strip() for k in LD_NAMES if isinstance(v := value.get(k), str) and v.strip()), "")
    return value.strip() if isinstance(value, str) else ""


def _documents(scripts: Iterable[str]) -> Iterator[object]:
    for raw in scripts:
        try:
            yield json.loads(decode(raw).strip())
        except (ValueError, RecursionError):
            continue


def _structured(scripts: pd.Series) -> pd.DataFrame:
    """Per page the first value of each field in any object of any script; unreadable scripts are passed over."""
    rows = []
    for own in scripts:
        nodes = [n for d in _documents([] if own is None else own) for n in _nodes(d)]
        rows.append([next((v for n in nodes for f in fields if (v := _said(n.get(f)))), "") for fields in LD_FIELDS.values()])
    return pd.DataFrame(rows, columns=list(LD_FIELDS), dtype=object)


def page_metadata(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page its title, excerpt, author, date, licence, language and images, each with where it was found; one projection.

    Structured data are read in an Arrow batch from the objects at any depth of all JSON-LD scripts; only the scripts go to Python, all else is built-in
    expressions. Null pages have empty fields.
    """
    html = F.col("__html")
    staged = pages.select(F.col(id_col).alias("id"), text(url_col).alias("url"), text(html_col).alias("__html"))
    scripts = F.regexp_extract_all(html, F.lit(_LD.pattern), 1)
    staged = staged.withColumn("__metas", meta_table(html)).withColumn("__plain", clean_text(html, "page"))
    staged = staged.withColumn("__ld", F.pandas_udf(_structured, ", ".join(f"{f} string" for f in LD_FIELDS))(scripts))
    ld = lambda field: let(clean_text(F.col("__ld")[field], "page", 500), lambda v: F.when(v != "", F.struct(v.alias("value"), F.lit("json-ld").alias("source"))))
    meta = lambda kind: first_meta(F.col("__metas"), *META[kind])
    where = lambda value, source: let(value, lambda v: F.when(v != "", F.struct(v.alias("value"), F.lit(source).alias("source"))))
    byline = clean_text(F.regexp_extract(html, r"""(?is)<[^>]+class=["'][^"']*(?:author|byline)[^"']*["'][^>]*>(.*?)</""", 1), "page", 240)
    told = lambda tag: F.coalesce(F.nullif(_attribute(tag, "datetime"), F.lit("")), _attribute(tag, "content"))
    times = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<time\b[^>]*>"), 0), lambda t: parse_page_date(told(t))), lambda d: d.isNotNull())
    dated = lambda s: let(s, lambda m: let(parse_page_date(m["value"]), lambda d: F.when(d.isNotNull(), F.struct(d.alias("value"), m["source"].alias("source")))))
    dates = F.coalesce(
        *[dated(first_meta(F.col("__metas"), n)) for n in META["published"]], *[dated(ld(f)) for f in ("datePublished", "dateCreated", "uploadDate")],
        let(F.get(times, F.lit(0)), lambda d: F.when(d.isNotNull(), F.struct(d.alias("value"), F.lit("time").alias("source")))), let(date_in_path(path("url")), lambda d: F.when(d.isNotNull(), F.struct(d.alias("value"), F.lit("url").alias("source")))),
    )
    plain = F.lower("__plain")
    stated = F.when(plain.rlike(r"\bcc[- ]?by(?:[- ](?:sa|nc|nd))*\b|creative commons"), "Creative Commons").when(plain.rlike("all rights reserved|版權所有|著作權所有"), "copyright").otherwise("")
    paragraphs = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), lambda p: clean_text(p, "page", 500)), lambda p: F.length(p) >= 40)
    lang_tag = normalize_language(_attribute(F.regexp_extract(html, r"(?is)<html\b([^>]*)>", 1), "lang|xml:lang"))
    tag_title = clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "page", 300)
    language = F.coalesce(where(lang_tag, "html lang"), F.transform(F.array(meta("language")), lambda m: F.when(m.isNotNull(), F.struct(normalize_language(m["value"]).alias("value"), m["source"].alias("source"))))[0], let(normalize_language(F.col("__ld")["inLanguage"]), lambda v: where(v, "json-ld")), let(infer_language("__plain"), lambda v: where(v, "inferred")))
    return staged.select(
        "id", "url", F.coalesce(meta("title")["value"], tag_title).alias("title"), clean_text(F.array_join(F.slice(paragraphs, 1, 3), "\n\n"), limit=1200).alias("excerpt"),
        F.coalesce(meta("author"), ld("author"), where(byline, "byline")).alias("author"), dates.alias("published"),
        F.coalesce(let(first_link(html, "license"), lambda k: where(F.when(k != "", join_url("url", k)), "rel=license")), meta("license"), ld("license"), where(stated, "inferred")).alias("license"),
        language.alias("language"), meta("image")["value"].alias("image_url"), meta("description")["value"].alias("description"), first_link(html, "canonical").alias("canonical_url"),
    )


# --- block choice, the one part that needs the page's nesting ---

_PARAGRAPH = re.compile(r"(?is)<(h[1-6]|p|li|blockquote)\b[^>]*>(.*?)</\1>")
_LD = re.compile(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""")
# Class and id words of divisions that hold articles.
_AREA = re.compile(r"""(?is)<div\b[^>]*(?:class|id)=["'][^"']*(?:article|body|content|entry|post|story|main)[^"']*["'][^>]*>.*?</div>""")
_WYSIWYG = re.compile(r"""(?is)<div\b[^>]*(?:class|id)=["'][^"']*\bwysiwyg\b[^"']*["'][^>]*>.*?</div>""")
_CODE_LINE = re.compile(CODE_LINE)
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))


def _plain(fragment: str) -> str:
    t = re.sub(r"(?is)<(script|style).*?</\1>", " ", decode(fragment))
    t = re.sub(r"[ \t\r\f\v]+", " ", re.sub(r"(?s)<[^>]+>", " ", t))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n\s+", "\n", t)).strip()


def _code_like(t: str) -> bool:
    """The tests of is_code_like for one paragraph."""
    t = t[:2400]
    compact, lines = "".join(t.split()), [x for x in map(str.strip, t.split("\n")) if x]
    symbols, brackets = sum(map(t.count, "{}[]();=<>")), sum(map(compact.count, "{}[]:,"))
    worded = any(w in t.casefold() for w in CODE_WORDS) and (symbols >= max(12, len(t) // 22) or (len(t) < 120 and symbols >= 5))
    listed = len(lines) >= 3 and sum(bool(_CODE_LINE.search(x)) for x in lines) >= 0.45 * len(lines)
    return len(t) >= 20 and (worded or listed or (len(compact) >= 180 and brackets >= 0.18 * len(compact)))


def _paragraphs(block: str) -> list[str]:
    """Paragraphs of 28 characters or more that are neither furniture nor code."""
    out = []
    for _, inner in _PARAGRAPH.findall(block):
        t = _plain(inner)
        low = t.casefold()
        if len(t) >= 28 and not _FURNITURE.search(low) and not _code_like(t) and len(re.sub(r"\W+", "", t)) >= 20:
            out.append(t)
    return out


def _choose(html: str) -> tuple[str, str, str]:
    """(text, block, method): structured data's body, else the candidate block with most paragraph text (300 characters or more), else the whole page."""
    bodies = (v for d in _documents(_LD.findall(html)) for n in _nodes(d) for k in ("articleBody", "text") if isinstance(v := n.get(k), str))
    found = [t for b in bodies if len(t := _plain(b)) >= 300]
    if found:
        body = max(found, key=len)
        return body, "", "jsonld"
    areas = [m.group(0) for m in _WYSIWYG.finditer(html)]
    areas = (["\n".join(areas)] if areas else []) + areas
    areas += [m.group(0) for tag in ("article", "main") for m in re.finditer(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", html)] + [m.group(0) for m in _AREA.finditer(html)]
    sized = [(sum(map(len, own)), -k, own, a) for k, a in enumerate(areas) if sum(map(len, own := _paragraphs(a))) >= 300]
    if sized:
        _, _, own, area = max(sized, key=lambda x: x[:2])
        return "\n\n".join(own), area, "semantic-block"
    return "\n\n".join(_paragraphs(html)), html, "all-paragraphs"


def _inline(fragment: str, base: str) -> str:
    from urllib.parse import urljoin

    def link(m: re.Match) -> str:
        href = re.search(r"""href\s*=\s*(["'])(.*?)\1""", m[1])
        label = _plain(m[2])
        return f"[{label}]({urljoin(base, decode(href[2]).strip())})" if href and label and not href[2].startswith(("javascript:", "mailto:")) else label

    t = re.sub(r"(?is)<a\b([^>]*)>(.*?)</a>", link, fragment)
    for tags, mark in (("strong|b", "**"), ("em|i", "*"), ("code", "`")):
        t = re.sub(rf"(?is)<(?:{tags})\b[^>]*>(.*?)</(?:{tags})>", lambda m, mark=mark: f"{mark}{s}{mark}" if (s := _plain(m[1])) else "", t)
    return _plain(t)


def _markdown(block: str, base: str) -> str:
    """Headings (levels 2 to 4), list entries, quotes and paragraphs, an empty line between all but neighbouring list entries."""
    out: list[tuple[bool, str]] = []
    for tag, inner in _PARAGRAPH.findall(block):
        t, tag = _inline(inner, base), tag.lower()
        size = len(re.sub(r"\W+", "", t))
        if not t or _FURNITURE.search(t.casefold()):
            continue
        if tag[0] == "h":
            out.append((False, "#" * min(max(int(tag[1]), 2), 4) + " " + t.rstrip(":：")))
        elif tag == "li" and size >= 12:
            out.append((True, f"- {t}"))
        elif tag == "blockquote":
            out.append((False, "\n".join(f"> {line}" for line in t.split("\n") if line.strip())))
        elif tag == "p" and len(t) >= 28 and size >= 20:
            out.append((False, t))
    parts = []
    for k, (listed, t) in enumerate(out):
        parts.append(("" if not k else "\n" if listed and out[k - 1][0] else "\n\n") + t)
    return "".join(parts)


def article_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, article_text, article_markdown, article_chars, method) of every page, in Arrow batches; pages never meet, so nothing is shuffled. Null pages are empty.

    A batch may be thousands of pages, so it is read in slabs: what a task holds besides the batch is a slab's pages and their texts.
    """
    kind = dict(pages.dtypes)[id_col]
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "html", 1 << 20):
            bodies, marked, methods = [], [], []
            for url, html in zip(slab.column("url").to_pylist(), slab.column("html").to_pylist(), strict=True):
                body, block, method = _choose(html or "")
                bodies.append(body)
                marked.append(_markdown(block, url or "") if block else body)
                methods.append(method)
            own = [pa.array(x, pa.string()) for x in (bodies, marked, methods)]
            yield pa.RecordBatch.from_arrays([slab.column("id"), *own[:2], pa.array(map(len, bodies), pa.int64()), own[2]], ["id", "article_text", "article_markdown", "article_chars", "method"])

    return own.mapInArrow(run, f"id {kind}, article_text string, article_markdown string, article_chars long, method string")


def classify_access(pages: DataFrame, html_col: str, status_col: str, chars_col: str, headers_col: str | None = None, url_col: str = "url") -> DataFrame:
    """pages with `access_issue`: the first sign, in headers, status and text, that the page was not given out in full; null if there is none."""
    low = F.lower(clean_text(html_col, "page", 4000))
    status, few = F.col(status_col), F.coalesce(F.col(chars_col), F.lit(0)) < 500
    header = lambda n: F.lower(F.coalesce(F.try_element_at(F.transform_keys(headers_col, lambda k, _: F.lower(k)), F.lit(n)), F.lit(""))) if headers_col else F.lit("")
    denied = status.isin(401, 402, 403)
    issue = (
        F.when(header("x-amzn-waf-action") == "challenge", "waf-challenge")
        .when((header("cf-mitigated") == "challenge") | (F.contains(low, F.lit("just a moment")) & F.contains(low, F.lit("enable javascript and cookies to continue"))), "cdn-challenge")
        .when(few & low.rlike(PROMPT), F.when(denied, "http-access-denied").otherwise("javascript-required"))
        .when((host(url_col) == "books.openbookpublishers.com") & status.isin(202, 405) & few, "fulltext-blocked")
        .when(denied & low.rlike(r"\b(sign in|log in|login|subscribe|subscription|register)\b"), "login-or-subscription")
        .when(denied & few, "http-access-denied")
        .when(status == 429, "rate-limited")
        .when(few & low.rlike("sign in|log in|login|subscribe to continue|subscription required|register for free|continue reading|create an account|登入|訂閱|註冊|會員"), "login-or-subscription")
    )
    return pages.withColumn("access_issue", issue)


def preferred_fulltext(url: Column | str, html: Column | str) -> Column:
    """The address of a page's full text where it names one: the HTML form of a preprint's abstract page, or a book page's citation link. Null otherwise."""
    paper = F.regexp_extract(path(url), r"^/abs/(\d{4}\.\d{4,5}(?:v\d+)?)/?$", 1)
    metas = meta_table(html)
    cited = first_meta(metas, "citation_fulltext_html_url", "citation_html_url", "dc.relation.isformatof")["value"]
    book = F.when(F.contains(host(url), F.lit("openbookpublishers.com")) & cited.rlike(r"(?i)\.(xhtml|html?)($|[?#])"), join_url(url, cited))
    found = F.when((host(url) == "arxiv.org") & (paper != ""), F.concat(F.lit("https://arxiv.org/html/"), paper)).otherwise(book)
    return F.when(F.rtrim(found) != text(url), found)


FRESH = ("fetched_at", "source_url", "final_url", "content_type", "status")


def merge_metadata(current: DataFrame, fetched: DataFrame, fields: list[str], preserve: bool = True, key: str = "id") -> DataFrame:
    """current with the fields of fetched: kept where they are filled if `preserve`, else replaced; some always refresh. Bodies that only ask for scripts are dropped."""
    f = fetched.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in fields if c in fetched.columns])
    out = current.join(f, F.col(key) == F.col("__key"), "left")
    for c in fields:
        new = F.col(f"__new_{c}") if f"__new_{c}" in out.columns else F.lit(None)
        old = F.col(c) if c in current.columns else F.lit(None).cast("string")
        filled = old.isNotNull() & (text(old) != "")
        value = F.coalesce(new, old) if c in FRESH or not preserve else F.when(filled, old).otherwise(new)
        if c in ("article_text", "article_markdown", "description", "excerpt"):
            value = F.when(~is_access_prompt(value), value)
        out = out.withColumn(c, value)
    return out.drop("__key", *[c for c in out.columns if c.startswith("__new_")])


def complete_metadata(items: DataFrame) -> DataFrame:
    """items with original_title, original_language, original_author and original_license filled, and for each where it came from."""
    filled = lambda c: F.when(text(c) != "", F.col(c))
    have = lambda c: filled(c) if c in items.columns else F.lit(None).cast("string")
    guess = F.nullif(infer_language(F.concat_ws("\n", *[have(c) for c in ("article_text", "description", "summary", "title")])), F.lit(""))
    rules = {
        "original_title": [(have("original_title"), None), (have("page_title"), "page"), (have("title"), "feed")], "original_language": [(have("original_language"), None), (guess, "inferred")],
        "original_author": [(have("original_author"), None), (have("author"), "feed")], "original_license": [(have("original_license"), None), (F.lit("not stated; copyright assumed"), "inferred")],
    }
    out = items
    for name, choices in rules.items():
        given = have(f"{name}_source")
        best = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("v"), (given if s is None else F.lit(s)).alias("s"))) for v, s in choices])
        out = out.withColumn("__b", best).withColumns({name: F.col("__b.v"), f"{name}_source": F.col("__b.s")}).drop("__b")
    return out


def missing_fields(image: Column, description: Column, article: Column) -> Column:
    empty = lambda c, name: F.when(text(c) == "", F.lit(name))
    return F.array_compact(F.array(empty(image, "image"), empty(description, "description"), empty(article, "article")))


def retry_due(last_attempt: Column, now: str, days: int = 7) -> Column:
    """Never tried, or tried at least so many days ago."""
    at = last_attempt.try_cast("timestamp")
    return at.isNull() | (at <= F.expr(f"timestamp '{now}' - interval {int(days)} days"))


def enrichment_queue(items: DataFrame, now: str, days: int = 7, most: int | None = 80) -> DataFrame:
    """Items due for another look, those never tried first, then the longest ago. items: id, last_attempt_at, missing_fields."""
    due = items.filter((F.size("missing_fields") > 0) & retry_due(F.col("last_attempt_at"), now, days)).orderBy(F.col("last_attempt_at").asc_nulls_first(), "id")
    return due.limit(most) if most else due


def image_candidates(columns: list[str], summary: str) -> Column:
    """Image addresses of a record, distinct and in order: from its fields, then images and bare image links in the summary."""
    shown = F.regexp_extract_all(unescape(summary), F.lit(r"""(?i)<img\b[^>]*\bsrc=["']([^"']+)["']"""), 1)
    bare = F.regexp_extract_all(unescape(summary), F.lit(r"""(?i)https?://[^\s"'<>]+\.(?:png|jpe?g|gif|webp|avif)(?:\?[^\s"'<>]*)?"""), 0)
    every = F.concat(F.array(*[F.trim(text(c)) for c in columns]), shown, bare)
    return F.array_distinct(F.filter(every, lambda u: u.rlike("^https?://")))


def sniff_images(files: DataFrame) -> DataFrame:
    """files (path, content) with the format their first bytes tell, and whether the name's ending agrees."""
    head = F.hex(F.substring("content", 1, 16))
    kind = (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg").when(F.startswith(head, F.lit("47494638")), "gif")
        .when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "webp").when(F.substring(head, 9, 16).isin("6674797061766966", "6674797061766973"), "avif")
    )
    ending = F.replace(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)), F.lit("jpg"), F.lit("jpeg"))
    return files.withColumn("format", kind).withColumn("ending_agrees", F.col("format").eqNullSafe(ending)).drop("content")


def image_targets(items: DataFrame, valid: DataFrame, most: int | None = None) -> DataFrame:
    """Items without a valid stored image that have candidates (column image_candidates), with the first three."""
    todo = items.join(valid.select("id"), "id", "left_anti").filter(F.size("image_candidates") > 0).withColumn("image_candidates", F.slice("image_candidates", 1, 3))
    return todo.orderBy("id").limit(most) if most else todo


def page_text_filters(paragraph: Column) -> Column:
    """Whether a paragraph is text of an article: long enough, no furniture, enough letters."""
    return (F.length(paragraph) >= 28) & ~fold(paragraph).rlike("|".join(BOILERPLATE)) & (F.length(F.regexp_replace(paragraph, r"(?U)\W+", "")) >= 20)


def needs_fulltext(access_issue: Column, preferred_url: Column) -> Column:
    """Whether a page's text is to be fetched elsewhere: it was held back, or names a fuller version."""
    return access_issue.isNotNull() | preferred_url.isNotNull()


def autofill(items: DataFrame, description: str = "description") -> DataFrame:
    """Items entered by hand, completed: the date from the address, the summary from the page's description, notes from the matched terms. What is filled stays."""
    kept = lambda c, other: F.when(text(c) != "", F.col(c)).otherwise(other)
    notes = F.concat(F.lit("terms: "), F.array_join(F.slice("triage.matched_keywords", 1, 6), ", "))
    return items.withColumns({
        "published_at": kept("published_at", date_in_path(path("url")).cast("string")), "summary": kept("summary", clean_text(description, "page", 1200)),
        "notes": kept("notes", F.when(F.size("triage.matched_keywords") > 0, notes)) if "notes" in items.columns else F.when(F.size("triage.matched_keywords") > 0, notes),
    })


def text_to_markdown(body: Column, title: Column | None = None) -> Column:
    """Plain text as Markdown: a title, short lines without a full stop as headings, list marks made alike, an empty line between paragraphs."""
    parts = F.filter(F.transform(F.split(clean_text(body, "document"), r"\n\s*\n"), lambda p: clean_text(p, "page")), lambda p: p != "")
    heading = lambda p, i: (i > 0) & (F.length(p) <= 90) & ~p.rlike(r"[。！？.!?]$") & ~p.rlike("^[-•]")
    lines = F.transform(parts, lambda p, i: F.when(heading(p, i), F.concat(F.lit("## "), F.regexp_replace(p, "[:：]+$", ""))).otherwise(F.regexp_replace(p, r"^[-•]\s+", "- ")))
    if title is not None:
        head = clean_text(title, "page", 220)
        lines = F.concat(F.filter(F.array(F.when(head != "", F.concat(F.lit("# "), head))), lambda v: v.isNotNull()), F.filter(lines, lambda v: fold(v) != fold(head)))
    return F.array_join(lines, "\n\n")
