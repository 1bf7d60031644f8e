"""Queries over pages and feeds that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import WHITE
from quillmill.operators import pages, summaries
from quillmill.plans.registry import ORACLE_SQL, query
from quillmill.plans.views import NOW, TODAY, table
from quillmill.sources.feeds import explode_feeds

_BLOCK = "|".join(f"<{t}\\b[^>]*>.*?</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote"))
_AREA = r"""<div\b[^>]*(?:class|id)=["''][^"'']*(?:article|body|content|entry|post|story|main)[^"'']*["''][^>]*>.*?</div>"""
# Page furniture, and words and lines of program code, as the operator has them.
_FURNITURE = "cookie|privacy policy|terms of use|subscribe|newsletter|advertisement|recommended|related posts|share this|all rights reserved|登入|註冊|訂閱|廣告|推薦閱讀|相關文章|分享此文|版權所有|隱私權|圖片來源|資料來源|延伸閱讀"
_CODE_WORDS = r"function\(|function \(|=>|var |let |const |window\.|document\.|__next_data__|webpack|gtag\(|datalayer"
_CODE_LINE = r"[{}();=<>]{2,}|^\s*(var|let|const|function|import|export)\b"


def _paragraphs(area: str) -> str:
    """SQL for a list of an area's paragraphs that are neither short nor furniture nor code."""
    clean = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(b, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))".replace('\\"', '"')
    without = lambda x, of: f"(length({x}) - length(regexp_replace({x}, '{of}', '', 'g')))"
    start = "substr(t, 1, 2400)"
    compact = rf"regexp_replace({start}, '\s+', '', 'g')"
    symbols = without(start, r"[{}\[\]();=<>]")
    lines = f"list_filter(string_split({start}, chr(10)), lambda x : trim(x) <> '')"
    code = f"""length({start}) >= 20 AND ((regexp_matches(lower({start}), '{_CODE_WORDS}') AND ({symbols} >= greatest(12, length({start}) // 22) OR (length({start}) < 120 AND {symbols} >= 5)))
        OR (len({lines}) >= 3 AND len(list_filter({lines}, lambda x : regexp_matches(trim(x), '{_CODE_LINE}'))) >= 0.45 * len({lines}))
        OR (length({compact}) >= 180 AND {without(compact, "[{}[" + chr(92) + "]:,]")} >= 0.18 * length({compact})))"""
    kept = rf"length(t) >= 28 AND NOT regexp_matches(lower(t), '{_FURNITURE}') AND NOT ({code}) AND length(regexp_replace(t, '[^\p{{L}}\p{{N}}_]+', '', 'g')) >= 20"
    return f"list_filter(list_transform(regexp_extract_all({area}, '(?is){_BLOCK}'), lambda b : {clean}), lambda t : {kept})"


@query(
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    areas AS (SELECT page_id, h, list_concat(list_concat(regexp_extract_all(h, '(?is)<article\\b[^>]*>.*?</article>'), regexp_extract_all(h, '(?is)<main\\b[^>]*>.*?</main>')), regexp_extract_all(h, '(?is){_AREA}')) AS a FROM p),
    flat AS (SELECT page_id, unnest(a) AS area, unnest(range(1, len(a) + 1)) AS k FROM areas),
    read AS (SELECT page_id, k, {_paragraphs("area")} AS own FROM flat),
    sized AS (SELECT *, list_sum(list_transform(own, lambda x : length(x))) AS n FROM read),
    best AS (SELECT page_id, arg_max(own, n * 1000 - k) AS own FROM sized WHERE n >= 300 GROUP BY page_id),
    told AS (SELECT p.page_id AS id, coalesce(best.own, {_paragraphs("h")}) AS own, CASE WHEN best.own IS NULL THEN 'all-paragraphs' ELSE 'semantic-block' END AS method FROM p LEFT JOIN best USING (page_id))
    SELECT id, array_to_string(own, chr(10) || chr(10)) AS article_text, length(array_to_string(own, chr(10) || chr(10))) AS article_chars, method FROM told"""
)
def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and how its block was chosen."""
    return pages.article_text(table(spark, sf_dir, "pages")).select("id", "article_text", "article_chars", "method")


def _told_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with metadata in one of six ways: meta tags, structured data, page elements, the address, rarer meta tags, the text."""
    k, day = F.col("page_id") % 6, F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    graph = F.format_string('{"@graph": [{"@type": "Page"}, {"@type": "Article", "author": [{"name": "%s desk"}], "datePublished": "2024-01-%s", "license": {"url": "https://creativecommons.org/licenses/by/4.0/"}}]}', host, day)
    head = (
        F.when(k == 0, F.format_string('<meta name="author" content="%s"><meta content="2024-02-%sT01:00:00Z" property="article:published_time">', host, day))
        .when(k == 1, F.concat(F.lit('<script type="application/ld+json">'), graph, F.lit("</script>")))
        .when(k == 2, F.format_string('<link rel="nofollow license" href="/terms/%s">', day))
        .when(k == 4, F.format_string('<meta name="twitter:creator" content="@%s"><meta name="pubdate" content="March %s, 2024"><meta name="dc.rights" content="CC BY %s">', host, day, day))
        .otherwise("")
    )
    body = F.when(k == 2, F.format_string('<p class="a byline">by %s</p><time datetime="2023-12-%s">then</time>', host, day)).when(k == 3, "<p>All Rights Reserved</p>").when(k == 5, "<p>under Creative Commons</p>").otherwise("")
    url = F.concat(F.lit("https://"), host, F.when(k == 3, F.concat(F.lit("/2024/03/"), day)).otherwise(""), F.lit("/a"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.concat(head, F.coalesce("html", F.lit("")), body).alias("html"))


@query(
    r"""WITH p AS (SELECT page_id, page_id % 6 AS k, lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS day, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, lower(coalesce(html, '')) AS h FROM pages),
    s AS (SELECT *, CASE WHEN regexp_matches(h, '\bcc[- ]?by([- ](sa|nc|nd))*\b|creative commons') OR k = 5 THEN 'Creative Commons' WHEN regexp_matches(h, 'all rights reserved|版權所有|著作權所有') OR k = 3 THEN 'copyright' END AS stated FROM p)
    SELECT page_id AS id, CASE k WHEN 0 THEN host WHEN 1 THEN host || ' desk' WHEN 2 THEN 'by ' || host WHEN 4 THEN '@' || host END AS author, CASE k WHEN 0 THEN 'author' WHEN 1 THEN 'json-ld' WHEN 2 THEN 'byline' WHEN 4 THEN 'twitter:creator' END AS author_source,
        CASE k WHEN 0 THEN DATE '2024-02-01' WHEN 1 THEN DATE '2024-01-01' WHEN 2 THEN DATE '2023-12-01' WHEN 3 THEN DATE '2024-03-01' WHEN 4 THEN DATE '2024-03-01' END + day::INT - 1 AS published,
        CASE k WHEN 0 THEN 'article:published_time' WHEN 1 THEN 'json-ld' WHEN 2 THEN 'time' WHEN 3 THEN 'url' WHEN 4 THEN 'pubdate' END AS published_source,
        CASE k WHEN 1 THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 2 THEN 'https://' || host || '/terms/' || day WHEN 4 THEN 'CC BY ' || day ELSE stated END AS license,
        CASE k WHEN 1 THEN 'json-ld' WHEN 2 THEN 'rel=license' WHEN 4 THEN 'dc.rights' ELSE CASE WHEN stated IS NOT NULL THEN 'inferred' END END AS license_source FROM s"""
)
def page_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author, date and licence of pages, and where each was found."""
    m = pages.page_metadata(_told_pages(spark, sf_dir))
    return m.select("id", *[x for c in ("author", "published", "license") for x in (F.col(f"{c}.value").alias(c), F.col(f"{c}.source").alias(f"{c}_source"))])


def _xml(name: str, *inside: Column, more: Column | None = None) -> Column:
    return F.concat(F.lit(f"<{name}"), more if more is not None else F.lit(""), F.lit(">"), *inside, F.lit(f"</{name}>"))


@query(
    rf"""WITH d AS (SELECT doc_id, doc_id // 20 AS source_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS pos, trim(regexp_replace(split_part(text, chr(10), 1), '[ \t\r\f\x0B]+', ' ', 'g')) AS t, source, lang FROM documents
        WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL)
    SELECT source_id, pos::INT AS pos, CASE t WHEN '' THEN '(untitled)' ELSE t END AS title, 'https://' || source || '.example.org/' || doc_id AS url, 'urn:doc:' || doc_id AS guid, source || ' team' AS author,
        DATE '{TODAY}' - (doc_id % 90)::INT AS published_at, lang AS tag FROM d"""
)
def feed_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as feeds of twenty entries, in turn in Atom and in RDF, written out as XML and read again."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = table(spark, sf_dir, "documents").filter("text is not null and source is not null and lang is not null")
    title, address = escape(escape(F.substring_index("text", "\n", 1))), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id")
    guid, author = F.concat(F.lit("urn:doc:"), "doc_id"), F.concat("source", F.lit(" team"))
    day = F.date_sub(F.lit(TODAY).cast("date"), (F.col("doc_id") % 90).cast("int")).cast("string")
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    atom = _xml(
        "entry", _xml("title", title), _xml("link", more=F.concat(attribute("rel", F.lit("self")), attribute("href", F.lit("https://other.example.org/")))),
        _xml("link", more=F.concat(attribute("rel", F.lit("alternate")), attribute("href", address))), _xml("id", guid), _xml("author", _xml("name", author)), _xml("updated", F.concat(day, F.lit("T00:00:00Z"))), _xml("category", more=attribute("term", F.col("lang"))),
    )
    rdf = _xml("item", _xml("title", title), _xml("link", address), _xml("dc:creator", author), _xml("dc:date", day), _xml("category", F.col("lang")), more=attribute("rdf:about", guid))
    entry = F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, atom).otherwise(rdf)
    feeds = d.select(F.floor(F.col("doc_id") / 20).alias("source_id"), "doc_id", entry.alias("entry")).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("entries"))
    inside = F.array_join(F.transform("entries", lambda e: e["entry"]), "")
    docs = feeds.select("source_id", F.when(F.col("source_id") % 2 == 0, _xml("feed", inside)).otherwise(_xml("rdf:RDF", inside)).alias("xml"))
    return explode_feeds(docs).select("source_id", "pos", "title", "url", "guid", "author", "published_at", F.get("tags", F.lit(0)).alias("tag"))


# white space of any kind goes at the ends of texts, and where a text is cut, as the operators have it
_WHITE = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITE) + ")"
_OWN = rf"trim(regexp_replace(regexp_replace(coalesce(%s, ''), '[ \t\r\f\x0B]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_WHITE})"
_KEY = f"replace(lower({_OWN % 'substr(%s, 1, 500)'}), 'ß', 'ss')"


@query(
    f"""WITH bodies AS ({ORACLE_SQL["article_bodies"]}), d AS (SELECT doc_id, {_OWN % "split_part(text, chr(10), 1)"} AS a0, {_OWN % "text"} AS b0 FROM documents),
    c AS (SELECT doc_id, CASE WHEN length(a0) > 4000 THEN rtrim(substr(a0, 1, 4000), {_WHITE}) || '...' ELSE a0 END AS a, CASE WHEN length(b0) > 4000 THEN rtrim(substr(b0, 1, 4000), {_WHITE}) || '...' ELSE b0 END AS b FROM d),
    own AS (SELECT doc_id, CASE WHEN a = '' OR {_KEY % "a"} = {_KEY % "b"} THEN CASE WHEN a = '' THEN b ELSE a END WHEN b = '' THEN a ELSE a || chr(10) || chr(10) || b END AS t FROM c),
    s AS (SELECT o.doc_id, t, article_text, method, CASE WHEN o.doc_id % 11 = 0 THEN 'fallback-existing-summary' WHEN id IS NULL OR id % 7 = 0 THEN 'fallback-fetch-error'
        WHEN length(article_text) >= 280 AND NOT contains(lower(substr(article_text, 1, 400)), 'login') THEN 'ok' ELSE 'fallback-short-extraction' END AS status FROM own o LEFT JOIN bodies ON id = o.doc_id)
    SELECT doc_id AS id, status, status = 'ok' AS used_original_url_text, CASE WHEN status IN ('ok', 'fallback-short-extraction') THEN method ELSE 'existing-summary' END AS extraction_method,
        CASE WHEN status = 'ok' THEN length(article_text) ELSE length(t) END::INT AS text_chars,
        CASE status WHEN 'ok' THEN '' WHEN 'fallback-existing-summary' THEN 'no address to fetch' WHEN 'fallback-short-extraction' THEN 'the page gives too little text' ELSE CASE WHEN article_text IS NULL THEN 'not fetched' ELSE 'HTTP 404' END END AS error FROM s"""
)
def enriched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the texts of the pages of their number: some have no address, some no page, and every seventh page failed."""
    title = F.substring_index("text", "\n", 1)
    url = F.when(F.col("doc_id") % 11 == 0, "by mail").otherwise(F.concat(F.lit("https://example.org/"), "doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.col("text").alias("summary"), url.alias("url"))
    p = pages.article_text(table(spark, sf_dir, "pages")).select("id", "article_text", "method", F.concat(F.lit("https://example.org/"), "id").alias("final_url"), F.when(F.col("id") % 7 == 0, "HTTP 404").alias("error"))
    out = summaries.enrich(d, p, [F.col("title"), F.col("summary")], NOW, "doc_id")
    return out.select(F.col("doc_id").alias("id"), *[f"article_enrichment.{c}" for c in ("status", "used_original_url_text", "extraction_method", "text_chars", "error")])
