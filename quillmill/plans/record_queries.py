"""Queries over records made of the given tables: access to pages, metadata merged, work queues, and what a published page draws together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import claims, licences, listings, pages
from quillmill.plans.registry import query
from quillmill.plans.views import NOW, TODAY, table


def _pick(key: str, n: int, *values: object) -> F.Column:
    """One of several values by the rest of a number."""
    return F.element_at(F.array(*[v if isinstance(v, F.Column) else F.lit(v) for v in values]), (F.col(key) % n + 1).cast("int"))


@query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'login-or-subscription' WHEN 2 THEN 'http-access-denied' WHEN 3 THEN 'rate-limited' WHEN 4 THEN 'cdn-challenge' ELSE 'login-or-subscription' END AS access_issue,
        CASE WHEN page_id % 4 = 0 THEN 'https://arxiv.org/html/2401.' || lpad((page_id % 100000)::VARCHAR, 5, '0') END AS fulltext, page_id % 6 <> 0 OR page_id % 4 = 0 AS needs_fulltext FROM pages"""
)
def page_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as they may come back: whole, behind a login, denied, rate-limited, challenged, cut off; every fourth is a preprint's abstract."""
    html = _pick("page_id", 6, F.coalesce("html", F.lit("")), "<p>Please sign in to see this.</p>", "<p>No.</p>", F.coalesce("html", F.lit("")), "<p>Just a moment... Enable JavaScript and cookies to continue</p>", "<p>The first lines. Continue reading</p>")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad((F.col("page_id") % 100_000).cast("string"), 5, "0"))).otherwise(F.col("url"))
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html"), _pick("page_id", 6, 200, 403, 403, 429, 503, 200).alias("status"), _pick("page_id", 6, 5000, 20, 10, 5000, 60, 40).alias("chars"))
    out = pages.classify_access(p, "html", "status", "chars").withColumn("fulltext", pages.preferred_fulltext("url", "html"))
    return out.select("page_id", "access_issue", "fulltext", pages.needs_fulltext(F.col("access_issue"), F.col("fulltext")).alias("needs_fulltext"))


@query(
    """WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source END AS author, CASE WHEN doc_id % 3 = 0 THEN 'old' END AS status, lang FROM documents),
    m AS (SELECT id, CASE WHEN d.author IS NOT NULL THEN d.author WHEN id % 5 = 0 THEN 'found' END AS author, CASE WHEN id % 5 = 0 THEN 'ok' ELSE d.status END AS status, CASE WHEN id % 5 = 0 THEN 'Page ' || id END AS page_title, lang FROM d)
    SELECT id, author, status, coalesce(page_title, 'feed title') AS original_title, CASE WHEN page_title IS NULL THEN 'feed' ELSE 'page' END AS original_title_source, author AS original_author,
        CASE WHEN author IS NOT NULL THEN 'feed' END AS original_author_source, coalesce(lang, '') AS original_language, 'not stated; copyright assumed' AS original_license, 'inferred' AS original_license_source FROM m"""
)
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records, every fifth with what its page said: filled fields stay, the status is always new; then what is still missing is completed."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    current = d.select(n.alias("id"), F.lit("feed title").alias("title"), F.when(n % 2 == 0, F.col("source")).alias("author"), F.when(n % 3 == 0, "old").alias("status"), F.coalesce("lang", F.lit("")).alias("original_language"))
    fetched = d.filter(n % 5 == 0).select(n.alias("id"), F.lit("found").alias("author"), F.lit("ok").alias("status"), F.concat(F.lit("Page "), n).alias("page_title"))
    out = pages.complete_metadata(pages.merge_metadata(current, fetched, ["author", "status", "page_title"]))
    return out.select("id", "author", "status", "original_title", "original_title_source", "original_author", "original_author_source", F.coalesce("original_language", F.lit("")).alias("original_language"), "original_license", "original_license_source")


@query(
    f"""WITH d AS (SELECT doc_id AS id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'image' END, CASE WHEN doc_id % 3 = 0 THEN 'description' END, CASE WHEN doc_id % 5 = 0 THEN 'article' END], lambda x : x IS NOT NULL) AS missing,
        CASE WHEN doc_id % 4 <> 0 THEN DATE '{TODAY}' - (doc_id % 20)::INT END AS tried FROM documents)
    SELECT id, array_to_string(missing, ' ') AS missing, strftime(tried, '%Y-%m-%d') AS last_attempt_at FROM d WHERE len(missing) > 0 AND (tried IS NULL OR tried <= DATE '{TODAY}' - 7) ORDER BY tried NULLS FIRST, id LIMIT 80"""
)
def pages_to_try(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eighty records that lack something and are due for another look, those never tried before others."""
    n = F.col("doc_id")
    given = lambda k, v: F.when(n % k != 0, v)
    d = table(spark, sf_dir, "documents").select(n.alias("id"), pages.missing_fields(given(2, "i"), given(3, "d"), given(5, "a")).alias("missing_fields"), F.when(n % 4 != 0, F.date_sub(F.lit(TODAY).cast("date"), (n % 20).cast("int")).cast("string")).alias("last_attempt_at"))
    return pages.enrichment_queue(d, NOW).select("id", F.array_join("missing_fields", " ").alias("missing"), "last_attempt_at")


@query(
    """WITH d AS (SELECT doc_id AS id, list_filter([CASE WHEN doc_id % 4 = 0 THEN 'https://i.org/own' END, CASE WHEN doc_id % 3 <> 0 THEN 'https://i.org/shown-' || doc_id END, CASE WHEN doc_id % 5 = 0 THEN 'https://j.org/bare.png' END], lambda x : x IS NOT NULL) AS c FROM documents)
    SELECT id, array_to_string(c, ' ') AS candidates FROM d WHERE len(c) > 0 AND id % 7 <> 0"""
)
def images_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a valid image, and the addresses where one may be: a field, an image in the summary, a bare link in it."""
    n = F.col("doc_id")
    summary = F.concat(F.lit("text "), F.when(n % 3 != 0, F.concat(F.lit("<IMG alt=x src='https://i.org/shown-"), n, F.lit("'> "))).otherwise(""), F.when(n % 5 == 0, "see https://j.org/bare.png, twice https://j.org/bare.png").otherwise(""))
    d = table(spark, sf_dir, "documents").select(n.alias("id"), F.when(n % 4 == 0, " https://i.org/own ").otherwise("none").alias("image_url"), summary.alias("summary"))
    d = d.withColumn("image_candidates", pages.image_candidates(["image_url"], "summary"))
    return pages.image_targets(d, d.filter("id % 7 = 0")).select("id", F.array_join("image_candidates", " ").alias("candidates"))


@query(
    """SELECT conv_id AS id, arg_min('p' || turn, CASE turn WHEN 3 THEN '0' WHEN 1 THEN '1' ELSE '2p' || turn END) AS provider FROM conversations GROUP BY conv_id"""
)
def chosen_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items, each turn a provider's translation: the third's before the first's, then others by name."""
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").alias("item_id"), F.concat(F.lit("p"), "turn").alias("provider"), F.col("role").alias("title"), F.col("text").alias("markdown"))
    return claims.apply_translation(c.select(F.col("conv_id").alias("id")).distinct(), t, ["p3", "p1"]).select("id", "translation.provider")


@query(
    f"""SELECT doc_id AS id FROM documents ORDER BY CASE WHEN doc_id % 9 = 0 AND doc_id % 2 = 0 THEN 0 WHEN doc_id % 9 = 0 THEN 1 ELSE 2 END, strftime(DATE '{TODAY}' - (doc_id % 40)::INT, '%Y-%m-%d') DESC, doc_id LIMIT 50"""
)
def reading_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty records for review: in reading for a day, in reading, the rest; the newest first within each."""
    n = F.col("doc_id")
    flags = F.struct((n % 9 == 0).alias("current_reading"), F.when(n % 2 == 0, "2024-01-20 00:00:00").otherwise("2024-01-30 20:00:00").alias("started_at"))
    d = table(spark, sf_dir, "documents").select(n.alias("id"), F.date_sub(F.lit(TODAY).cast("date"), (n % 40).cast("int")).cast("string").alias("captured_at"), flags.alias("reader_flags"))
    return claims.priority_order(d, NOW, 50).select("id")


@query(
    """WITH a AS (SELECT DISTINCT doc_id AS id FROM labels), named AS (SELECT id, unnest([id + 3, id, id + 1]) AS item, unnest([0, 1, 2]) AS pos FROM a), found AS (SELECT n.* FROM named n JOIN documents d ON d.doc_id = n.item)
    SELECT a.id AS article_id, string_agg(item::VARCHAR, ' ' ORDER BY pos) AS items, arg_min(CASE WHEN item % 3 = 0 THEN 'https://i.org/' || item END, CASE WHEN item % 3 = 0 THEN pos END) AS hero_image FROM a LEFT JOIN found USING (id) GROUP BY a.id"""
)
def article_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as articles that name three items each: those there are, in order, and the first picture among them."""
    n = F.col("doc_id")
    a = table(spark, sf_dir, "labels").select(n.alias("id"), F.array(n + 3, n, n + 1).alias("item_ids")).distinct()
    i = table(spark, sf_dir, "documents").select(n.alias("id"), F.lit("t").alias("title"), F.when(n % 3 == 0, F.concat(F.lit("https://i.org/"), n)).alias("image_url"))
    b = listings.article_bridge(a, i)
    return b.select("article_id", F.when(F.col("items").isNotNull(), F.array_join(F.transform("items", lambda x: x["id"].cast("string")), " ")).alias("items"), "hero_image")


@query(
    """WITH w AS (SELECT page_id AS pos, page_id * 2 AS id FROM pages) SELECT pos, id, CASE WHEN id % 3 <> 0 THEN 'item' ELSE 'candidate' END AS found_in FROM w JOIN documents ON doc_id = id WHERE id % 3 <> 0 OR id % 2 = 0"""
)
def records_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a list of ids: items, and candidates where no item has the id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    i, c = d.filter("id % 3 <> 0").withColumn("found_in", F.lit("item")), d.filter("id % 2 = 0").withColumn("found_in", F.lit("candidate"))
    return listings.ordered_records(table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), (F.col("page_id") * 2).alias("id")), i, c).select("pos", "id", "found_in")


@query(
    """WITH k AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[?#].*$', ''), '/') AS loose FROM pages) SELECT page_id AS id FROM k WHERE loose NOT IN (SELECT loose FROM k WHERE page_id % 3 = 0)"""
)
def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as recommended links that are none of every third one's, which come with another scheme and a fragment."""
    p = table(spark, sf_dir, "pages")
    given = p.filter("page_id % 3 = 0").select(F.concat(F.regexp_replace(F.regexp_replace("url", "^https?", "HTTP"), "[?#].*$", ""), F.lit("/#x")).alias("url"))
    return listings.new_recommendations(p.select(F.col("page_id").alias("id"), "url"), given).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0")
def articles_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that are published; their state is written in several ways."""
    n = F.col("doc_id")
    a = table(spark, sf_dir, "documents").select(n.alias("id"), F.when(n % 3 == 0, " published ").when(n % 3 == 1, "Published soon").alias("status"), F.lit(TODAY).alias("updated_at"))
    return listings.published_articles(a).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0")
def licences_to_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a licence that none has set by hand."""
    n = F.col("doc_id")
    licence = F.struct(F.when(n % 3 != 0, "CC BY 4.0").alias("name"), F.struct(F.when(n % 5 == 0, "manual").alias("method")).alias("provenance"))
    return licences.backfill_scope(table(spark, sf_dir, "documents").select(n.alias("id"), licence.alias("license")), True).select("id")


@query(
    """WITH v AS (SELECT page_id AS pos, 'v' || (page_id * 3) AS id FROM pages WHERE page_id * 3 IN (SELECT doc_id FROM documents)) SELECT 0 AS part, pos, id FROM v UNION ALL SELECT 1, 0, 'n' || doc_id FROM documents WHERE doc_id % 10 = 0"""
)
def viewpoints_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen viewpoints in their order, then personal notes of items."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    v = d.select(F.concat(F.lit("v"), n).alias("id"), F.col("text").alias("body"))
    chosen = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.concat(F.lit("v"), F.col("page_id") * 3).alias("id"))
    i = d.select(F.concat(F.lit("n"), n).alias("id"), F.struct(F.when(n % 10 == 0, "a note").otherwise("").alias("body")).alias("personal_notes"))
    return listings.viewpoint_corpus(v, chosen, i).select("part", F.col("pos").cast("long").alias("pos"), "id")
