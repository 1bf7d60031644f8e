"""Imports of starred entries, subscription lists and tracking sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.dates import epoch_date, parse_any_date
from quillmill.functions.text import clean_text, fold, match_terms, stable_id, strip, text


def infer_source_type(name: Column, feed_url: Column, site_url: Column) -> Column:
    hay = fold(F.concat_ws(" ", text(name), text(feed_url), text(site_url)))
    rules = [("google-alert", "google.com/alerts|google alert"), ("youtube", "youtube.com"), ("newsletter", "substack|newsletter"), ("social", "facebook|twitter|mastodon|reddit"), ("podcast", "podcast")]
    out = F.when(text(feed_url) != "", "rss").otherwise("website")
    for kind, pattern in reversed(rules):
        out = F.when(hay.rlike(pattern), kind).otherwise(out)
    return out


def infer_track(hay: Column, lists: list[tuple[str, list[str]]]) -> Column:
    """The first track one of whose terms occurs; the order of the lists decides between them."""
    out = F.lit("unclassified")
    for track, terms in reversed(lists):
        out = F.when(F.size(match_terms(fold(hay), terms)) > 0, track).otherwise(out)
    return out


def import_starred(entries: DataFrame, sources: DataFrame, lists: list[tuple[str, list[str]]], now: str) -> tuple[DataFrame, DataFrame]:
    """(items, sources to add) of starred entries: title, canonical and alternate (arrays of structs with href), published (epoch), summary, categories, origin (streamId, htmlUrl, title).

    The address is the canonical one, else the alternate, else the site. A source is found by its feed, else by its site; those found by neither are made up from the entry.
    """
    href = lambda c: F.coalesce(F.get(F.col(c), F.lit(0))["href"], F.lit(""))
    first = lambda *cols: F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))
    labels = F.filter(F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.regexp_extract(c, "/label/(.+)$", 1)), lambda v: v != "")
    e = entries.select(
        clean_text("title", "feed", 300).alias("title"), first(href("canonical"), href("alternate"), text("origin.htmlUrl")).alias("url"), epoch_date("published").cast("date").cast("string").alias("published_at"),
        clean_text("summary", "feed", 1200).alias("summary"), F.array_distinct(labels).alias("tags"), F.regexp_replace(text("origin.streamId"), "^feed/", "").alias("__feed"), text("origin.htmlUrl").alias("__site"), clean_text("origin.title", "feed", 160).alias("__name"),
    )
    key = lambda c, name: sources.filter(text(c) != "").groupBy(F.col(c).alias(name)).agg(F.min("id").alias(f"__by{name}"))
    j = e.join(key("feed_url", "__feed"), "__feed", "left").join(key("site_url", "__site"), "__site", "left")
    made = stable_id("source", "__feed", "__site", "__name")
    j = j.withColumn("source_id", F.coalesce("__by__feed", "__by__site", made)).withColumn("__new", F.coalesce("__by__feed", "__by__site").isNull())
    track = infer_track(F.concat_ws(" ", "title", "summary", F.array_join("tags", " "), "__name"), lists)
    items = j.select(
        stable_id("item", "url", "title").alias("id"), track.alias("track"), F.lit("inbox").alias("status"), "title", "url", "source_id", F.col("__name").alias("source_name"), "published_at",
        F.lit(now).alias("captured_at"), "summary", "tags", F.lit("inoreader-starred").alias("origin"),
    )
    added = j.filter("__new").groupBy(F.col("source_id").alias("id")).agg(F.min("__name").alias("name"), F.min("__feed").alias("feed_url"), F.min("__site").alias("site_url"))
    return items, added.withColumn("source_type", infer_source_type(F.col("name"), F.col("feed_url"), F.col("site_url")))


def import_subscriptions(rows: DataFrame, lists: list[tuple[str, list[str]]]) -> DataFrame:
    """Sources of subscription rows: group_path (array), title, xml_url, html_url. One row per feed; the first group by name stays."""
    group = F.array_join("group_path", " / ")
    s = rows.select(
        stable_id("source", "xml_url", "title").alias("id"), infer_track(F.concat_ws(" ", group, "title", "xml_url"), lists).alias("track"), clean_text("title", "feed", 160).alias("name"), group.alias("source_group"),
        infer_source_type(F.col("title"), F.col("xml_url"), F.col("html_url")).alias("source_type"), F.lit("daily").alias("fetch_frequency"), F.col("xml_url").alias("feed_url"), F.col("html_url").alias("site_url"), F.lit("active").alias("status"),
    )
    return s.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("source_group"))).filter("__n = 1").drop("__n")


def import_sheet_rows(rows: DataFrame, names: dict[str, list[str]], lists: list[tuple[str, list[str]]], now: str) -> DataFrame:
    """Items of tracking sheets: sheet, row_no, cells (map). names: for title, url, summary, author and date the headers that may carry it, in order.
    Rows with fewer than two filled cells are left out; the cells stay as a map."""
    filled = F.map_filter("cells", lambda k, v: strip(text(v)) != "")
    cell = lambda kind: F.coalesce(*[F.when(strip(text(F.try_element_at("cells", F.lit(n)))) != "", strip(text(F.try_element_at("cells", F.lit(n))))) for n in names.get(kind, [])], F.lit(""))
    any_url = F.regexp_extract(F.concat_ws(" ", F.map_values("cells")), r"(https?://[^\s\"'<>]+)", 1)
    url = F.when(cell("url") != "", cell("url")).otherwise(any_url)
    return rows.filter(F.size(F.map_keys(filled)) >= 2).select(
        stable_id("item", url, cell("title"), F.concat_ws(":", "sheet", F.col("row_no").cast("string"))).alias("id"), infer_track(F.concat_ws(" ", "sheet", F.map_values("cells")), lists).alias("track"), F.lit("inbox").alias("status"),
        clean_text(cell("title"), "feed", 300).alias("title"), url.alias("url"), clean_text(cell("author"), "feed", 160).alias("author"), parse_any_date(cell("date"), serials=True).cast("date").cast("string").alias("published_at"),
        F.lit(now).alias("captured_at"), clean_text(cell("summary"), "feed", 1200).alias("summary"), F.concat(F.lit("xlsx:"), F.col("sheet")).alias("origin"), filled.alias("raw_columns"),
    )
