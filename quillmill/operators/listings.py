"""Listings for readers: order, neighbours, sections, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.dates import first_date
from quillmill.functions.text import clean_text, let, strip, strip_markdown, text
from quillmill.functions.urls import loose_url_key
from quillmill.operators.triage import is_reader_item
from quillmill.plans.working import stored

KINDS = {"featured-article": 0, "small-news": 1, "needs-review": 2}


def kind_rank(kind: Column | str = "kind") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col(kind) if isinstance(kind, str) else kind), F.lit(len(KINDS)))


def public_items(items: DataFrame, track: str) -> DataFrame:
    return items.filter((F.col("track") == track) & is_reader_item() & F.col("kind").isin(*KINDS))


def reader_order() -> list[Column]:
    """By kind, then newest, with title and id to break ties."""
    return [kind_rank(), F.desc("time"), F.desc(text("title")), F.desc("id")]


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `pos`, 0 and up in the order, without one task numbering all: rows are range-partitioned and sorted, and each partition starts after the rows of
    those before it. The number of partitions, not of rows, is what the driver sees."""
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(max(2, spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    sorted_ = stored(sorted_, "sorted")
    sizes = sorted_.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    starts, total = {}, 0
    for r in sizes:
        starts[r["__part"]] = total
        total += r["n"]
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return sorted_.withColumn("pos", (within - 1 + F.try_element_at(base, F.col("__part"))).cast("long")).drop("__part")


def with_neighbours(placed: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with a `pos`, and the ids before and after each; two joins on the position instead of one global window."""
    at = lambda shift, name: placed.select((F.col("pos") + shift).alias("pos"), F.col(id_col).alias(name))
    return placed.join(at(1, "previous_id"), "pos", "left").join(at(-1, "next_id"), "pos", "left")


def homepage_order(groups: list[DataFrame], order: list[Column]) -> DataFrame:
    """Groups one after another; a record that is in several stands in the first. Returns their rows with `group_no`, to be ordered by it and `order`."""
    both = None
    for k, g in enumerate(groups):
        g = g.withColumn("group_no", F.lit(k))
        both = g if both is None else both.unionByName(g, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("id").orderBy("group_no"))
    return both.withColumn("__n", first).filter("__n = 1").drop("__n").orderBy("group_no", *order)


def period_counts(items: DataFrame, period: str = "month") -> DataFrame:
    """Records by period, newest first, with the time of its newest."""
    return items.filter("time is not null").groupBy(F.date_trunc(period, "time").cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n_items"), F.max("time").alias("newest")).orderBy(F.desc("period"))


def time_range(items: DataFrame, preset: str, today: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Items of a preset range: 3d, 7d, 30d, quarter, year, custom (half-open) or all; undated ones only under all."""
    day, at = F.lit(today).cast("date"), F.col("time").cast("date")
    since = {"3d": F.date_sub(day, 3), "7d": F.date_sub(day, 7), "30d": F.date_sub(day, 30), "quarter": F.trunc(day, "quarter"), "year": F.trunc(day, "year")}
    if preset == "all":
        return items
    if preset == "custom":
        return items.filter((at >= F.lit(start).cast("date")) & (at < F.lit(end).cast("date")))
    return items.filter(at >= since[preset])


def sections(items: DataFrame, key: str, most: int, order: list[Column]) -> DataFrame:
    """The first `most` records of each value of key."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)


def public_listing(items: DataFrame, track: str) -> DataFrame:
    """Public items in reader's order with positions and neighbours."""
    timed = items.withColumn("time", first_date("published_at", "captured_at"))
    return with_neighbours(positions(public_items(timed, track), reader_order()))


def _topic_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Published topic pages with all their items: by tag, or by source. Items meet pages over one join on (type, key); pages are few, but no size is assumed."""
    shown = pages.filter("published").select("slug", "type", "key")
    none = F.array().cast("array<string>")
    facts = F.array_distinct(F.concat(F.transform(F.coalesce("tags", none), lambda t: F.struct(F.lit("tag").alias("type"), t.alias("key"))), F.array(F.struct(F.lit("source").alias("type"), text("source_id").alias("key")))))
    keyed = items.select("id", "title", "kind", "time", F.explode(facts).alias("f")).select("id", "title", "kind", "time", "f.type", "f.key")
    return keyed.join(shown, ["type", "key"])


def topic_listing(pages: DataFrame, items: DataFrame, most: int = 180) -> DataFrame:
    """The first items of each published topic page."""
    return sections(_topic_items(pages, items), "slug", most, reader_order())


def topic_counts(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(slug, n_items, n_primary, n_small_news, n_other) of published topic pages, over all their items; pages without items count none."""
    kind = F.coalesce("kind", F.lit(""))
    primary, small = kind.isin("featured-article", "needs-review"), kind == "small-news"
    many = lambda test: F.count(F.when(test, 1))
    found = _topic_items(pages, items).groupBy("slug").agg(F.count(F.lit(1)).alias("n_items"), many(primary).alias("n_primary"), many(small).alias("n_small_news"), many(~primary & ~small).alias("n_other"))
    return pages.filter("published").select("slug").distinct().join(found, "slug", "left").fillna(0, ["n_items", "n_primary", "n_small_news", "n_other"])


def published_articles(articles: DataFrame) -> DataFrame:
    """Articles of status `published`, the last changed first; ties by id."""
    return articles.filter(strip(text("status")) == "published").orderBy(F.desc(text("updated_at")), "id")


def article_bridge(articles: DataFrame, items: DataFrame) -> DataFrame:
    """(article_id, items, hero_image): the items an article names, in its order, missing ones left out; the first with an image gives the picture."""
    named = articles.select(F.col("id").alias("article_id"), F.posexplode("item_ids").alias("pos", "id"))
    found = named.join(items.select("id", "title", "image_url"), "id")
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "title")))
    hero = F.min_by("image_url", F.when(text("image_url") != "", F.col("pos")))
    g = found.groupBy("article_id").agg(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"))).alias("items"), hero.alias("hero_image"))
    return articles.select(F.col("id").alias("article_id")).join(g, "article_id", "left")


def ordered_records(wanted: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Records of a list of ids (pos, id) in its order; an item is preferred over a candidate of the same id."""
    both = items.withColumn("__p", F.lit(0)).unionByName(candidates.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    best = both.join(wanted, "id").withColumn("__n", F.row_number().over(Window.partitionBy("id", "pos").orderBy("__p")))
    return best.filter("__n = 1").drop("__n", "__p").orderBy("pos")


def stale_outputs(published: DataFrame, expected: DataFrame, key: str = "slug") -> DataFrame:
    """What was published and is no longer expected, to be retracted."""
    return published.select(key).distinct().join(expected.select(key), key, "left_anti")


def viewpoint_corpus(viewpoints: DataFrame, chosen: DataFrame, items: DataFrame) -> DataFrame:
    """The chosen viewpoints in their order (chosen: pos, id), then the personal notes of items that have some."""
    own = viewpoints.join(chosen, "id").select(F.lit(0).alias("part"), "pos", "id", F.col("body").alias("text"))
    notes = items.filter(text("personal_notes.body") != "").select(F.lit(1).alias("part"), F.lit(0).alias("pos"), "id", F.col("personal_notes.body").alias("text"))
    return own.unionByName(notes).orderBy("part", "pos", "id")


def tag_union(items: DataFrame) -> DataFrame:
    """All tags of the records, sorted and distinct, one row each."""
    return items.select(F.explode("tags").alias("tag")).filter("tag != ''").distinct().orderBy("tag")


def new_recommendations(recommendations: DataFrame, inputs: DataFrame) -> DataFrame:
    """Recommended links that are no input, by loose address."""
    keyed = lambda df: df.withColumn("__k", loose_url_key("url"))
    return keyed(recommendations).join(keyed(inputs).select("__k"), "__k", "left_anti").drop("__k")


def title_fields(chain: str, reviewers: list[str]) -> list[str]:
    """Where a record's title stands, in order of trust, for one of its uses: `record`, `relation` (titles to be compared), `translation`, or `review` (with display_title). Reviewers are named in their order;
    the first of them is the primary one."""
    reviews = [f"editorial_triage.{r}_review.zh_title" for r in reviewers]
    edited, translated = "editorial_triage.zh_title", "reading_metadata.translated_zh_title"
    return {
        "record": ["editorial_title", "reading_metadata.editorial_title", *reviews, edited, *[f"editorial_triage.{r}_zh_title" for r in reviewers[:1]], translated, "title", "url", "id"],
        "relation": ["editorial_title", "reading_metadata.editorial_title", edited, translated, "title", "url"],
        "translation": ["editorial_title", *reviews[:1], edited, translated, "reading_metadata.title", "title"],
        "review": [*reviews, edited],
    }[chain]


def first_title(columns: list[str], limit: int = 320, markdown: bool = False) -> Column:
    """The first of several title columns that has text, cleaned; empty if none has. With markdown, its marks go."""
    tidy = (lambda c: strip_markdown(c, limit)) if markdown else (lambda c: clean_text(c, limit=limit))
    return F.coalesce(*[let(tidy(c), lambda v: F.when(v != "", v)) for c in columns], F.lit(""))


def display_title(columns: list[str], limit: int = 320) -> Column:
    """The first of several title columns, in order of trust, that has text and is no placeholder."""
    clean = [strip_markdown(c, limit) for c in columns]
    return F.coalesce(*[F.when((c != "") & ~is_placeholder_title(c), c) for c in clean], F.lit(""))


def is_placeholder_title(title: Column) -> Column:
    """Titles of the kind "about X: untranslated material: ...", which stand in for one that is to be written."""
    return title.rlike(r"^關於[^：:\n]{1,120}的(?:英文|外文|外語|非中文)?資料[：:]\s*.+$")
