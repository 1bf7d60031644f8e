"""Queries over what one run leaves to the next: windows, gates, health, chunks, exports, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import claims, ingest
from quillmill.plans.registry import query
from quillmill.plans.views import ITEMS_SQL, NOW, SOURCES_SQL, TODAY, items, outcomes, sources, table
from quillmill.sources.records import export_tables


@query(
    f"""WITH {SOURCES_SQL} SELECT o.source_id, o.happened < TIMESTAMP '{NOW}'::DATE - CASE WHEN regexp_extract(o.source_id, '([0-9]+)$', 1)::BIGINT % 5 = 0 THEN 90 ELSE 7 END AS too_old, count(*) AS n FROM outcomes o GROUP BY ALL"""
)
def entries_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as entries of their sources; sources that were never fetched have the longer window."""
    n = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    never = n % 5 == 0
    s = sources(spark, sf_dir).withColumn("last_fetched_at", F.when(~never, F.col("last_fetched_at"))).withColumn("rss_health", F.when(~never, F.col("rss_health")))
    e = outcomes(spark, sf_dir).withColumnRenamed("at", "published_at")
    return ingest.recent_entries(e, s, NOW).groupBy("source_id", "too_old").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {ITEMS_SQL}, hay AS (SELECT *, replace(lower(concat_ws(chr(10), coalesce(title, ''), coalesce(summary, ''), coalesce(source_id, ''), '', concat_ws(' ', source_id, lang), url)), 'ß', 'ss') AS hay FROM items)
    SELECT id, contains(hay, 'scum') OR contains(hay, 'idiot') OR (length(source_id) % 2 = 0 AND NOT contains(hay, 'token') AND NOT contains(hay, 'therest')) AS blocked FROM hay"""
)
def gated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against the word lists of their sources: all exclude two words, every other one by the length of its name requires one of two."""
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().filter("id is not null")
    s = s.withColumn("required_keywords", F.when(F.length("id") % 2 == 0, words("token", " Therest "))).withColumn("excluded_keywords", words("Scum", "idiot"))
    return ingest.source_keyword_gate(items(spark, sf_dir), s).select("id", F.coalesce("blocked", F.lit(False)).alias("blocked"))


@query(f"WITH {ITEMS_SQL} SELECT id FROM items WHERE captured >= DATE '{TODAY}' - 90")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the last ninety days, by the time they were captured."""
    return ingest.recent_history(items(spark, sf_dir).withColumn("dismissed_at", F.lit(None).cast("string")), NOW).select("id")


@query(
    f"""WITH {SOURCES_SQL}, told AS (SELECT *, regexp_extract(id, '([0-9]+)$', 1)::BIGINT AS n, strftime(last, '%Y-%m-%dT%H:%M:%S') AS last_text FROM sources)
    SELECT id, CASE WHEN n % 3 = 0 OR n % 17 = 0 THEN '{NOW}' ELSE last_text END AS last_checked_at, CASE WHEN n % 17 = 0 THEN last_text WHEN n % 3 = 0 THEN '{NOW}' ELSE last_text END AS last_success_at,
        CASE WHEN n % 17 = 0 THEN 'failed' WHEN n % 3 = 0 THEN 'ok' ELSE fetch_status END AS last_fetch_status, CASE WHEN n % 17 = 0 THEN 'timeout' ELSE '' END AS last_error,
        CASE WHEN n % 3 = 0 THEN 7 ELSE 0 END AS entries_seen, CASE WHEN n % 3 = 0 THEN 2 ELSE new_items END::INT AS new_items FROM told"""
)
def health_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third source was fetched, every seventeenth failed; the others keep what they had."""
    s = sources(spark, sf_dir)
    n = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    counts = {"entries_seen": 7, "new_items": 2, "skipped_old": 1, "skipped_duplicate_recent": 3, "skipped_source_keywords": 1}
    stats = s.filter(n % 3 == 0).select(F.col("id").alias("source_id"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])
    failed = s.filter(n % 17 == 0).select(F.col("id").alias("source_id"), F.lit("timeout").alias("error"))
    h = [F.col(f"rss_health.{c}") for c in ("last_checked_at", "last_success_at", "last_fetch_status", "last_error", "entries_seen", "new_items")]
    return ingest.write_back_health(s, stats, NOW, failed).select("id", *h)


@query("SELECT conv_id AS item_id, turn AS chunk_no FROM conversations WHERE turn % 2 = 1 OR conv_id % 5 = 0")
def chunks_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as chunks of texts: even ones are done, but every fifth text has changed since."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("chunk_no"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("source_hash"))
    done = c.filter("chunk_no % 2 = 0").withColumn("source_hash", F.when(F.col("item_id") % 5 == 0, "of before").otherwise(F.col("source_hash")))
    return ingest.resume_chunks(c, done).select("item_id", "chunk_no")


@query(
    """WITH e AS (SELECT DISTINCT doc_id, quality, toxic FROM labels) SELECT doc_id AS item_id, quality AS score, CASE toxic WHEN 1 THEN 'second' ELSE 'first' END AS reviewer FROM e
    WHERE doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM documents) AND doc_id % 7 <> 0"""
)
def exported_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as review events of documents, of which every second one is exported; those seeded by hand, every seventh, stay."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    reviewer = F.when(F.col("doc_id") % 7 == 0, "manual-seed").when(F.col("toxic") == 1, "second").otherwise("first")
    e = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct().select(F.col("doc_id").alias("item_id"), F.col("quality").alias("score"), reviewer.alias("reviewer"))
    return export_tables(d, d, e, d)["review_events"]


@query(
    """WITH r AS (SELECT conv_id, role, turn, length(text) % 3 AS rec FROM conversations WHERE role IS NOT NULL), last AS (SELECT conv_id, role, max(turn) AS turn, arg_max(rec, turn) AS rec FROM r GROUP BY ALL)
    SELECT conv_id AS id, count(*) AS n_providers, arg_max(rec, CASE role WHEN 'assistant' THEN 1000000 ELSE 0 END + turn) AS recommendation FROM last GROUP BY conv_id"""
)
def chosen_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items and their turns as reviews by role: the last of each role counts, and the assistant's before others."""
    c = table(spark, sf_dir, "conversations").filter("role is not null")
    reviews = c.select(F.col("conv_id").alias("item_id"), F.col("role").alias("provider"), F.col("turn").alias("at"), (F.length("text") % 3).alias("recommendation"), F.col("text").alias("summary"), F.lit(None).cast("array<string>").alias("reasons"))
    done = claims.apply_reviews(c.select(F.col("conv_id").alias("id")).distinct(), reviews, "assistant")
    return done.select("id", F.size(F.map_keys("reviews")).cast("long").alias("n_providers"), F.col("chosen_review.recommendation").cast("long").alias("recommendation"))
