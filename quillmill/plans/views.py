"""The driver's tables as tables of the pipeline, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import stable_id
from quillmill.operators.triage import Keywords, Taste

NOW = "2024-01-31 00:00:00"
TODAY = "2024-01-31"
CONFIG = {
    "open": Keywords(keep=("onthat", "herein", "standing", "blethe"), skip=("worthless", "idiot", "clown"), mechanism=("token", "license")),
    "local": Keywords(keep=("einung", "mentelle", "ciónar"), skip=("pathetic", "scum", "idiot"), mechanism=("token", "lizenz")),
}
TASTE = Taste(themes={"open": ("thing", "hand"), "local": ("heit",)}, avoid={"open": ("scum",)}, locality=("Ar", "Er"), beats=("inghand",), tracked={"rest": ("therest", "enest")})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as items; the whole text is the summary."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    quality = F.col("quality")
    captured = F.date_sub(F.lit(TODAY).cast("date"), (F.col("doc_id") % 120).cast("int"))
    action = F.when(quality == 1, "accepted-for-editing").when(quality == 0, "rejected")
    return d.select(
        "doc_id", stable_id("item", "doc_id").alias("id"), F.when(F.col("lang") == "en", "open").otherwise("local").alias("track"),
        F.when(quality == 1, "triaged").when(quality == 0, "parked").otherwise("inbox").alias("status"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"),
        F.col("source").alias("source_id"), F.col("source").alias("source_name"), F.lit(None).cast("string").alias("author"), F.array_compact(F.array("source", "lang")).alias("tags"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id")).alias("url"), captured.cast("string").alias("captured_at"), F.date_sub(captured, (F.col("doc_id") % 7).cast("int")).cast("string").alias("published_at"),
        F.lit("rss-fetch").alias("origin"), F.when(action.isNotNull(), F.struct(action.alias("action"), F.when(quality == 0, F.when(F.col("toxic") == 1, "toxic").otherwise("low quality")).alias("reason"), F.lit(None).cast("string").alias("decided_at"))).alias("local_decision"),
    )


ITEMS_SQL = f"""
    lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
    items AS (
        SELECT d.doc_id, 'item-' || substr(sha1(d.doc_id::VARCHAR), 1, 16) AS id, CASE WHEN lang = 'en' THEN 'open' ELSE 'local' END AS track,
            CASE quality WHEN 1 THEN 'triaged' WHEN 0 THEN 'parked' ELSE 'inbox' END AS status, split_part(text, chr(10), 1) AS title, text AS summary, source AS source_id, lang,
            DATE '{TODAY}' - (d.doc_id % 120)::INT AS captured, DATE '{TODAY}' - (d.doc_id % 120)::INT - (d.doc_id % 7)::INT AS published,
            CASE quality WHEN 1 THEN 'collected' WHEN 0 THEN 'rejected' END AS outcome, CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low quality' END END AS reason,
            'https://' || source || '.example.org/' || d.doc_id AS url
        FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id
    )"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as feed entries of the host's source, and each once more as another source reposts it, with a tracker, a slash or a fragment added."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    own = p.select(F.lit(0).alias("turn"), F.col("page_id").alias("pos"), host.alias("source_id"), "url")
    tail = F.when(F.col("url").contains("#"), F.col("url")).when(F.col("url").contains("?"), F.concat("url", F.lit("&utm_source=x"))).when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/"))).otherwise(F.concat("url", F.lit("#again")))
    again = p.select(F.lit(1).alias("turn"), F.col("page_id").alias("pos"), F.lit("reposts").alias("source_id"), tail.alias("url"))
    return own.unionByName(again).withColumn("id", stable_id("entry", "turn", "pos"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as what became of records: (source_id, outcome, at)."""
    kinds = {"purchase": "accepted", "signup": "pending", "error": "rejected", "view": "duplicate", "click": "blocked"}
    return table(spark, sf_dir, "events").select(F.concat(F.lit("source-"), "user_id").alias("source_id"), F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")).alias("outcome"), F.col("ts").cast("timestamp").alias("at"))


OUTCOMES_SQL = """
    outcomes AS (SELECT 'source-' || user_id AS source_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'duplicate' WHEN 'click' THEN 'blocked' END AS outcome,
        ts::TIMESTAMP AS happened FROM events)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source for each user of events: last fetched at its last event, with the counts of its last week as the last run."""
    o = outcomes(spark, sf_dir)
    week = F.col("at") >= F.expr("timestamp '2024-01-24 00:00:00'")
    count = lambda name: F.count_if(week & (F.col("outcome") == name)).cast("int")
    g = o.groupBy("source_id").agg(F.max("at").alias("last"), count("accepted").alias("new"), count("duplicate").alias("dup"), count("blocked").alias("blk"))
    n = F.regexp_extract("source_id", "([0-9]+)$", 1).cast("long")
    frequency = F.element_at(F.array(*[F.lit(x) for x in ("hourly", "6h", "daily", "weekly", "monthly", "paused", "manual")]), (n % 7 + 1).cast("int"))
    text_time = F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss")
    return g.select(
        F.col("source_id").alias("id"), F.when(n % 2 == 0, "open").otherwise("local").alias("track"), F.col("source_id").alias("name"), frequency.alias("fetch_frequency"), F.lit("rss").alias("source_type"),
        F.when(n % 11 == 0, "archived").otherwise("active").alias("status"), F.concat(F.lit("https://"), "source_id", F.lit(".example.org/feed")).alias("feed_url"), text_time.alias("last_fetched_at"),
        F.struct(text_time.alias("last_checked_at"), text_time.alias("last_success_at"), F.when(n % 13 == 0, "failed").otherwise("ok").alias("last_fetch_status"), F.lit("").alias("last_error"), F.lit(0).alias("entries_seen"),
            F.col("new").alias("new_items"), F.lit(0).alias("skipped_old"), F.col("dup").alias("skipped_duplicate_recent"), F.col("blk").alias("skipped_source_keywords")).alias("rss_health"),
    )


SOURCES_SQL = (
    OUTCOMES_SQL
    + """,
    grouped AS (SELECT source_id, regexp_extract(source_id, '([0-9]+)$', 1)::BIGINT AS n, max(happened) AS last, count(*) FILTER (outcome = 'accepted' AND happened >= TIMESTAMP '2024-01-24') AS new_items,
        count(*) FILTER (outcome = 'duplicate' AND happened >= TIMESTAMP '2024-01-24') AS dup, count(*) FILTER (outcome = 'blocked' AND happened >= TIMESTAMP '2024-01-24') AS blk FROM outcomes GROUP BY source_id),
    sources AS (SELECT source_id AS id, ['hourly', 'six-hourly', 'daily', 'weekly', 'monthly', 'paused', 'on-update'][(n % 7 + 1)::INT] AS frequency, CASE WHEN n % 11 = 0 THEN 'archived' ELSE 'active' END AS status,
        CASE WHEN n % 13 = 0 THEN 'failed' ELSE 'ok' END AS fetch_status, date_trunc('second', last) AS last, new_items, dup, blk FROM grouped)"""
)
