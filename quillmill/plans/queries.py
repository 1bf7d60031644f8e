"""Queries over the driver's tables, one or more for each group of operators, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.dates import first_date
from quillmill.functions.text import extract_identifiers, infer_language, stable_id
from quillmill.functions.urls import loose_url_key, normalize_url
from quillmill.operators import checks, claims, health, history, ingest, licences, listings, markdown, pages, relations, summaries, triage
from quillmill.plans.registry import ORACLE_SQL, QUERIES, query
from quillmill.plans.views import CONFIG, ITEMS_SQL, NOW, OUTCOMES_SQL, SOURCES_SQL, TASTE, TODAY, entries, items, outcomes, sources, table
from quillmill.plans.working import shared_dir
from quillmill.sources.feeds import explode_feeds
from quillmill.streaming.jobs import rolling_outcomes

def _any(terms: tuple[str, ...], column: str = "hay") -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")" if terms else "FALSE"


def _hits(terms: tuple[str, ...], column: str = "hay") -> str:
    return "(" + " + ".join(f"contains({column}, '{t}')::INT" for t in terms) + ")" if terms else "0"


def _per_track(part: str, how: Callable[[tuple[str, ...]], str] = _any) -> str:
    return "CASE track " + " ".join(f"WHEN '{t}' THEN {how(getattr(c, part))}" for t, c in CONFIG.items()) + " END"


TRIAGE_SQL = f"""WITH {ITEMS_SQL},
    hay AS (SELECT *, replace(lower(concat_ws(chr(10), coalesce(title, ''), coalesce(summary, ''), coalesce(source_id, ''), '', concat_ws(' ', source_id, lang), url)), 'ß', 'ss') AS hay FROM items),
    hits AS (SELECT *, {_per_track("keep")} AS k, {_per_track("skip")} AS s, {_per_track("mechanism")} AS m FROM hay),
    triaged AS (SELECT *, CASE WHEN s AND m AND NOT k THEN 'suggest-ask' WHEN s THEN 'suggest-skip' WHEN k THEN 'suggest-keep' WHEN m THEN 'suggest-ask' ELSE 'suggest-skip' END AS recommendation FROM hits)"""


@query(TRIAGE_SQL + " SELECT source_id, recommendation, count(*) AS n_items FROM triaged GROUP BY ALL")
def triage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.triage_counts(triage.triage(items(spark, sf_dir), CONFIG), "source_id")


@query(TRIAGE_SQL + " SELECT id, recommendation, " + ", ".join(f"({_per_track(p, _hits)})::INT AS n_{p}" for p in ("keep", "skip", "mechanism")) + " FROM triaged")
def triage_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triage.triage(items(spark, sf_dir), CONFIG)
    return t.select("id", "triage.recommendation", F.size("triage.matched_keywords").alias("n_keep"), F.size("triage.skip_keywords").alias("n_skip"), F.size("triage.mechanism_keywords").alias("n_mechanism"))


@query(
    f"""WITH {ITEMS_SQL}, facts AS (
        SELECT 'tag' AS kind, outcome, unnest([source_id, lang]) AS value FROM items UNION ALL SELECT 'source', outcome, source_id FROM items UNION ALL SELECT 'reason', outcome, reason FROM items WHERE outcome = 'rejected')
    SELECT kind, outcome, value, count(*) AS n FROM facts WHERE outcome IS NOT NULL AND value IS NOT NULL GROUP BY ALL"""
)
def history_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.history_profile(items(spark, sf_dir))


@query(
    f"""WITH {ITEMS_SQL}, counts AS (SELECT source_id, reason, count(*) AS n FROM items WHERE outcome = 'rejected' GROUP BY ALL)
    SELECT source_id, reason, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, reason) AS rank FROM counts) WHERE rank <= 5"""
)
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.top_reasons(items(spark, sf_dir))


def _plain_hits(words: dict[str, tuple[str, ...]], column: str) -> str:
    return "CASE track " + " ".join(f"WHEN '{t}' THEN {_hits(w, column)}" for t, w in words.items()) + " ELSE 0 END"


# Fixed values, stated for the SQL on their own: words that tell short news, features, low value and commercial senders.
SQL_NEWS = ("宣布", "發布", "推出", "上線", "修法", "通過", "公告", "罰款", "fined", "launch", "release", "announces")
SQL_FEATURED = ("研究", "報告", "案例", "白皮書", "指引", "指南", "框架", "dataset", "governance", "standard", "framework")
SQL_LOW_VALUE = ("抽獎", "優惠", "促銷", "徵才", "人事異動", "交通管制", "交通疏導", "停水", "停電", "天氣", "路況", "工程公告", "報名", "活動時間", "名額")
SQL_COMMERCIAL = (
    "mckinsey", "麥肯錫", "deloitte", "勤業眾信", "pwc", "資誠", "kpmg", "安侯",
    "ernst", "安永", "accenture", "埃森哲", "gartner", "forrester", "bcg", "bain",
    "google", "microsoft", "amazon", "aws", "ibm", "oracle", "salesforce",
    "nvidia", "meta", "openai", "anthropic",
)
_SQUEEZED = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
_EARLY = f"replace(lower(substr({_SQUEEZED.format('summary')}, 1, 200) || ' ' || {_SQUEEZED.format('title')}), 'ß', 'ss')"
_CONCEPTS = "CASE track " + " ".join(f"WHEN '{t}' THEN {_any((*c.keep, *c.mechanism, *TASTE.themes.get(t, ())), 'early')}" for t, c in CONFIG.items()) + " END"
EDITORIAL_SQL = (
    TRIAGE_SQL
    + f""",
    prof AS (SELECT unnest([source_id, lang]) AS value, outcome FROM items WHERE outcome IS NOT NULL),
    tagn AS (SELECT value, bool_or(outcome = 'collected') AS c, bool_or(outcome = 'rejected') AS r FROM prof WHERE value IS NOT NULL GROUP BY value),
    srcn AS (SELECT source_id AS value, bool_or(outcome = 'collected') AS c, bool_or(outcome = 'rejected') AS r FROM items WHERE outcome IS NOT NULL GROUP BY source_id),
    drafts AS (SELECT id AS draft, source_id, lang FROM items WHERE outcome = 'collected' ORDER BY captured DESC, id LIMIT 50),
    related AS (SELECT i.id, count(*) AS n FROM items i JOIN drafts d ON i.source_id = d.source_id AND i.lang = d.lang AND i.id <> d.draft GROUP BY i.id),
    scored AS (
        SELECT t.*, {_per_track("keep", _hits)} AS nk, {_per_track("skip", _hits)} AS ns, {_hits(SQL_LOW_VALUE)} AS low,
            coalesce(s.c, FALSE)::INT + coalesce(a.c, FALSE)::INT + coalesce(b.c, FALSE)::INT AS prior0, coalesce(s.r, FALSE)::INT + coalesce(a.r, FALSE)::INT + coalesce(b.r, FALSE)::INT AS gone0,
            concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(t.source_id, ''), '', concat_ws(' ', t.source_id, lang)) AS plain,
            trim(regexp_replace(regexp_replace(coalesce(summary, ''), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS clean, coalesce(n, 0) AS nd,
            replace(lower(concat_ws(' ', coalesce(t.source_id, ''), coalesce(title, ''))), 'ß', 'ss') AS sender, {_EARLY} AS early
        FROM triaged t LEFT JOIN srcn s ON s.value = t.source_id LEFT JOIN tagn a ON a.value = t.source_id LEFT JOIN tagn b ON b.value = t.lang LEFT JOIN related USING (id)),
    points AS (
        SELECT *, nk * 2 - ns * 3 - (recommendation = 'suggest-skip' AND nk = 0)::INT AS keyword_score, least(5, prior0) AS prior_score, least(6, gone0 + (ns > 0)::INT + (low > 0)::INT + ns) AS deletion_score,
            {_plain_hits(TASTE.themes, "plain")} - {_plain_hits(TASTE.avoid, "plain")} + regexp_matches(plain, '{"|".join(TASTE.locality)}')::INT AS taste_score,
            CASE WHEN outcome = 'collected' THEN 'featured-article' WHEN {_any(SQL_FEATURED)} OR length(clean) >= 700 THEN 'featured-article' WHEN {_any(SQL_NEWS)} OR length(clean) <= 240 THEN 'small-news' ELSE 'needs-review' END AS content_kind
        FROM scored),
    decided AS (
        SELECT *, CASE WHEN deletion_score >= 3 AND keyword_score <= 2 THEN 'suggest-skip' WHEN keyword_score >= 2 AND deletion_score = 0 AND prior_score >= 1 THEN 'suggest-collect'
            WHEN keyword_score >= 1 AND deletion_score <= 2 THEN 'suggest-review' WHEN prior_score >= 3 AND deletion_score <= 1 THEN 'suggest-review' ELSE 'suggest-skip' END AS base FROM points),
    upgraded AS (
        SELECT *, CASE WHEN base <> 'suggest-skip' THEN '' WHEN taste_score >= 2 AND deletion_score < 3 THEN 'taste' WHEN deletion_score < 4 AND {_any(TASTE.beats)} THEN 'beat' WHEN deletion_score < 4 AND m THEN 'mechanism'
            WHEN k THEN 'keep' WHEN ns = 0 AND {_any(tuple(x for v in TASTE.tracked.values() for x in v))} THEN 'tracked'
            WHEN ns = 0 AND {_any(SQL_COMMERCIAL, "sender")} AND {_CONCEPTS} THEN 'commercial' WHEN ns = 0 AND nd > 0 THEN 'drafts' ELSE '' END AS upgrade FROM decided),
    final AS (
        SELECT *, CASE upgrade WHEN '' THEN base WHEN 'taste' THEN 'suggest-review' WHEN 'drafts' THEN 'suggest-review' ELSE 'suggest-ask' END AS decision,
            CASE WHEN abs(keyword_score) >= 3 THEN 2 WHEN abs(keyword_score) >= 1 THEN 1 ELSE 0 END + (prior_score >= 2)::INT + (deletion_score >= 2)::INT AS p FROM upgraded)
    SELECT id, decision AS recommendation, CASE WHEN p >= 4 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS confidence, content_kind, keyword_score::INT AS keyword_score, prior_score::INT AS prior_score,
        deletion_score::INT AS deletion_score, taste_score::INT AS taste_score, upgrade FROM final"""
)


@query(EDITORIAL_SQL)
def editorial_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = triage.triage(items(spark, sf_dir), CONFIG)
    out = triage.editorial_triage(own, triage.history_profile(own), CONFIG, TASTE, drafts=own.filter(triage.outcome() == "collected"), today=TODAY)
    return out.select("id", *[f"editorial_triage.{c}" for c in ("recommendation", "confidence", "content_kind", "keyword_score", "prior_score", "deletion_score", "taste_score", "upgrade")])


@query(
    EDITORIAL_SQL.rpartition("SELECT id, decision")[0]
    + f"""SELECT id, CASE decision WHEN 'suggest-collect' THEN 'collect' WHEN 'suggest-review' THEN 'have a look' WHEN 'suggest-skip' THEN 'skip' ELSE 'ask first: a beat or a mechanism' END AS recommendation_label,
        CASE content_kind WHEN 'featured-article' THEN 'a featured article' WHEN 'small-news' THEN 'plain news' ELSE 'for a person to judge' END AS content_kind_label,
        CASE WHEN nk > 0 THEN array_to_string(({_per_track("keep", lambda terms: f"list_filter({list(terms)}, lambda x : contains(hay, x))")})[1:4], ', ') ELSE concat_ws(', ', source_id, lang) END AS topic,
        CASE WHEN decision = 'suggest-skip' AND deletion_score > 0 THEN 'like what was turned down before' WHEN decision = 'suggest-skip' THEN 'too few terms and too unlike what was collected'
            WHEN content_kind = 'small-news' THEN 'fits the track or the collection; may be small news' ELSE 'fits the track or the collection; may be featured' END AS summary_reason,
        CASE WHEN decision = 'suggest-skip' THEN 'turn it down and note why, unless someone adds a view' WHEN content_kind = 'small-news' THEN 'check the facts; if it is only short news, send it in' ELSE 'look at it; if it is worth it, find an angle and edit' END AS next_step
    FROM final"""
)
def explained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editorial decisions in words: what an item is about, why, and what to do next."""
    own = triage.triage(items(spark, sf_dir), CONFIG)
    out = triage.editorial_triage(own, triage.history_profile(own), CONFIG, TASTE, drafts=own.filter(triage.outcome() == "collected"), today=TODAY)
    return triage.explained(out).select("id", *[f"explanation.{c}" for c in ("recommendation_label", "content_kind_label", "topic", "summary_reason", "next_step")])


@query(TRIAGE_SQL + " SELECT source_id, recommendation, outcome, count(*) AS n_items FROM triaged WHERE (recommendation = 'suggest-keep' AND outcome = 'rejected') OR (recommendation = 'suggest-skip' AND outcome = 'collected') GROUP BY ALL")
def decision_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.decision_divergence(triage.triage(items(spark, sf_dir), CONFIG), "source_id")


_SCORE = {t: f"({_hits(c.keep)} * 2 + {_hits(c.mechanism)} - {_hits(c.skip)} * 3)" for t, c in CONFIG.items()}


@query(TRIAGE_SQL + f" SELECT id, CASE WHEN {_SCORE['local']} >= {_SCORE['open']} THEN 'local' ELSE 'open' END AS track, greatest({_SCORE['local']}, {_SCORE['open']})::INT AS score FROM hay")
def track_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.score_tracks(items(spark, sf_dir), CONFIG).select("id", "track", F.col("scores")[0]["score"].alias("score"))


COUNTS_SQL = f"""WITH {SOURCES_SQL}, counts AS (SELECT source_id, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}_total, count(*) FILTER (outcome = '{o}' AND happened >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS {o}_recent" for o in ("accepted", "rejected", "pending"))} FROM outcomes GROUP BY source_id)"""
HEALTH_SQL = (
    COUNTS_SQL
    + """, assessed AS (SELECT s.id, c.* EXCLUDE (source_id), CASE WHEN status = 'archived' THEN 1 WHEN fetch_status = 'failed' THEN 2 WHEN rejected_recent >= 5 AND rejected_recent >= greatest(accepted_recent * 2, 3) THEN 3
        WHEN blk >= 10 AND blk >= greatest(new_items * 3, 10) THEN 4 WHEN dup >= 10 AND new_items <= 2 THEN 5 WHEN accepted_recent >= 5 AND accepted_recent >= rejected_recent THEN 6
        WHEN accepted_recent = 0 AND rejected_recent = 0 AND pending_recent = 0 THEN 7 ELSE 8 END AS rule FROM sources s JOIN counts c ON s.id = c.source_id),
    levels AS (SELECT *, ['archived', 'danger', 'danger', 'watch', 'watch', 'healthy', 'new', 'watch'][rule] AS level FROM assessed)"""
)


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.assess(sources(spark, sf_dir), health.outcome_counts(outcomes(spark, sf_dir), NOW, 7))


@query(HEALTH_SQL + " SELECT id, level, accepted_total, rejected_total, pending_total, accepted_recent, rejected_recent, pending_recent FROM levels")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("id", "level", *[f"{o}_{w}" for w in ("total", "recent") for o in ("accepted", "rejected", "pending")])


@query(HEALTH_SQL + " SELECT level, count(*) AS n_sources FROM levels GROUP BY level")
def health_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.level_distribution(_assessed(spark, sf_dir))


@query(
    f"""WITH {SOURCES_SQL} SELECT id, frequency, CASE WHEN status <> 'active' THEN 'not active' WHEN frequency = 'paused' THEN 'paused' WHEN frequency = 'on-update' THEN 'only on update'
        WHEN epoch(TIMESTAMP '{NOW}' - last) / 3600 < CASE frequency WHEN 'hourly' THEN 1 WHEN 'six-hourly' THEN 6 WHEN 'daily' THEN 24 WHEN 'weekly' THEN 168 ELSE 720 END THEN frequency || ' is not due yet' END AS skip_reason FROM sources"""
)
def fetchable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fetchable_sources(sources(spark, sf_dir), NOW, ["rss"]).select("id", ingest.frequency().alias("frequency"), "skip_reason")


URL_SQL = """
    parts AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS p FROM raw),
    norm AS (SELECT * EXCLUDE (p), rtrim(lower(p.scheme) || '://' || lower(p.host) || p.path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END, '/') AS normalized
        FROM (SELECT *, list_filter(string_split(p.query, '&'), lambda x : x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_.*|fbclid|gclid|igshid|mc_cid|mc_eid|ref)$')) AS q FROM parts))"""


@query(f"WITH raw AS (SELECT page_id, url FROM pages), {URL_SQL} SELECT page_id, normalized, rtrim(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[?#].*$', ''), '/') AS loose FROM norm")
def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normalize_url("url").alias("normalized"), loose_url_key("url").alias("loose"))


ENTRIES_SQL = f"""WITH raw AS (
        SELECT 0 AS turn, page_id AS pos, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS source_id, url FROM pages UNION ALL
        SELECT 1, page_id, 'reposts', CASE WHEN contains(url, '#') THEN url WHEN contains(url, '?') THEN url || '&utm_source=x' WHEN page_id % 2 = 0 THEN url || '/' ELSE url || '#again' END FROM pages),
    {URL_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY turn, pos) AS n FROM norm),
    labelled AS (SELECT turn, pos, source_id, CASE WHEN n = 1 THEN 'new' ELSE 'duplicate' END AS entry_outcome FROM ranked)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return ingest.new_entries(e.withColumn("keys", ingest.entry_keys(e, "id", ["url"])), spark.createDataFrame([], "key string"), ["turn", "pos"])


@query(ENTRIES_SQL + " SELECT turn, pos, entry_outcome FROM labelled")
def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("turn", "pos", "entry_outcome")


# one entry after another, with the keys accepted so far in a list: the rule as it is told
HISTORY_SQL = f"""WITH RECURSIVE raw AS (
        SELECT 0 AS turn, page_id AS pos, 'g' || (page_id % 97) AS guid, url FROM pages UNION ALL
        SELECT 1, page_id, 'g' || (page_id * 7 % 113), CASE WHEN contains(url, '#') THEN url WHEN contains(url, '?') THEN url || '&utm_source=x' WHEN page_id % 2 = 0 THEN url || '/' ELSE url || '#again' END FROM pages),
    {URL_SQL}, numbered AS (SELECT turn, pos, pos % 13 = 5 AS blocked, ['guid:' || guid, 'url:' || normalized] AS keys, row_number() OVER (ORDER BY turn, pos) AS k FROM norm),
    history AS (SELECT list('url:' || normalized) AS keys FROM norm WHERE turn = 0 AND pos % 11 = 3),
    step AS (
        SELECT 0::BIGINT AS k, 0 AS turn, 0::BIGINT AS pos, '' AS entry_outcome, keys AS seen FROM history UNION ALL
        SELECT n.k, n.turn, n.pos, CASE WHEN list_has_any(s.seen, n.keys) THEN 'duplicate' WHEN n.blocked THEN 'blocked' ELSE 'new' END,
            CASE WHEN list_has_any(s.seen, n.keys) OR n.blocked THEN s.seen ELSE list_concat(s.seen, n.keys) END FROM step s JOIN numbered n ON n.k = s.k + 1)
    SELECT turn, pos, entry_outcome FROM step WHERE k > 0"""


@query(HISTORY_SQL)
def entries_against_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two keys each, guid and address, some blocked, against the addresses seen before."""
    e, seen = _two_keys(spark, sf_dir)
    return ingest.new_entries(e, seen, ["turn", "pos"], "gate").select("turn", "pos", "entry_outcome")


def _two_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turn, pos = F.col("turn"), F.col("pos")
    e = entries(spark, sf_dir).withColumns({"guid": F.concat(F.lit("g"), F.when(turn == 0, pos % 97).otherwise(pos * 7 % 113)), "gate": pos % 13 == 5, "none": F.lit(None).cast("string")})
    seen = table(spark, sf_dir, "pages").filter("page_id % 11 = 3").select(F.concat(F.lit("url:"), normalize_url("url")).alias("key"))
    return e.withColumn("keys", ingest.entry_keys(e, "none", ["url"], "guid")), seen


# a source after another; each step knows the keys accepted so far, the source it is in, and how many of it were
CAPPED_SQL = f"""{HISTORY_SQL.split("numbered AS")[0]}
    numbered AS (SELECT turn, pos, source_id, pos % 13 = 5 AS blocked, ['guid:' || guid, 'url:' || normalized] AS keys, row_number() OVER (ORDER BY source_id, turn, pos) AS k
        FROM (SELECT *, CASE turn WHEN 0 THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) ELSE 'reposts' END AS source_id FROM norm)),
    history AS (SELECT list('url:' || normalized) AS keys FROM norm WHERE turn = 0 AND pos % 11 = 3),
    step AS (
        SELECT 0::BIGINT AS k, 0 AS turn, 0::BIGINT AS pos, '' AS source_id, '' AS entry_outcome, keys AS seen, 0 AS n FROM history UNION ALL
        SELECT k, turn, pos, source_id, outcome, CASE WHEN outcome = 'new' THEN list_concat(seen, keys) ELSE seen END, before + (outcome = 'new')::INT FROM (
            SELECT *, CASE WHEN before = 4 THEN 'unseen' WHEN list_has_any(seen, keys) THEN 'duplicate' WHEN blocked THEN 'blocked' ELSE 'new' END AS outcome FROM (
                SELECT n.*, s.seen, CASE WHEN n.source_id = s.source_id THEN s.n ELSE 0 END AS before FROM step s JOIN numbered n ON n.k = s.k + 1)))
    SELECT turn, pos, entry_outcome FROM step WHERE k > 0"""


@query(CAPPED_SQL)
def entries_under_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As entries_against_history, a source after another; each is left after its fourth new entry."""
    e, seen = _two_keys(spark, sf_dir)
    return ingest.new_entries_capped(e, seen, ["source_id", "turn", "pos"], "gate", 4).select("turn", "pos", "entry_outcome")


@query(ENTRIES_SQL + " SELECT source_id, count(*) AS entries_seen, count(*) FILTER (entry_outcome = 'new') AS new_items, 0::BIGINT AS skipped_old, count(*) FILTER (entry_outcome = 'duplicate') AS skipped_duplicate_recent, 0::BIGINT AS skipped_source_keywords FROM labelled GROUP BY source_id")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_stats(_labelled(spark, sf_dir))


@query(ENTRIES_SQL + " SELECT entry_outcome, source_id, count(*) AS n FROM labelled GROUP BY ROLLUP (entry_outcome, source_id) HAVING entry_outcome IS NOT NULL")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_report(_labelled(spark, sf_dir))


@query(ENTRIES_SQL + " SELECT source_id, turn, pos FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY turn, pos) AS k FROM labelled WHERE entry_outcome = 'new') WHERE k <= 10")
def capped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.cap_per_source(_labelled(spark, sf_dir), ["turn", "pos"]).select("source_id", "turn", "pos")


@query("WITH " + OUTCOMES_SQL + ' SELECT source_id, outcome, max(happened) AS "at" FROM outcomes GROUP BY source_id, outcome')
def last_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir).withColumn("key", F.concat_ws("/", "source_id", "outcome"))
    return ingest.last_by_id(o, "at", "key").select("source_id", "outcome", "at")


@query(
    f"""WITH {ITEMS_SQL}, queue AS (SELECT 'item' AS queue, id FROM items WHERE status = 'inbox' UNION ALL
        SELECT 'candidate', 'item-' || substr(sha1(page_id::VARCHAR), 1, 16) FROM pages WHERE 'item-' || substr(sha1(page_id::VARCHAR), 1, 16) NOT IN (SELECT id FROM items)) SELECT queue, id FROM queue"""
)
def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "pages").select(stable_id("item", "page_id").alias("id"), "url")
    return ingest.pending_queue(items(spark, sf_dir).select("id", "url", "status"), candidates).select("queue", "id")


@query(
    """WITH lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) SELECT d.doc_id AS id, CASE quality WHEN 1 THEN 'items' WHEN 0 THEN 'rejected' ELSE 'items' END AS goes_to,
        CASE quality WHEN 1 THEN 'triaged' WHEN 0 THEN 'parked' ELSE 'inbox' END AS status FROM documents d LEFT JOIN lab USING (doc_id)"""
)
def applied_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("inbox").alias("status"), F.expr("cast(null as struct<action:string,reason:string,decided_at:string>)").alias("local_decision"))
    decided = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.when(F.max("quality") == 1, "accept").otherwise("reject").alias("action")).withColumns({"reason": F.lit(""), "at": F.lit(NOW)})
    return ingest.apply_decisions(d, d.limit(0), decided).select("id", "goes_to", "status")


_SHINGLES = """list_distinct(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)"""


def _shingled(name: str, key: str, of: str, least: int) -> str:
    clean = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
    return f"""{name}_w AS (SELECT {key} AS id, regexp_extract_all(replace(lower({clean}), 'ß', 'ss'), '[a-z0-9㐀-鿿]+') AS w FROM {of} WHERE length({clean}) >= {least}),
    {name}_s AS (SELECT id, {_SHINGLES} AS s FROM {name}_w), {name} AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM {name}_s WHERE len(s) >= 18)"""


@query(
    f"""WITH {_shingled("p", "item_id", "benchmark", 120)}, {_shingled("o", "doc_id", "documents", 80)},
    pairs AS (SELECT p.id AS probe, o.id AS other, p.n AS np, o.n AS no, count(*) AS n_shared FROM p JOIN o USING (shingle) WHERE p.id <> o.id GROUP BY ALL),
    c AS (SELECT *, n_shared / no AS oc, n_shared / np AS pc, n_shared / (np + no - n_shared) AS j FROM pairs),
    r AS (SELECT *, CASE WHEN oc >= 0.72 AND np >= no * 1.08 THEN 'full-source' WHEN pc >= 0.72 OR oc >= 0.58 THEN 'subset' WHEN j >= 0.12 OR greatest(oc, pc) >= 0.3 THEN 'related' END AS relation FROM c)
    SELECT probe, other, n_shared, relation, round(CASE relation WHEN 'full-source' THEN greatest(oc, j) WHEN 'subset' THEN greatest(oc, pc) ELSE greatest(j, least(oc, pc)) END, 6) AS score,
        CASE WHEN oc > pc + 0.08 THEN 'other-in-probe' WHEN pc > oc + 0.08 THEN 'probe-in-other' ELSE 'similar-size' END AS direction FROM r WHERE relation IS NOT NULL"""
)
def text_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    others = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return relations.text_relations(probes, others, most=None).select("probe", "other", "n_shared", "relation", F.round("score", 6).alias("score"), "direction")


ORACLE_SQL["ranked_relations"] = f"""SELECT probe, other, relation, score, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY probe ORDER BY CASE relation WHEN 'full-source' THEN 0 WHEN 'subset' THEN 1 ELSE 2 END, score DESC, other) AS rank FROM ({ORACLE_SQL["text_relations"]})) WHERE rank <= 10"""


def ranked_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best relations of each benchmark text, as the operator ranks them."""
    probes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    others = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return relations.text_relations(probes, others).select("probe", "other", "relation", F.round("score", 6).alias("score"), "rank")


QUERIES["ranked_relations"] = ranked_relations


@query(
    f"""WITH {_shingled("o", "doc_id", "documents", 80)}, keyed AS (SELECT id, list_sort(s) AS k, len(s) AS n_shingles FROM o_s WHERE len(s) >= 18)
    SELECT id, min(id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n_members, n_shingles FROM keyed"""
)
def shingle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal sets of shingles, folded: of each document its class, the class's size and how many shingles it has."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    members, _ = relations.shingle_classes(texts, "id", "text", 80)
    classes = members.groupBy("set_id").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_members"))
    return members.join(classes, "set_id").select("id", "class_id", "n_members", F.col("n").cast("long").alias("n_shingles"))


@query()
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda name, key: table(spark, sf_dir, name).select(F.concat(F.lit(name + "-"), F.col(key)).alias("id"), F.substring_index("text", "\n", 1).alias("title"))
    return relations.title_matches(first("benchmark", "item_id"), first("documents", "doc_id"))


_SENTENCES = r"""
    clean AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t, split_part(text, chr(10), 1) AS title FROM documents),
    cut AS (SELECT doc_id, title, string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+') AS parts FROM clean),
    trimmed AS (SELECT doc_id, title, list_filter(list_transform(parts, lambda s : CASE WHEN length(trim(s)) > 700 THEN rtrim(substr(trim(s), 1, 700)) || '...' ELSE trim(s) END), lambda s : length(s) >= 30) AS s0 FROM cut),
    good AS (SELECT doc_id, title, list_filter(s0, lambda s : NOT regexp_matches(lower(s), 'cookie|privacy policy|terms of use|subscribe|newsletter|advertisement|recommended|related posts|share this|all rights reserved') AND NOT regexp_matches(s, '(?i)https?://|www\.')) AS s FROM trimmed),
    flat AS (SELECT doc_id, title, (i - 1)::INT AS index, s[i] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM good)),
    terms AS (SELECT *, replace(lower(sentence), 'ß', 'ss') AS low, list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9-]{3,}'), lambda x : lower(x))[1:12] AS terms FROM flat),
    scored AS (SELECT doc_id, index, sentence, greatest(0.0, 16 - index * 0.25) + least(length(sentence), 260) / 55 + len(list_filter(terms, lambda x : contains(low, x))) * 3
        + list_sum(list_transform(['open source', 'open data', 'governance', 'privacy', 'security', 'dataset', 'research', 'report'], lambda c : CASE WHEN contains(low, c) THEN 3.0 ELSE 0 END))
        + CASE WHEN regexp_matches(sentence, '\d') THEN 1.5 ELSE 0 END - CASE WHEN length(sentence) < 45 THEN 3 ELSE 0 END - CASE WHEN length(sentence) > 420 THEN 2 ELSE 0 END AS score FROM terms)"""


@query("WITH " + _SENTENCES + " SELECT doc_id AS id, index, length(sentence)::INT AS n_chars, round(score, 6) AS score FROM scored")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    return summaries.score_sentences(d, "doc_id", "text", "title").select("id", "index", F.length("sentence").alias("n_chars"), F.round("score", 6).alias("score"))


# the five best in their order, taken one by one while they fit
SUMMARIES_SQL = f"""WITH RECURSIVE {_SENTENCES},
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS k FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, index DESC) <= 5)),
    clipped AS (SELECT doc_id, k, CASE WHEN length(sentence) > 240 THEN rtrim(substr(sentence, 1, 240)) || '...' ELSE sentence END AS s FROM best),
    step AS (SELECT doc_id, 0::BIGINT AS k, []::VARCHAR[] AS sentences, 0 AS n FROM (SELECT DISTINCT doc_id FROM best) UNION ALL
        SELECT doc_id, k, CASE WHEN fits THEN list_append(sentences, s) ELSE sentences END, CASE WHEN fits THEN n + length(s) ELSE n END FROM (
            SELECT c.doc_id, c.k, t.sentences, t.n, c.s, len(t.sentences) < 3 AND t.n < 520 AND (t.n + length(c.s) <= 520 OR t.n = 0) AND len(list_filter(t.sentences, lambda x : contains(x, c.s) OR contains(c.s, x))) = 0 AS fits
            FROM step t JOIN clipped c ON c.doc_id = t.doc_id AND c.k = t.k + 1))
    SELECT doc_id AS id, sentences, array_to_string(sentences, ' ') AS summary FROM step QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1"""


@query(SUMMARIES_SQL)
def extractive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    return summaries.summarize(d, "doc_id", "text", "title", first=None)


@query(
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, lower(coalesce(text, '')) AS l, regexp_replace(regexp_replace(lower(coalesce(text, '')), 'cc[-_ ]?by', 'cc by', 'g'), '[-_/]+', ' ', 'g') AS p FROM documents),
    u AS (SELECT *, regexp_extract(l, 'creativecommons\.org/licenses/(by-nc-nd|by-nc-sa|by-nc|by-nd|by-sa|by)/(4\.0|3\.0)(?:/(tw))?', ['c', 'v', 'tw']) AS m,
        CASE WHEN regexp_matches(p, '\b4\.0\b') THEN '4.0' WHEN regexp_matches(p, '\b3\.0\b') AND regexp_matches(p, '\b(tw|taiwan)\b|臺灣|台灣') THEN '3.0 TW' END AS v,
        CASE WHEN regexp_matches(p, '\battribution\s+noncommercial\s+noderivatives\b') THEN 'BY-NC-ND' WHEN regexp_matches(p, '\battribution\s+noncommercial\s+sharealike\b') THEN 'BY-NC-SA'
            WHEN regexp_matches(p, '\battribution\s+noncommercial\b') THEN 'BY-NC' WHEN regexp_matches(p, '\battribution\s+noderivatives\b') THEN 'BY-ND' WHEN regexp_matches(p, '\battribution\s+sharealike\b') THEN 'BY-SA'
            WHEN regexp_matches(p, '\b(?:cc|creative commons)\s+by\s+nc\s+nd\b') THEN 'BY-NC-ND' WHEN regexp_matches(p, '\b(?:cc|creative commons)\s+by\s+nc\s+sa\b') THEN 'BY-NC-SA'
            WHEN regexp_matches(p, '\b(?:cc|creative commons)\s+by\s+nc\b') THEN 'BY-NC' WHEN regexp_matches(p, '\b(?:cc|creative commons)\s+by\s+nd\b') THEN 'BY-ND' WHEN regexp_matches(p, '\b(?:cc|creative commons)\s+by\s+sa\b') THEN 'BY-SA'
            WHEN regexp_matches(p, '\b(?:cc|creative commons)\s+by\b') THEN 'BY' WHEN regexp_matches(p, '\battribution\b') THEN 'BY' END AS c FROM t),
    n AS (SELECT doc_id, x, l, coalesce(CASE WHEN contains(l, 'creativecommons.org/publicdomain/zero/1.0') THEN 'CC0 1.0' WHEN contains(l, 'creativecommons.org/publicdomain/mark/1.0') THEN 'Public Domain Mark 1.0' WHEN m.v = '4.0' THEN 'CC ' || upper(m.c) || ' 4.0' WHEN m.v = '3.0' AND m.tw = 'tw' THEN 'CC ' || upper(m.c) || ' 3.0 TW' END,
        CASE WHEN regexp_matches(l, '\bcc0\b|public domain dedication|zero 1\.0') THEN 'CC0 1.0' WHEN contains(l, 'public domain mark') THEN 'Public Domain Mark 1.0' WHEN v IS NOT NULL AND c IS NOT NULL THEN 'CC ' || c || ' ' || v END) AS name FROM u)
    SELECT doc_id, CASE WHEN name IS NOT NULL AND regexp_matches(l, 'released under|licensed under|is licensed|creative commons|creativecommons\.org') THEN name WHEN name IS NOT NULL THEN 'unspecified' WHEN contains(l, 'all rights reserved') THEN 'non-CC: copyright' ELSE 'unspecified' END AS license_name FROM n"""
)
def inferred_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return licences.infer_license(d, [("text", F.col("text"), True)]).select("doc_id", F.col("license.name").alias("license_name"))


ORACLE_SQL["license_distribution"] = f"SELECT license_name, count(*) AS n_records FROM ({ORACLE_SQL['inferred_licenses']}) GROUP BY license_name"


def license_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return licences.license_distribution(licences.infer_license(d, [("text", F.col("text"), True)]))


QUERIES["license_distribution"] = license_distribution


@query(
    r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations),
    s AS (SELECT conv_id, turn, text, regexp_matches(coalesce(source, ''), '(?i)tion') AS ok,
        list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda x : trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x : x <> '') AS parts FROM c WHERE role = 'assistant'),
    n AS (SELECT *, CASE WHEN ok THEN 0 ELSE len(list_filter(parts, lambda x : regexp_matches(x, '(?i)tion') AND NOT regexp_matches(x, '(?i)\bthe\b'))) END AS n_dropped FROM s)
    SELECT conv_id, turn, n_dropped::INT AS n_dropped, n_dropped > 0 AS fact_claim, length(CASE WHEN n_dropped = 0 THEN text ELSE array_to_string(list_filter(parts, lambda x : NOT (regexp_matches(x, '(?i)tion') AND NOT regexp_matches(x, '(?i)\bthe\b'))), ' ') END)::INT AS n_chars FROM n"""
)
def guarded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("source", F.lag(F.coalesce("text", F.lit(""))).over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'assistant'")
    return claims.guard_claims(c, "source", "text", "(?i)tion", r"(?i)\bthe\b").select("conv_id", "turn", "n_dropped", "fact_claim", F.length("guarded").alias("n_chars"))


@query(
    """WITH bad AS (
        SELECT 'documents' AS "table", doc_id::VARCHAR AS row_key, 'required' AS rule, f AS detail FROM (SELECT doc_id, unnest([CASE WHEN coalesce(trim(text), '') = '' THEN 'text' END, CASE WHEN coalesce(lang, '') = '' THEN 'lang' END]) AS f FROM documents) WHERE f IS NOT NULL
        UNION ALL SELECT 'labels', doc_id::VARCHAR, 'unique', count(*)::VARCHAR FROM labels GROUP BY doc_id HAVING count(*) > 1
        UNION ALL SELECT 'documents', doc_id::VARCHAR, 'vocabulary:lang', lang FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
        UNION ALL SELECT 'labels', doc_id::VARCHAR, 'foreign_key:doc_id', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)
        UNION ALL SELECT 'labels', doc_id::VARCHAR, 'disjoint', '' FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT item_id FROM benchmark)))
    SELECT * FROM bad"""
)
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels, pages_, benchmark = (table(spark, sf_dir, n) for n in ("documents", "labels", "pages", "benchmark"))
    return checks.all_of(
        checks.required(d, "documents", ["text", "lang"], "doc_id"), checks.unique(labels, "labels", "doc_id"), checks.vocabulary(d, "documents", "lang", ["en", "de", "fr"], "doc_id"),
        checks.foreign_key(labels, "labels", "doc_id", pages_, "page_id", "doc_id"), checks.disjoint(labels, benchmark.withColumnRenamed("item_id", "doc_id"), "labels", "doc_id"),
    )


LISTED_SQL = f"""WITH {ITEMS_SQL}, kinds AS (SELECT *, published::TIMESTAMP AS time, CASE WHEN length(summary) >= 700 THEN 'featured-article' ELSE 'small-news' END AS kind FROM items)"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("kind", F.when(F.length("summary") >= 700, "featured-article").otherwise("small-news")).withColumn("time", first_date("published_at", "captured_at"))


@query(
    LISTED_SQL
    + """, placed AS (SELECT id, row_number() OVER w - 1 AS pos, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM kinds WHERE track = 'open' AND outcome = 'collected'
        WINDOW w AS (ORDER BY CASE kind WHEN 'featured-article' THEN 0 ELSE 1 END, time DESC, coalesce(title, '') DESC, id DESC)) SELECT id, pos, previous_id, next_id FROM placed"""
)
def public_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.public_listing(_kinds(spark, sf_dir).drop("time"), "open").select("id", "pos", "previous_id", "next_id")


@query(LISTED_SQL + " SELECT date_trunc('month', time)::DATE AS period, count(*) AS n_items, max(time) AS newest FROM kinds GROUP BY 1")
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.period_counts(_kinds(spark, sf_dir))


@query(
    LISTED_SQL
    + f""" SELECT p AS preset, count(*) AS n_items FROM kinds, (VALUES ('3d', DATE '{TODAY}' - 3), ('7d', DATE '{TODAY}' - 7), ('30d', DATE '{TODAY}' - 30), ('quarter', DATE '2024-01-01'), ('year', DATE '2024-01-01'), ('all', DATE '1900-01-01')) v(p, since)
        WHERE time::DATE >= since GROUP BY p"""
)
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _kinds(spark, sf_dir)
    out = None
    for preset in ("3d", "7d", "30d", "quarter", "year", "all"):
        part = listings.time_range(k, preset, TODAY).groupBy().agg(F.count(F.lit(1)).alias("n_items")).select(F.lit(preset).alias("preset"), "n_items").filter("n_items > 0")
        out = part if out is None else out.unionByName(part)
    return out


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic page for each language and each source of the documents."""
    d = table(spark, sf_dir, "documents")
    topics = d.select(F.lit("tag").alias("type"), F.col("lang").alias("key")).distinct().unionByName(d.select(F.lit("source").alias("type"), F.col("source").alias("key")).distinct())
    return topics.withColumn("slug", F.concat_ws("-", "type", "key")).withColumn("published", F.lit(True))


@query(
    LISTED_SQL
    + """, facts AS (SELECT id, title, kind, time, unnest(list_distinct([{'type': 'tag', 'key': source_id}, {'type': 'tag', 'key': lang}, {'type': 'source', 'key': source_id}])) AS f FROM kinds),
    topics AS (SELECT DISTINCT 'tag' AS type, lang AS key, 'tag-' || lang AS slug FROM documents UNION ALL SELECT DISTINCT 'source', source, 'source-' || source FROM documents),
    r AS (SELECT slug, id, row_number() OVER (PARTITION BY slug ORDER BY CASE kind WHEN 'featured-article' THEN 0 ELSE 1 END, time DESC, coalesce(title, '') DESC, id DESC) AS rank FROM facts JOIN topics t ON f.type = t.type AND f.key = t.key)
    SELECT slug, id, rank::INT AS rank FROM r WHERE rank <= 180"""
)
def topic_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.topic_listing(_topics(spark, sf_dir), _kinds(spark, sf_dir)).select("slug", "id", "rank")


@query(
    LISTED_SQL
    + """, facts AS (SELECT id, kind, unnest(list_distinct([{'type': 'tag', 'key': source_id}, {'type': 'tag', 'key': lang}, {'type': 'source', 'key': source_id}])) AS f FROM kinds),
    topics AS (SELECT DISTINCT 'tag' AS type, lang AS key, 'tag-' || lang AS slug FROM documents UNION ALL SELECT DISTINCT 'source', source, 'source-' || source FROM documents)
    SELECT slug, count(id) AS n_items, count(*) FILTER (WHERE kind IN ('featured-article', 'needs-review')) AS n_primary, count(*) FILTER (WHERE kind = 'small-news') AS n_small_news,
        count(*) FILTER (WHERE kind NOT IN ('featured-article', 'needs-review', 'small-news')) AS n_other
    FROM topics t LEFT JOIN facts ON f.type = t.type AND f.key = t.key GROUP BY slug"""
)
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.topic_counts(_topics(spark, sf_dir), _kinds(spark, sf_dir))


@query(
    r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    m AS (SELECT page_id, lower(regexp_extract(h, '<html\b[^>]*lang="([^"]*)"', 1)) AS language, regexp_extract(h, '(?s)<title[^>]*>(.*?)</title>', 1) AS t FROM p),
    d AS (SELECT page_id, language, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\f\x0B]+', ' ', 'g')) AS title FROM m)
    SELECT page_id AS id, CASE WHEN length(title) > 300 THEN rtrim(title[1:300]) || '...' ELSE title END AS title, language FROM d"""
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_metadata(table(spark, sf_dir, "pages")).select("id", "title", F.col("language.value").alias("language"))


@query()
def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.article_text(table(spark, sf_dir, "pages"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents),
    j AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x : regexp_matches(x, '^[A-Za-z]{3,}$')) AS w FROM t)
    SELECT doc_id, CASE WHEN length(t) < 80 OR length(array_to_string(w, '')) = 0 THEN '' WHEN len(w) >= 35 THEN 'en' ELSE '' END AS language FROM j"""
)
def inferred_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", infer_language("text").alias("language"))


@query(
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https://[^\s<>{}\[\]"'']+'), lambda u : regexp_replace(u, '[.,;:!?)\]}]+$', '')))), ' ') AS urls,
        len(list_distinct(regexp_extract_all(coalesce(text, ''), '\b\d{4}\.\d{4,5}(?:v\d+)?\b')))::INT AS n_arxiv FROM documents"""
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = extract_identifiers("text")
    return table(spark, sf_dir, "documents").select("doc_id", i.alias("i")).select("doc_id", F.array_join(F.array_sort("i.urls"), " ").alias("urls"), F.size("i.arxiv_ids").alias("n_arxiv"))


@query(
    f"""WITH {OUTCOMES_SQL}, days AS (SELECT source_id, outcome, date_trunc('day', happened) AS d FROM outcomes), spread AS (SELECT source_id, outcome, d - to_days(k::INT) AS window_start FROM days, range(0, 30) r(k))
    SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, source_id, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'pending') AS pending FROM spread GROUP BY ALL"""
)
def rolling_source_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_outcomes(outcomes(spark, sf_dir))


@query("SELECT doc_id AS item_id, length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\f\\x0B]+', ' ', 'g'), '\\s+', '', 'g')))::INT AS n_letters FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) <> ''")
def chunk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into chunks and put together again: nothing but white space differs."""
    chunks = ingest.plan_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ingest.assemble_chunks(chunks).select("item_id", F.length(F.regexp_replace("body", r"\s+", "")).alias("n_letters"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(12288)"
# line by line: fences counted so far tell what is code, and the line before what stays together
PARAGRAPHS_SQL = rf"""WITH t AS (SELECT doc_id, text, n_chars, regexp_replace(text, '\r\n?', chr(10), 'g') AS x FROM documents),
    need AS (SELECT *, coalesce(NOT regexp_matches(x, '\n[ \t]*\n') AND length(x) - length(replace(x, chr(10), '')) >= 5 AND trim(x, {_BLANK}) <> '', false) AS need FROM t),
    lines AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '[ \t]+', ' ', 'g'), chr(10))) AS raw, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM need WHERE need),
    told AS (SELECT doc_id, i, trim(raw, {_BLANK}) AS line FROM lines),
    kinds AS (SELECT *, regexp_matches(line, '^(```|~~~)') AS fence, CASE WHEN regexp_matches(line, '^([-*+]|\d+[.)])\s') THEN 'list' WHEN line LIKE '>%' THEN 'quote'
        WHEN regexp_matches(line, '^\|.*\|$|^\|?\s*:?-{{3,}}:?\s*(?:\|\s*:?-{{3,}}:?\s*)+\|?$') THEN 'table' END AS kind FROM told),
    placed AS (SELECT *, (sum(fence::INT) OVER w - fence::INT) % 2 = 1 AS inside, lag(line) OVER w AS before, lag(kind) OVER w AS kind_before, coalesce(lag(fence) OVER w, false) AS after_fence FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    parted AS (SELECT *, CASE WHEN line = '' THEN '' WHEN coalesce(before, '') = '' THEN chr(10) || chr(10) WHEN inside THEN chr(10) WHEN NOT fence AND NOT after_fence AND kind = kind_before THEN chr(10) ELSE chr(10) || chr(10) END || line AS part FROM placed),
    joined AS (SELECT doc_id, trim(string_agg(part, '' ORDER BY i), {_BLANK}) AS new FROM parted GROUP BY doc_id)
    SELECT doc_id, coalesce(new <> text, false) AS changed, CASE WHEN new <> text THEN length(new) ELSE n_chars END AS n_chars, sha256(coalesce(new, text)) AS text_sha256 FROM need LEFT JOIN joined USING (doc_id)"""


@query(PARAGRAPHS_SQL)
def normalized_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return markdown.normalize_paragraphs(d, "text", "n_chars").select("doc_id", "changed", "n_chars", F.sha2("text", 256).alias("text_sha256"))


ALIASES = {"token": "credentials", "lizenz": "licensing", "license": "licensing"}


def _formal(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"CASE WHEN contains(hay, '{t}') THEN '{ALIASES.get(t, t)}' END" for t in terms) + "]"


@query(
    TRIAGE_SQL
    + ", suggested AS (SELECT id, CASE track "
    + " ".join(f"WHEN '{t}' THEN {_formal((*c.keep, *c.mechanism))}" for t, c in CONFIG.items())
    + " END AS tags FROM triaged), flat AS (SELECT id, unnest(list_distinct(tags)) AS tag FROM suggested) SELECT tag, count(*) AS n_items FROM flat WHERE tag IS NOT NULL GROUP BY tag"
)
def suggested_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = triage.suggest_tags(triage.triage(items(spark, sf_dir), CONFIG), ALIASES)
    return s.select("id", F.explode("suggested_tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_items"))


@query(
    LISTED_SQL
    + """, grouped AS (SELECT id, 0 AS g FROM kinds WHERE outcome = 'collected' AND kind = 'featured-article' UNION ALL SELECT id, 1 FROM kinds WHERE kind = 'small-news' UNION ALL SELECT id, 2 FROM kinds WHERE track = 'open' UNION ALL SELECT id, 3 FROM kinds WHERE outcome = 'collected')
    SELECT id, min(g)::INT AS group_no FROM grouped GROUP BY id"""
)
def homepage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, collected = _kinds(spark, sf_dir), triage.outcome() == "collected"
    groups = [k.filter(collected & (F.col("kind") == "featured-article")), k.filter(F.col("kind") == "small-news"), k.filter("track = 'open'"), k.filter(collected)]
    return listings.homepage_order(groups, listings.reader_order()).select("id", "group_no")


ORACLE_SQL["rolling_from_daily"] = ORACLE_SQL["rolling_source_outcomes"]


def rolling_from_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of rolling_source_outcomes from counts by day, as two batches left them; the second has what came late."""
    path, o = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}", outcomes(spark, sf_dir)
    late = F.pmod(F.xxhash64("source_id", "at"), F.lit(10)) == 0
    history.add_daily(o.filter(~late), path, 0)
    history.add_daily(o.filter(late), path, 1)
    return history.rolling_from_daily(spark.read.parquet(path))


QUERIES["rolling_from_daily"] = rolling_from_daily


@query(
    f"""WITH raw AS (SELECT page_id, url FROM pages), {URL_SQL}, old AS (SELECT 'url:' || normalized AS key, DATE '{TODAY}' - (page_id % 60)::INT AS day FROM norm WHERE page_id % 3 = 0),
    asked AS (SELECT DISTINCT 'url:' || normalized AS key FROM norm WHERE page_id % 2 = 0) SELECT key FROM asked WHERE key IN (SELECT key FROM old WHERE day >= DATE '{TODAY}' - 30)"""
)
def keys_in_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses of every second page are in the history of the last thirty days, which every third page went into by day; found by the filters of its days."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "pages").select("page_id", F.array(F.concat(F.lit("url:"), normalize_url("url"))).alias("keys"))
    old = p.filter("page_id % 3 = 0").withColumn("at", F.date_sub(F.lit(TODAY).cast("date"), (F.col("page_id") % 60).cast("int")).cast("timestamp"))
    history.add_to_history(old, path, 0)
    since = F.date_sub(F.lit(TODAY).cast("date"), 30).cast("timestamp")
    return history.known_keys(spark, path, history.history_schema(old), p.filter("page_id % 2 = 0").select(F.explode("keys").alias("key")), since)


@query(
    """WITH lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
    SELECT d.doc_id AS id, CASE WHEN lab.doc_id IS NULL THEN source ELSE 'labelled-' || quality END AS part, lang FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id"""
)
def upserted_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in partitions by source; labelled ones move to partitions of their quality, and only touched partitions are written. Done twice, which changes nothing."""
    path = f"{shared_dir(spark)}/upserted-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("part"), "lang")
    d.repartition("part").write.partitionBy("part").parquet(path)
    lab = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    changes = d.drop("part").join(lab, "id").select("id", F.concat(F.lit("labelled-"), "quality").alias("part"), "lang")
    for _ in range(2):
        history.upsert_partitions(spark, path, changes)
    return spark.read.schema(changes.schema).parquet(path)


@query(
    f"""WITH {ITEMS_SQL} SELECT id, CASE WHEN outcome = 'rejected' THEN 'archived' ELSE 'kept' END AS goes_to, CASE WHEN outcome = 'rejected' THEN 'parked' ELSE status END AS status,
        CASE WHEN outcome = 'rejected' THEN '{NOW}' END AS archived_at FROM items"""
)
def archived_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items decided as rejected, moved to the archive."""
    kept, archived = ingest.archive_split(items(spark, sf_dir), NOW)
    both = kept.withColumn("goes_to", F.lit("kept")).withColumn("archived_at", F.lit(None).cast("string")).unionByName(archived.withColumn("goes_to", F.lit("archived")), allowMissingColumns=True)
    return both.select("id", "goes_to", "status", "archived_at")


@query(
    """WITH lab AS (SELECT doc_id FROM labels GROUP BY doc_id), there AS (SELECT doc_id AS id, doc_id AS place, 'there' AS source FROM documents WHERE doc_id % 2 = 0), moved AS (SELECT doc_id AS id, doc_id * 10 AS place, 'moved' AS source FROM lab)
    SELECT coalesce(m.id, t.id) AS id, coalesce(t.place, m.place) AS place, coalesce(m.source, t.source) AS source FROM there t FULL JOIN moved m ON t.id = m.id"""
)
def merged_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of every second document, with all labelled ones moved in: they replace those of their id, at the place these had."""
    there = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("place"), F.lit("there").alias("source"))
    moved = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct().select("id", (F.col("id") * 10).alias("place"), F.lit("moved").alias("source"))
    return ingest.merge_first_seen(there, moved, "place").select("id", "place", "source")


@query(
    TRIAGE_SQL
    + """, again AS (SELECT *, doc_id % 5 = 0 AND track = 'open' AND NOT contains(hay, 'standing') AS changed FROM triaged), told AS (SELECT *, k OR changed AS k2 FROM again)
    SELECT id, changed, CASE WHEN changed THEN 't2' ELSE 't1' END AS generated_at,
        CASE WHEN s AND m AND NOT k2 THEN 'suggest-ask' WHEN s THEN 'suggest-skip' WHEN k2 THEN 'suggest-keep' WHEN m THEN 'suggest-ask' ELSE 'suggest-skip' END AS recommendation FROM told"""
)
def retriaged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items triaged, then once more after every fifth got a wanted word in its title: who had it already keeps the time of before."""
    first = triage.retriage(items(spark, sf_dir), CONFIG, "t1").drop("changed")
    renamed = first.withColumn("title", F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", F.lit("standing"), "title")).otherwise(F.col("title")))
    return triage.retriage(renamed, CONFIG, "t2").select("id", "changed", "triage.generated_at", "triage.recommendation")


@query("SELECT DISTINCT unnest([source, lang]) AS tag FROM documents")
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.tag_union(items(spark, sf_dir))


@query("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'labelled' END AS state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("state"))
    return ingest.upsert(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("labelled").alias("state")).distinct())


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def stale_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.stale_outputs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def review_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.review_targets(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")))


@query(
    """SELECT 'material_links' AS "table", doc_id || '-out' AS row_key, 'symmetry' AS rule, doc_id || ' next ' || (doc_id + 1) || ' outbound' AS detail FROM labels WHERE quality IS NULL OR quality <> 1"""
)
def lonely_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document links to the next one; only those of good quality are linked back."""
    a, b = F.col("doc_id"), F.col("doc_id") + 1
    edge = lambda end, src, dst, way: F.struct(F.concat(F.col("doc_id"), F.lit(end)).alias("id"), src.cast("string").alias("item_id"), dst.cast("string").alias("ref"), F.lit("next").alias("relation"), F.lit(way).alias("direction"))
    both = F.array_compact(F.array(edge("-out", a, b, "outbound"), F.when(F.col("quality") == 1, edge("-in", b, a, "inbound"))))
    return checks.link_symmetry(table(spark, sf_dir, "labels").select(F.explode(both).alias("e")).select("e.*"))


@query(
    r"""SELECT doc_id AS source_id, 0 AS pos, trim(regexp_replace(split_part(text, chr(10), 1), '[ \t\r\f\x0B]+', ' ', 'g')) AS title, 'https://' || source || '.example.org/' || doc_id AS url, lang AS tag,
        length(regexp_replace(text, '\s+', '', 'g'))::INT AS n_letters, DATE '2024-01-31' - (doc_id % 120)::INT AS published_at FROM documents WHERE text IS NOT NULL AND source IS NOT NULL"""
)
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as feed documents of one entry each, written out as XML and read again."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    # the text is HTML within XML, so it is escaped twice
    html = escape(escape(F.col("text")))
    title = escape(escape(F.substring_index("text", "\n", 1)))
    day = F.date_format(F.date_sub(F.lit(TODAY).cast("date"), (F.col("doc_id") % 120).cast("int")), "dd MMM yyyy 00:00:00 'GMT'")
    # without a language or a number an entry lacks the elements made of it
    some = lambda name, c: F.coalesce(tag(name, c), F.lit(""))
    item = tag("item", F.concat(tag("title", title), some("link", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id")), some("pubDate", day), tag("description", html), some("category", F.col("lang"))))
    told = table(spark, sf_dir, "documents").filter("text is not null and source is not null")
    docs = told.select(F.col("doc_id").alias("source_id"), tag("rss", tag("channel", item)).alias("xml"))
    e = explode_feeds(docs)
    return e.select("source_id", "pos", "title", F.nullif("url", F.lit("")).alias("url"), F.get("tags", F.lit(0)).alias("tag"), F.length(F.regexp_replace("summary", r"\s+", "")).alias("n_letters"), "published_at")
