"""Feed ingest: which sources are due, which entries are new, and what a run did."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.dates import first_date
from quillmill.functions.text import clean_text, fold, haystack, match_terms, stable_id, strip, text
from quillmill.functions.urls import normalize_url, unwrap_redirect
from quillmill.plans.working import forget, stored
from quillmill.schemas import READER_ACTIONS

# The names of fetch frequencies, and the hours between fetches.
HOURS = {"hourly": 1, "six-hourly": 6, "daily": 24, "weekly": 168, "monthly": 720}
ALIASES = {
    "1h": "hourly", "1-hour": "hourly", "hour": "hourly", "6h": "six-hourly", "6-hour": "six-hourly", "6-hourly": "six-hourly", "six-hour": "six-hourly",
    "six_hourly": "six-hourly", "manual": "on-update", "on-demand": "on-update", "on_update": "on-update",
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def frequency(x: Column | str = "fetch_frequency") -> Column:
    """A frequency by its proper name; unknown and missing ones are daily."""
    name = fold(strip(text(x)))
    name = F.coalesce(F.try_element_at(_map(ALIASES), name), name)
    return F.when(name.isin(*HOURS, "on-update", "paused"), name).otherwise("daily")


def due_sources(sources: DataFrame, now: str, include_on_update: bool = False) -> DataFrame:
    """sources with `due` and `due_reason`. Never fetched is due; paused never is; on-update only when asked; others once their interval has passed."""
    kind = frequency()
    last = first_date("last_fetched_at", "rss_health.last_success_at", "rss_health.last_checked_at")
    waited = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last)) / 3600
    reason = (
        F.when(kind == "paused", "paused")
        .when(kind == "on-update", F.lit(None) if include_on_update else F.lit("only on update"))
        .when(last.isNotNull() & (waited < F.try_element_at(_map(HOURS), kind)), F.concat(kind, F.lit(" is not due yet")))
    )
    return sources.withColumn("due_reason", reason).withColumn("due", F.col("due_reason").isNull())


def fetchable_sources(sources: DataFrame, now: str, types: list[str], tracks: list[str] | None = None, include_unclassified: bool = False, include_on_update: bool = False, force: bool = False) -> DataFrame:
    """sources with `skip_reason`: the first test that fails, null if none does."""
    reason = (
        F.when(~F.col("status").eqNullSafe("active"), "not active")
        .when(F.lit(not force) & ~F.col("due"), F.col("due_reason"))
        .when(~F.coalesce(F.col("source_type").isin(*types), F.lit(False)), "type is not enabled")
        .when(~F.coalesce(F.col("track").isin(*tracks), F.lit(False)) if tracks else F.lit(False), "track is not enabled")
        .when(F.lit(not include_unclassified) & F.col("track").eqNullSafe("unclassified"), "unclassified")
        .when(~text("feed_url").rlike("^(https?|file)://"), "address can't be fetched")
    )
    return due_sources(sources, now, include_on_update).withColumn("skip_reason", reason)


def recent_entries(entries: DataFrame, sources: DataFrame, now: str, days: int = 7, first_days: int = 90) -> DataFrame:
    """entries with `too_old`: published before the window, which is longer for sources never fetched with success. Undated entries pass. sources joins as a dimension."""
    window = F.when(first_date("last_fetched_at", "rss_health.last_success_at").isNotNull(), days).otherwise(first_days)
    of = sources.select(F.col("id").alias("source_id"), window.alias("__days"))
    cutoff = F.date_sub(F.lit(now).cast("date"), F.coalesce("__days", F.lit(first_days)))
    return entries.join(of, "source_id", "left").withColumn("too_old", F.coalesce(F.col("published_at") < cutoff, F.lit(False))).drop("__days")


def source_keyword_gate(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """entries with `blocked`: an excluded term of the source occurs, or it requires terms and none does."""
    of = sources.select(F.col("id").alias("source_id"), F.col("required_keywords").alias("__required"), F.col("excluded_keywords").alias("__excluded"))
    hay = fold(haystack("title", "summary", "source_id", "author", "tags", "url"))
    none = F.array().cast("array<string>")
    hit = lambda c: F.size(match_terms(hay, F.coalesce(F.col(c), none))) > 0
    required = F.size(F.filter(F.coalesce("__required", none), lambda t: strip(t) != "")) > 0
    return entries.join(of, "source_id", "left").withColumn("blocked", hit("__excluded") | (required & ~hit("__required"))).drop("__required", "__excluded")


def recent_history(history: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Records whose first readable date (captured, published, dismissed) lies within the window; undated ones are left out."""
    return history.filter(first_date("captured_at", "published_at", "dismissed_at") >= F.date_sub(F.lit(now).cast("date"), days))


def entry_keys(df: DataFrame, id_col: str, url_cols: list[str], guid_col: str | None = None) -> Column:
    """The keys by which records are the same: id, each address in normal form, and guid, marked by their kind; empty ones left out."""
    urls = [normalize_url(F.col(c)) for c in url_cols]
    guid = strip(text(guid_col)) if guid_col else F.lit("")
    urls.append(F.when(guid.rlike("^https?://"), normalize_url(guid)).otherwise(""))
    marked = [("id", text(id_col)), ("guid", guid), *(("url", u) for u in urls)]
    return F.array_distinct(F.filter(F.array(*[F.when(v != "", F.concat(F.lit(k + ":"), v)) for k, v in marked]), lambda x: x.isNotNull()))


def _opened(entries: DataFrame, seen: DataFrame, order: list[str], gate: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries with rank and gate, all their keys, and the ranks of those that have a key of seen."""
    ranked = stored(entries.withColumn("__rank", F.struct(*order)).withColumn("__gate", F.coalesce(F.col(gate), F.lit(False)) if gate else F.lit(False)), "entries")
    every = ranked.select("__rank", "__gate", F.explode("keys").alias("key"))
    return ranked, every, stored(every.join(seen.select("key").distinct(), "key", "left_semi").select("__rank").distinct(), "known")


def _hidden_late(every: DataFrame, accepted: DataFrame) -> DataFrame:
    """The ranks of blocked entries that share a key with one accepted before them."""
    first = every.join(accepted.select("__rank"), "__rank").groupBy("key").agg(F.min("__rank").alias("by"))
    return every.filter("__gate").join(first, "key").filter(F.col("by") < F.col("__rank")).select("__rank").distinct()


def _to_ends(links: DataFrame) -> DataFrame:
    """links (__rank, to, odd) with `to` at the end of its chain, and odd telling whether the steps to it are odd in number: each pass doubles the steps."""
    while True:
        following = links.select(F.col("__rank").alias("to"), F.col("to").alias("further"), F.col("odd").alias("more"))
        doubled = links.join(following, "to", "left").select(
            "__rank", F.coalesce("further", "to").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("further").isNotNull().alias("moved")
        )
        longer = stored(doubled, "links")
        forget(links)
        links = longer.drop("moved")
        if not longer.filter("moved").limit(1).count():
            return links


def new_entries(entries: DataFrame, seen: DataFrame, order: list[str], gate: str | None = None) -> DataFrame:
    """entries (with `keys`) and `entry_outcome`: new, duplicate or, if `gate` (a boolean column) is true, blocked.

    As if read one by one in `order`, which must tell all rows apart: an entry is a duplicate if one of its keys is in `seen` (a table of `key`) or belongs to an entry accepted before.
    Blocked entries add no keys. The loop becomes rounds over exploded keys: who holds the least rank of all its keys is accepted. An entry of which all keys but those it is first in
    have the same entry before it, and no other, is new if that one is a duplicate and the other way round; so chains of such entries are followed to their ends by doubling, and every
    second one of a chain from an accepted entry is new. Who shares a key with an accepted one is a duplicate, and the rest go on, with only the keys that are still shared among them.
    A round accepts at least the first of what is left, so they end. Entries without keys are new. Working tables of a round go with the next; entries and labels stay, as the result is lazy.
    """
    ranked, every, known = _opened(entries, seen, order, gate)
    labels = [known.withColumn("__label", F.lit("duplicate"))]
    pending = stored(every.filter("not __gate").join(known, "__rank", "left_anti").select("__rank", "key"), "pending")
    while pending.limit(1).count():
        marked = pending.join(pending.groupBy("key").agg(F.min("__rank").alias("least")), "key")
        behind = F.col("__rank") != F.col("least")
        second = marked.filter(behind).groupBy("key").agg(F.min("__rank").alias("second"))
        before = F.when(behind, F.col("least"))
        states = marked.join(second, "key", "left").groupBy("__rank").agg(
            F.bool_and(~behind).alias("won"), F.min(before).alias("to"), (F.bool_and(~behind | (F.col("__rank") == F.col("second"))) & (F.min(before) == F.max(before))).alias("single")
        )
        states = stored(states, "states")
        won = states.filter("won").select("__rank")
        links = _to_ends(stored(states.filter("not won and single").select("__rank", "to", F.lit(True).alias("odd")), "links"))
        ended = links.join(won.select(F.col("__rank").alias("to")), "to").select("__rank", F.when(F.col("odd"), "duplicate").otherwise("new").alias("__label"))
        decided = stored(won.withColumn("__label", F.lit("new")).unionByName(ended), "labels")
        taken = pending.join(decided.filter("__label = 'new'"), "__rank", "left_semi").select("key").distinct()
        lost = pending.join(taken, "key", "left_semi").select("__rank").distinct().join(decided, "__rank", "left_anti").withColumn("__label", F.lit("duplicate"))
        labels += [decided, stored(lost, "labels")]
        left = stored(pending.join(labels[-2], "__rank", "left_anti").join(labels[-1], "__rank", "left_anti"), "pending")
        for df in (pending, states, links):
            forget(df)
        pending = left
        if len(labels) > 8:  # else the plan grows by two branches a round
            whole = stored(reduce(DataFrame.unionByName, labels), "labels")
            for df in labels[1:]:
                forget(df)
            labels = [whole]
    forget(pending)
    label = reduce(DataFrame.unionByName, labels)
    if gate:
        label = label.unionByName(_hidden_late(every, label.filter("__label = 'new'")).join(known, "__rank", "left_anti").withColumn("__label", F.lit("duplicate")))
    outcome = F.coalesce("__label", F.when(F.col("__gate"), "blocked").otherwise("new"))
    return ranked.join(label, "__rank", "left").withColumn("entry_outcome", outcome).drop("__rank", "__gate", "__label")


def new_entries_capped(entries: DataFrame, seen: DataFrame, order: list[str], gate: str | None = None, most: int = 10) -> DataFrame:
    """As new_entries, but a source is left once `most` of its entries are new: later ones of it are `unseen`, and hide nothing with their keys.

    Who is a duplicate depends on who was accepted, and that on how many of its source were before; so rounds settle both together. Of each source the first `most` of what is accepted or
    still open are within the cap, whatever becomes of the open ones. Of these, who holds the least rank of all its keys is accepted; who shares a key with an accepted one
    is a duplicate, and what follows a source's last one is unseen. The first open entry is always settled, so rounds end. Needs a column source_id; a null source is one source.
    """
    ranked, every, known = _opened(entries, seen, order, gate)
    source = F.coalesce(F.to_json(F.struct("source_id")), F.lit("")).alias("source")
    mine = ranked.filter("not __gate").join(known, "__rank", "left_anti")
    still = stored(mine.select("__rank", source), "open")
    keys = stored(every.filter("not __gate").join(known, "__rank", "left_anti").select("__rank", "key"), "open-keys")
    accepted = stored(still.limit(0), "accepted")
    place = F.row_number().over(Window.partitionBy("source").orderBy("__rank"))
    while still.limit(1).count():
        both = accepted.withColumn("is_open", F.lit(False)).unionByName(still.withColumn("is_open", F.lit(True)))
        within = both.withColumn("place", place).filter(F.col("place") <= most).filter("is_open").select("__rank", "source")
        least = keys.groupBy("key").agg(F.min("__rank").alias("least"))
        later = keys.join(least, "key").filter("__rank != least").select("__rank").distinct()
        taken_up = within.join(later, "__rank", "left_anti")
        wider = stored(accepted.unionByName(taken_up), "accepted")
        full = wider.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("__rank").alias("last")).filter(F.col("n") == most)
        held = keys.join(wider, "__rank", "left_semi").select("key").distinct()
        hidden = keys.join(held, "key", "left_semi").select("__rank").distinct()
        left = still.join(wider, "__rank", "left_anti").join(hidden, "__rank", "left_anti").join(full, "source", "left")
        now_open = stored(left.filter(F.col("last").isNull() | (F.col("__rank") <= F.col("last"))).select("__rank", "source"), "open")
        now_keys = stored(keys.join(now_open, "__rank", "left_semi"), "open-keys")
        for df in (accepted, still, keys):
            forget(df)
        accepted, still, keys = wider, now_open, now_keys
    forget(still)
    forget(keys)
    full = accepted.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("__rank").alias("last")).filter(F.col("n") == most).select("source", "last")
    told = ranked.withColumn("source", source).join(full, "source", "left").join(accepted.select("__rank", F.lit(True).alias("is_new")), "__rank", "left")
    late = known.unionByName(_hidden_late(every, accepted)).distinct().withColumn("hidden", F.lit(True))
    told = told.join(late, "__rank", "left")
    outcome = F.when(F.col("__rank") > F.col("last"), "unseen").when(F.col("is_new"), "new").when(F.col("__gate") & F.col("hidden").isNull(), "blocked").otherwise("duplicate")
    return told.withColumn("entry_outcome", outcome).drop("__rank", "__gate", "source", "last", "is_new", "hidden")


def cap_per_source(entries: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """The first `most` new entries of each source. The cap comes after dedup: an entry beyond it still hides later ones with its keys; see new_entries_capped for the other way."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    return entries.filter("entry_outcome = 'new'").withColumn("__n", rank).filter(F.col("__n") <= most).drop("__n")


def ingest_stats(labelled: DataFrame) -> DataFrame:
    """One row per source: entries seen, and how many were new, old, duplicate and blocked."""
    count = lambda name: F.count_if(F.col("entry_outcome") == name)
    return labelled.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("entries_seen"), count("new").alias("new_items"), count("old").alias("skipped_old"), count("duplicate").alias("skipped_duplicate_recent"), count("blocked").alias("skipped_source_keywords")
    )


def run_report(labelled: DataFrame) -> DataFrame:
    """Entries by source and outcome, with totals over all sources in the same pass (source null)."""
    return labelled.rollup("entry_outcome", "source_id").agg(F.count(F.lit(1)).alias("n")).filter("entry_outcome is not null")


def write_back_health(sources: DataFrame, stats: DataFrame, now: str, failed: DataFrame | None = None) -> DataFrame:
    """sources with rss_health brought up to date. The time of success moves only where the fetch did not fail (failed: source_id, error)."""
    s = sources.join(stats.withColumnRenamed("source_id", "id"), "id", "left")
    s = s.join(failed.select(F.col("source_id").alias("id"), F.col("error").alias("__error")), "id", "left") if failed is not None else s.withColumn("__error", F.lit(None).cast("string"))
    ran, bad = F.col("entries_seen").isNotNull() | F.col("__error").isNotNull(), F.col("__error").isNotNull()
    old = lambda f: F.col(f"rss_health.{f}")
    health = F.struct(
        F.when(ran, F.lit(now)).otherwise(old("last_checked_at")).alias("last_checked_at"), F.when(ran & ~bad, F.lit(now)).otherwise(old("last_success_at")).alias("last_success_at"),
        F.when(bad, "failed").when(ran, "ok").otherwise(old("last_fetch_status")).alias("last_fetch_status"), F.when(ran, F.coalesce("__error", F.lit(""))).otherwise(old("last_error")).alias("last_error"),
        *[F.coalesce(F.col(c).cast("int"), old(c)).alias(c) for c in ("entries_seen", "new_items", "skipped_old", "skipped_duplicate_recent", "skipped_source_keywords")],
    )
    return s.withColumn("rss_health", health).select(sources.columns)


def to_items(entries: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """Entries as items with the attributes of their source; texts clipped as the item table has them."""
    of = sources.select(F.col("id").alias("source_id"), "track", F.col("name").alias("source_name"), "source_group", "source_type", F.col("feed_url").alias("__feed"))
    e = entries.join(of, "source_id")
    original = F.when(text("url") != "", F.col("url")).otherwise(F.col("guid"))
    url = unwrap_redirect(original)
    none = F.array().cast("array<string>")
    return e.select(
        stable_id("item", url, "guid", "title").alias("id"), "track", F.lit("inbox").alias("status"), F.lit("normal").alias("priority"),
        F.when(clean_text("title", "feed") != "", clean_text("title", "feed", 300)).otherwise("(untitled)").alias("title"), url.alias("url"), "source_id", "source_name",
        clean_text("author", "feed", 160).alias("author"), F.col("published_at").cast("string").alias("published_at"), F.lit(now).alias("captured_at"), clean_text("summary", "feed", 1200).alias("summary"),
        F.array_distinct(F.concat(F.array(text("source_group"), text("source_type")), F.coalesce("tags", none))).alias("tags"), F.lit("rss-fetch").alias("origin"),
        F.struct(F.col("__feed").alias("feed_url"), F.col("guid"), F.when(original != url, original).otherwise("").alias("original_url")).alias("reference"),
    )


# --- records that change over time ---


def last_by_id(records: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """The last record of each id."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order)))
    return records.withColumn("__n", rank).filter("__n = 1").drop("__n")


def archive_split(items: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): records decided as rejected go, with status, priority and time of the archive set."""
    gone = F.col("local_decision.action").eqNullSafe("rejected")
    archived = items.filter(gone).withColumns({"status": F.lit("parked"), "priority": F.lit("low"), "archived_at": F.lit(now)})
    return items.filter(~gone), archived


def merge_first_seen(existing: DataFrame, moved: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """Both tables, where moved records replace existing ones of the same id but keep their place; empty ids are dropped."""
    both = existing.withColumn("__from", F.lit(0)).unionByName(moved.withColumn("__from", F.lit(1)), allowMissingColumns=True).filter(text(id_col) != "")
    w = Window.partitionBy(id_col)
    placed = both.withColumn("__first", F.min(F.struct("__from", order)).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc("__from"), F.desc(order))))
    return placed.filter("__n = 1").withColumn(order, F.col(f"__first.{order}")).drop("__from", "__first", "__n")


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", insert: bool = True) -> DataFrame:
    """table with the rows of changes in place of those with their key; others are added if `insert`. Both sides have the same columns; keys are unique in changes."""
    t, c = table.select(F.struct("*").alias("old"), F.col(key).alias("__key")), changes.select(F.struct(*table.columns).alias("new"), F.col(key).alias("__key"))
    return t.join(c, "__key", "full" if insert else "left").select(F.coalesce("new", "old").alias("r")).select("r.*")


def pending_queue(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """What waits for a decision: inbox items, then candidates that share neither id nor address with an active item."""
    mine = items.filter("status = 'inbox'").withColumn("queue", F.lit("item"))
    keys = lambda df: entry_keys(df, "id", ["url"])
    active = items.select(F.explode(keys(items)).alias("key")).distinct()
    hidden = candidates.select("id", F.explode(keys(candidates)).alias("key")).join(active, "key", "left_semi").select("id").distinct()
    return mine.unionByName(candidates.join(hidden, "id", "left_anti").withColumn("queue", F.lit("candidate")), allowMissingColumns=True)


def apply_decisions(items: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """All records touched or not, with `goes_to`: items, rejected, candidates or gone, and status and decision set. decisions: id, action (accept, direct_pr, reject), reason, at.

    A decided candidate becomes an item or a rejected record; a candidate whose id an item has is gone. One labelled table, to be written to each place under one run.
    """
    d = decisions.select("id", F.col("action").alias("__action"), F.col("reason").alias("__reason"), F.col("at").alias("__at"))
    both = items.withColumn("__from", F.lit("items")).unionByName(candidates.join(items.select("id"), "id", "left_anti").withColumn("__from", F.lit("candidates")), allowMissingColumns=True)
    stale = candidates.join(items.select("id"), "id", "left_semi").withColumn("__from", F.lit("gone"))
    s = both.unionByName(stale, allowMissingColumns=True).join(d, "id", "left")
    live = F.col("__from") != "gone"
    goes = F.when(~live, "gone").when(F.col("__action") == "reject", "rejected").when(F.col("__action").isNotNull(), "items").otherwise(F.col("__from"))
    status = F.when(live & (F.col("__action") == "accept"), "triaged").when(live & (F.col("__action") == "direct_pr"), "ready").when(live & (F.col("__action") == "reject"), "parked").otherwise(F.col("status"))
    name = F.when(F.col("__action") == "accept", READER_ACTIONS[0]).when(F.col("__action") == "direct_pr", READER_ACTIONS[1]).when(F.col("__action") == "reject", "rejected")
    decided = F.when(live & F.col("__action").isNotNull(), F.struct(name.alias("action"), F.col("__reason").alias("reason"), F.col("__at").alias("decided_at"))).otherwise(F.col("local_decision"))
    return s.withColumns({"goes_to": goes, "status": status, "local_decision": decided}).drop("__from", "__action", "__reason", "__at")


def resume_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that are still to be done: those of the same source text that were done before stay done; a changed text starts anew."""
    return chunks.join(done, ["item_id", "source_hash", "chunk_no"], "left_anti")


def assemble_chunks(done: DataFrame) -> DataFrame:
    """(item_id, source_hash, body) of texts all of whose chunks are there, joined in order by an empty line."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    whole = done.groupBy("item_id", "source_hash").agg(F.max("total").alias("total"), F.count_distinct("chunk_no").alias("n"), parts.alias("parts"))
    return whole.filter("n = total").select("item_id", "source_hash", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("body"))


def plan_chunks(x: DataFrame, id_col: str, text_col: str, most: int = 2400) -> DataFrame:
    """(item_id, chunk_no, total, text, source_hash): a text's blocks packed in order into chunks of at most `most` characters; larger blocks are cut at
    lines, then sentences, and a sentence longer than that is a chunk of its own."""
    cut = lambda parts, pattern: F.flatten(F.transform(parts, lambda b: F.when(F.length(b) > most, F.split(b, pattern)).otherwise(F.array(b))))
    body = clean_text(text_col, "document")
    pieces = cut(cut(F.split(body, r"\n\s*\n"), "\n"), r"(?<=[。！？!?])\s*|(?<=\.)\s+")
    pieces = F.filter(F.transform(pieces, strip), lambda p: p != "")
    rows = x.select(F.col(id_col).alias("item_id"), pieces.alias("pieces"), F.sha1(body).alias("source_hash"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece goes to the open chunk if it fits, else begins one; what is yielded is a text's chunks at a time."""
        for batch in batches:
            for k in range(batch.num_rows):
                chunks: list[list[str]] = []
                held = 0
                for piece in batch.column(1)[k].as_py() or []:
                    if chunks and held + len(piece) + 2 <= most:
                        chunks[-1].append(piece)
                        held += len(piece) + 2
                    else:
                        chunks.append([piece])
                        held = len(piece)
                n = len(chunks)
                own = [pa.array([batch.column(c)[k]] * n, batch.column(c).type) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(["\n\n".join(c) for c in chunks], pa.string())], ["item_id", "source_hash", "total", "chunk_no", "text"])

    return rows.mapInArrow(pack, f"item_id {dict(rows.dtypes)['item_id']}, source_hash string, total int, chunk_no int, text string")
