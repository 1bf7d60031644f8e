"""Health of sources from what became of their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.dates import first_date
from quillmill.operators.triage import is_reader_item


def outcome_facts(items: DataFrame, rejected: DataFrame, candidates: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(source_id, outcome, at): accepted, rejected or pending, one row per record that counts, from the four places records lie in."""
    at = lambda df: first_date(*[c for c in ("dismissed_at", "captured_at", "published_at") if c in df.columns], serials=True).alias("at")
    items_outcome = F.when(is_reader_item(), "accepted").when(F.col("status") == "inbox", "pending")
    parts = [items.select("source_id", items_outcome.alias("outcome"), at(items)).filter("outcome is not null")]
    parts += [df.select("source_id", F.lit(o).alias("outcome"), at(df)) for df, o in ((rejected, "rejected"), (dismissed, "rejected"), (candidates, "pending"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def outcome_counts(facts: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Totals and recent counts by source, all in one aggregation; undated records are not recent."""
    recent = F.coalesce(F.col("at") >= F.expr(f"timestamp '{now}' - interval {int(days)} days"), F.lit(False))
    is_ = lambda o: F.col("outcome") == o
    return facts.groupBy("source_id").agg(*[F.count_if(is_(o)).alias(f"{o}_total") for o in ("accepted", "rejected", "pending")], *[F.count_if(is_(o) & recent).alias(f"{o}_recent") for o in ("accepted", "rejected", "pending")])


def assess(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """sources with their counts and `level`, `suggested_status` and `suggested_frequency`.

    The first rule that holds decides: archived, failed, rejected much more than accepted, blocked by keywords, mostly duplicates, accepted often, no data, else watched.
    """
    s = sources.join(counts.withColumnRenamed("source_id", "id"), "id", "left").na.fill(0, [c for c in counts.columns if c != "source_id"])
    last = lambda f: F.coalesce(F.col(f"rss_health.{f}"), F.lit(0))
    accepted, rejected, pending = (F.col(f"{o}_recent") for o in ("accepted", "rejected", "pending"))
    blocked, duplicates, new = last("skipped_source_keywords"), last("skipped_duplicate_recent"), last("new_items")
    status, often = F.coalesce("status", F.lit("active")), F.coalesce("fetch_frequency", F.lit("daily"))
    rules = [
        (F.col("status").eqNullSafe("archived"), "archived", F.lit("archived"), often),
        (F.col("rss_health.last_fetch_status").eqNullSafe("failed"), "danger", F.lit("paused"), F.lit("paused")),
        ((rejected >= 5) & (rejected >= F.greatest(accepted * 2, F.lit(3))), "danger", F.lit("paused"), F.lit("paused")),
        ((blocked >= 10) & (blocked >= F.greatest(new * 3, F.lit(10))), "watch", status, F.lit("weekly")),
        ((duplicates >= 10) & (new <= 2), "watch", status, F.lit("weekly")),
        ((accepted >= 5) & (accepted >= rejected), "healthy", status, F.lit("daily")),
        ((accepted == 0) & (rejected == 0) & (pending == 0), "new", status, F.lit("weekly")),
        (F.lit(True), "watch", status, often),
    ]
    out = F.lit(None)
    for holds, level, to, frequency in reversed(rules):
        out = F.when(holds, F.struct(F.lit(level).alias("level"), to.alias("suggested_status"), frequency.alias("suggested_frequency"))).otherwise(out)
    return s.withColumn("__a", out).select("*", "__a.*").drop("__a")


def level_distribution(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("level").agg(F.count(F.lit(1)).alias("n_sources"))
