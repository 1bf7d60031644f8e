"""Guard against claims in generated texts that their sources don't support, and what comes back from reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import clean_text, split_sentences, text


def guard_claims(records: DataFrame, source_col: str, output_col: str, signal: str, hedge: str, confidence_col: str | None = None) -> DataFrame:
    """records with `guarded` (the output without unsupported sentences), `n_dropped`, `fact_claim`, and confidence lowered where something was dropped.

    If the source has the signal (a regular expression), the output stays. Else its sentences with the signal go, unless they hedge. Null outputs are empty.
    """
    supported = F.regexp_like(text(source_col), F.lit(signal))
    parts = split_sentences(output_col)
    bad = lambda s: F.regexp_like(s, F.lit(signal)) & ~F.regexp_like(s, F.lit(hedge))
    dropped = F.when(supported, 0).otherwise(F.size(F.filter(parts, bad)))
    kept = F.when(dropped == 0, text(output_col)).otherwise(F.array_join(F.filter(parts, lambda s: ~bad(s)), " "))
    out = records.withColumns({"n_dropped": dropped, "guarded": kept, "fact_claim": dropped > 0})
    return out.withColumn(confidence_col, F.when(F.col("fact_claim"), "low").otherwise(F.col(confidence_col))) if confidence_col else out


def apply_reviews(records: DataFrame, reviews: DataFrame, primary: str, id_col: str = "id", clear: bool = False) -> DataFrame:
    """records with `reviews` (a map from provider to its last review: recommendation, summary, reasons) and `chosen_review`: that of the primary provider, else the latest.
    Texts are clipped and reasons padded to three. clear: earlier maps are not kept."""
    r = reviews.select(
        F.col("item_id").alias("__id"), "provider", "at",
        F.struct(F.col("recommendation"), clean_text("summary", limit=900).alias("summary"), F.slice(F.concat(F.transform(F.coalesce("reasons", F.array().cast("array<string>")), lambda s: clean_text(s, limit=180)), F.array_repeat(F.lit("to be checked"), 3)), 1, 3).alias("reasons")).alias("review"),
    )
    one = r.groupBy("__id", "provider").agg(F.max_by("review", "at").alias("review"), F.max("at").alias("at"))
    best = F.max_by("review", F.struct(F.col("provider") == primary, "at"))
    by_item = one.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("provider", "review"))).alias("__reviews"), best.alias("__chosen"))
    out = records.join(by_item, F.col(id_col) == F.col("__id"), "left")
    if "reviews" in records.columns and not clear:
        old = F.map_filter("reviews", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("__reviews"), k), F.lit(False)))
        merged = F.coalesce(F.map_concat(old, F.col("__reviews")), F.col("reviews"))
    else:
        merged = F.col("__reviews")
    return out.withColumn("reviews", merged).withColumn("chosen_review", F.col("__chosen")).drop("__id", "__reviews", "__chosen")


def assign_batches(items: DataFrame, weights: dict[str, int], size: int, id_col: str = "id") -> DataFrame:
    """items with `provider`, by a hash of the id in proportion to the weights, and `batch`: about `size` items of a provider each. The number of batches follows from a
    count by provider, and an item's batch from its hash, so nothing is numbered in one task."""
    total, bound, provider = sum(weights.values()), 0, F.lit(None).cast("string")
    slot = F.pmod(F.xxhash64(text(id_col)), F.lit(total))
    for name, w in weights.items():
        provider = F.when((slot >= bound) & (slot < bound + w), name).otherwise(provider)
        bound += w
    placed = items.withColumn("provider", provider)
    n = placed.groupBy("provider").agg(F.ceil(F.count(F.lit(1)) / size).alias("__n"))
    return placed.join(F.broadcast(n), "provider").withColumn("batch", F.pmod(F.xxhash64(text(id_col), F.lit(1)), F.col("__n"))).drop("__n")


def apply_translation(records: DataFrame, translations: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """records with the `translation` of the provider that stands first in `order`, others after them by name."""
    rank = F.coalesce(*[F.when(F.col("provider") == p, i) for i, p in enumerate(order)], F.lit(len(order)))
    best = translations.groupBy(F.col("item_id").alias("__id")).agg(F.min_by(F.struct("provider", "title", "markdown"), F.struct(rank, "provider")).alias("translation"))
    return records.join(best, F.col(id_col) == F.col("__id"), "left").drop("__id")


def review_targets(records: DataFrame, reviewed: DataFrame, statuses: list[str] | None = None, provider: str | None = None, id_col: str = "id") -> DataFrame:
    """Records without a review, by one provider or by any."""
    done = reviewed.filter(F.col("provider") == provider) if provider else reviewed
    scope = records.filter(F.col("status").isin(*statuses)) if statuses else records
    return scope.join(done.select(F.col("item_id").alias(id_col)), id_col, "left_anti")


def review_work(records: DataFrame, best: Column) -> DataFrame:
    """What a reviewer gets: clipped fields, at most twelve tags, triage hints, the best text and what it is."""
    return records.select(
        "id", "track", clean_text("title", limit=300).alias("title"), clean_text("summary", limit=1200).alias("summary"), F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 12).alias("tags"),
        F.col("triage.recommendation").alias("recommendation"), F.slice("triage.matched_keywords", 1, 8).alias("matched_keywords"), best["text"].alias("text"), best["basis"].alias("basis"),
    )


def priority_order(records: DataFrame, now: str, most: int | None = None) -> DataFrame:
    """Records for review: in reading for a day or more first, then in reading, then the rest; newest first within each."""
    started = F.col("reader_flags.started_at").try_cast("timestamp")
    reading = F.coalesce(F.col("reader_flags.current_reading"), F.lit(False))
    rank = F.when(reading & (started <= F.expr(f"timestamp '{now}' - interval 1 day")), 0).when(reading, 1).otherwise(2)
    ordered = records.orderBy(rank, F.desc(text("captured_at")), "id")
    return ordered.limit(most) if most else ordered


def numbered_within(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
