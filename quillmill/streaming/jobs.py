"""The batch rules as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmill.operators.history import FILTERS, add_daily, add_to_history, history_schema, known_keys
from quillmill.operators.ingest import new_entries
from quillmill.operators.triage import Keywords, triage
from quillmill.plans.working import swept


def dedup_stream(entries: DataFrame, key: str = "key", at: str = "at", lookback: str = "90 days") -> DataFrame:
    """The first of each key within the lookback. Rows later than the watermark are dropped; the batch rule instead forgets history older than its window."""
    return entries.withWatermark(at, lookback).dropDuplicatesWithinWatermark([key])


def dedup_to_table(entries: DataFrame, path: str, checkpoint: str, order: list[str], at: str = "at", days: int = 90):  # noqa: ANN201
    """Starts a query that adds the new ones of a stream of entries to a table, by all their keys (a column `keys`, see entry_keys).

    A batch is held against itself, in `order`, and against what earlier batches added within so many days before its newest entry. The table is partitioned by batch and day: a
    batch that runs again is not held against what it added before, and overwrites it. Of the table a batch reads the days whose filters some of its keys pass (see add_to_history).
    """
    schema = history_schema(entries)
    spark = entries.sparkSession
    spark.createDataFrame([], schema).write.mode("append").partitionBy("batch", "day").parquet(path)
    spark.createDataFrame([], "bitmap int, bits binary, batch long, day date").write.mode("append").partitionBy("batch", "day").parquet(f"{path}/{FILTERS}")

    def save(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max(at)).first()[0]
        since = F.lit(newest) - F.expr(f"interval {int(days)} days")
        with swept(batch.sparkSession):
            known = known_keys(batch.sparkSession, path, schema, batch.select(F.explode("keys").alias("key")), since, number, at)
            new = new_entries(batch, known, order).filter("entry_outcome = 'new'").drop("entry_outcome")
            add_to_history(new, path, number, at)

    return entries.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_to_table(facts: DataFrame, path: str, checkpoint: str, at: str = "at"):  # noqa: ANN201
    """Starts a query that adds the counts by day of a stream of facts to a table (see add_daily and rolling_from_daily), with no state and no watermark."""
    return facts.writeStream.foreachBatch(lambda batch, number: add_daily(batch, path, number, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_outcomes(facts: DataFrame, at: str = "at", length: str = "30 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Accepted, rejected and pending records by source in sliding windows; works on streams and, without the watermark's effect, on tables."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    grouped = facts.withWatermark(at, late).groupBy(F.window(at, length, step).alias("w"), "source_id").agg(count("accepted"), count("rejected"), count("pending"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source_id", "accepted", "rejected", "pending")


def triage_to_table(items: DataFrame, config: dict[str, Keywords], path: str, checkpoint: str):  # noqa: ANN201
    """Starts a query that triages a stream of items and adds each batch once: the batch id is a partition, which a batch that runs again overwrites."""

    def save(batch: DataFrame, number: int) -> None:
        triage(batch, config).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return items.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RetryCooldown(StatefulProcessor):
    """Lets an item's attempt through if none was let through in the days before; counts its attempts."""

    def __init__(self, days: int = 7):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempt", "last timestamp, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, n = self.state.get() if self.state.exists() else (None, 0)
        times = sorted(t for f in rows for t in f["at"])
        out = []
        for t in times:
            if last is None or t - pd.Timestamp(last) >= pd.Timedelta(days=self.days):
                last, n = t, n + 1
                out.append((key[0], t, n))
        if last is not None:
            self.state.update((pd.Timestamp(last).to_pydatetime(), n))
        yield pd.DataFrame(out, columns=["id", "at", "attempt"])

    def close(self) -> None:
        pass


def cooled_down(attempts: DataFrame, days: int = 7) -> DataFrame:
    """(id, at, attempt) of the attempts (id: string, at) that a cool-down of so many days lets through."""
    return attempts.groupBy("id").transformWithStateInPandas(statefulProcessor=RetryCooldown(days), outputStructType="id string, at timestamp, attempt int", outputMode="Append", timeMode="None")
