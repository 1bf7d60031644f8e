"""Tables that grow over runs: history found by filters of its keys, changes that touch only their partitions, counts kept by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from quillmill.plans.working import forget, remove, stored

#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32_768
HASHES = 8
#: Bitmaps for each day: a key has HASHES bits in one of them, so with 2,000 keys to a bitmap about one strange key in 10,000 seems known.
BITMAPS = 256
#: Where the filters lie within a history's folder; readers of the folder pass over names that begin like this.
FILTERS = "_filters"


# --- history by day ---


def _bits(key: Column | str, bitmaps: int) -> tuple[Column, Column]:
    """The bitmap of a key, and its bits there."""
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(bitmaps)).cast("int"), F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(BITMAP)) for i in range(HASHES)])


def history_schema(entries: DataFrame) -> StructType:
    return StructType([*entries.schema.fields, StructField("batch", LongType()), StructField("day", DateType())])


def add_to_history(entries: DataFrame, path: str, batch: int, at: str = "at", bitmaps: int = BITMAPS) -> None:
    """Adds entries (with `keys`) to the table at path, in partitions by batch and day, and the filter of each day's keys beside them. A batch that runs again overwrites what it added.

    A filter is a Bloom filter cut into bitmaps: each key sets HASHES bits in one of them. They are made by Spark's bitmap aggregate, so of each bitmap only
    the bits set in a task are shuffled, and a day's filters of several batches are one by `or`. All runs over a path have to use the same number of bitmaps.
    """
    marked = stored(entries.withColumn("batch", F.lit(batch).cast("long")).withColumn("day", F.to_date(at)), "history-batch")
    put = lambda df, to: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(to)
    where, bits = _bits("key", bitmaps)
    keys = marked.select("batch", "day", F.explode("keys").alias("key")).select("batch", "day", where.alias("bitmap"), F.explode(bits).alias("bit"))
    put(keys.groupBy("batch", "day", "bitmap").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), f"{path}/{FILTERS}")
    put(marked, path)
    forget(marked)


def days_hit(filters: DataFrame, keys: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """(day, n): the days that may have some of keys (key), and how many. None that has one is left out. A key meets the one bitmap of each day that it would be in."""
    days = filters.groupBy("day", "bitmap").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    where, bits = _bits("key", bitmaps)
    asked = keys.select("key").distinct().select("key", where.alias("bitmap"), bits.alias("asked"))
    is_set = F.expr("forall(asked, p -> shiftright(cast(conv(hex(substring(bits, cast(p div 8 as int) + 1, 1)), 16, 10) as int), cast(p % 8 as int)) & 1 = 1)")
    return asked.join(days, "bitmap").filter(is_set).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def known_keys(spark: SparkSession, path: str, schema: StructType, keys: DataFrame, since: Column | None = None, before: int | None = None, at: str = "at", bitmaps: int = BITMAPS) -> DataFrame:
    """Those of keys (key) that the history at path has, since a time and from batches before one. Only the days whose filters some of the keys pass are read, then keys are
    compared; the driver sees these days alone, at most those of the lookback."""
    filters = spark.read.schema("bitmap int, bits binary, batch long, day date").parquet(f"{path}/{FILTERS}")
    old = F.lit(True) if before is None else F.col("batch") < before
    recent = F.lit(True) if since is None else F.col("day") >= F.to_date(since)
    days = [x.day for x in days_hit(filters.filter(old & recent), keys, bitmaps).select("day").collect()]
    read = spark.read.schema(schema).parquet(path).filter(old & F.col("day").isin(days) if days else F.lit(False))
    if since is not None:
        read = read.filter(F.col(at) >= since)
    return read.select(F.explode("keys").alias("key")).join(keys.select("key").distinct(), "key", "left_semi").distinct()


# --- changes by partition ---


def upsert_partitions(spark: SparkSession, path: str, changes: DataFrame, key: str = "id", partition: str = "part", insert: bool = True) -> list:
    """Puts the rows of changes in place of those with their key in the partitioned table at path, adds the others if `insert`, and returns the partitions it wrote.

    Only partitions that hold a changed key, or get one, are read whole and overwritten; files of all others stay as they are. A row may move to another partition. Keys are unique in changes and not null. Doing it
    again changes nothing. The list of touched partitions passes the driver: as many as the table has at most.
    """
    whole = spark.read.schema(changes.schema).parquet(path)
    new = stored(changes, "changes")
    held = whole.select(key, partition).join(new.select(key), key, "left_semi")
    into = new.select(key, partition) if insert else new.join(whole.select(key), key, "left_semi").select(key, partition)
    touched = [x[0] for x in held.select(partition).union(into.select(partition)).distinct().collect()]
    if not touched:
        return []
    where = F.coalesce(F.col(partition).isin([x for x in touched if x is not None]), F.lit(False)) | (F.col(partition).isNull() if None in touched else F.lit(False))
    there = whole.filter(where)
    rows = there.join(new.select(key), key, "left_anti").unionByName(new if insert else new.join(there.select(key), key, "left_semi"))
    done = stored(rows.select(*changes.columns), "upserted")
    done.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    # what has no row left is not overwritten
    empty = set(touched) - {x[0] for x in done.select(partition).distinct().collect()}
    for x in empty:
        remove(spark, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if x is None else x}")
    forget(done)
    forget(new)
    return sorted(touched, key=lambda x: (x is None, str(x)))


# --- tables laid out for their joins ---


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """A catalog table dealt into buckets by a key and sorted within: joins and groupings by that key need no exchange of it, nor do two such tables with the same number of buckets."""
    w = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (w.option("path", path) if path else w).saveAsTable(name)


# --- counts by day ---


def daily_outcomes(facts: DataFrame, at: str = "at") -> DataFrame:
    """(source_id, day, accepted, rejected, pending): all that windows of whole days need of facts. Days without any of the three count too, if there is a fact."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return facts.filter(F.col(at).isNotNull()).groupBy("source_id", F.to_date(at).alias("day")).agg(count("accepted"), count("rejected"), count("pending"))


def add_daily(facts: DataFrame, path: str, batch: int, at: str = "at") -> None:
    """The counts of a batch of facts, added to the table at path: facts that come late add to their day and to no other. A batch that runs again overwrites what it added."""
    counted = daily_outcomes(facts, at).withColumn("batch", F.lit(batch).cast("long"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def rolling_from_daily(daily: DataFrame, days: int = 30) -> DataFrame:
    """The rows of rolling_outcomes with a step of a day, from counts by day (of one or more batches): every window of so many days in which a source has a fact.

    What is shuffled is a row for each source and day, not one for each fact and window: a source's days are gathered (as many as history is long), windows are laid
    over them there, and a range frame sums each.
    """
    names = ("accepted", "rejected", "pending")
    by_day = daily.groupBy("source_id", "day").agg(*[F.sum(x).alias(x) for x in names])
    own = by_day.groupBy("source_id").agg(F.collect_list(F.struct(F.unix_date("day").alias("d"), *names, F.lit(False).alias("begins"))).alias("own"))
    zero = F.lit(0).cast("long")
    starts = F.array_distinct(F.flatten(F.transform("own", lambda x: F.sequence(x["d"] - (days - 1), x["d"]))))
    rows = F.concat("own", F.transform(starts, lambda d: F.struct(d.alias("d"), *[zero.alias(x) for x in names], F.lit(True).alias("begins"))))
    laid = own.select("source_id", F.inline(rows))
    within = Window.partitionBy("source_id").orderBy("d").rangeBetween(0, days - 1)
    summed = laid.select("source_id", "d", "begins", *[F.sum(x).over(within).alias(x) for x in names]).filter("begins")
    start = F.date_from_unix_date("d").cast("timestamp")
    return summed.select(start.alias("window_start"), (start + F.expr(f"interval {int(days)} days")).alias("window_end"), "source_id", *names)
