import os
import random
import re

from pyspark.sql import functions as F
from quillmill.operators import history
from quillmill.streaming import jobs


def entries_of(spark, rows):
    return spark.createDataFrame(rows, "id int, keys array<string>, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_filters_prune_days_and_lose_no_key(spark, tmp_path):
    """Twenty days of 300 keys each; a few keys of three days are asked. Only those days are read, and what is found is what a plain join finds."""
    rows = [(d * 1000 + i, [f"k{d}-{i}"], f"2024-01-{d + 1:02d} 10:00:00") for d in range(20) for i in range(300)]
    df, path = entries_of(spark, rows), str(tmp_path)
    history.add_to_history(df.filter("id < 9500"), path, 0, bitmaps=4)
    history.add_to_history(df.filter("id >= 9500"), path, 1, bitmaps=4)
    history.add_to_history(df.filter("id >= 9500"), path, 1, bitmaps=4)  # again
    assert spark.read.parquet(path).count() == 6000
    asked = spark.createDataFrame([("k3-7",), ("k9-200",), ("k9-299",), ("k15-0",), ("k15-0",), ("new",)], "key string")
    schema = history.history_schema(df)
    known = history.known_keys(spark, path, schema, asked, bitmaps=4)
    assert {x.key for x in known.collect()} == {"k3-7", "k9-200", "k9-299", "k15-0"}
    filters = " ".join(re.findall(r"PartitionFilters: \[.*?\]", known._jdf.queryExecution().toString()))
    assert set(re.findall(r"2024-01-\d\d", filters)) == {"2024-01-04", "2024-01-10", "2024-01-16"}
    since = F.lit("2024-01-11").cast("timestamp")
    assert {x.key for x in history.known_keys(spark, path, schema, asked, since, bitmaps=4).collect()} == {"k15-0"}
    assert {x.key for x in history.known_keys(spark, path, schema, asked, before=1, bitmaps=4).collect()} == {"k3-7", "k9-200", "k9-299"}
    none = asked.filter("key = 'absent'")
    assert history.known_keys(spark, path, schema, none, bitmaps=4).count() == 0


def test_share_of_strange_keys_that_seem_known(spark, tmp_path):
    df = entries_of(spark, [(i, [f"k{i}"], "2024-01-01 10:00:00") for i in range(8000)])
    history.add_to_history(df, str(tmp_path), 0, bitmaps=4)  # 2,000 keys to a bitmap
    filters = spark.read.parquet(f"{tmp_path}/{history.FILTERS}")
    strange = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("key"))
    hit = history.days_hit(filters, strange, 4).first()
    assert (hit.n if hit else 0) <= 20
    own = df.select(F.explode("keys").alias("key"))
    assert history.days_hit(filters, own, 4).first().n == 8000


def files_of(path):
    return {p: {f for f in os.listdir(f"{path}/{p}") if f.startswith("part")} for p in os.listdir(path) if "=" in p}


def test_upserts_touch_only_their_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(i, i * 10, f"p{i % 5}") for i in range(50)]
    spark.createDataFrame(rows, "id int, v int, part string").repartition("part").write.partitionBy("part").parquet(path)
    before = files_of(path)
    changes = spark.createDataFrame([(3, -1, "p3"), (8, -2, "p9"), (100, -3, "p3"), (101, -4, None)], "id int, v int, part string")
    assert history.upsert_partitions(spark, path, changes) == ["p3", "p9", None]
    after = files_of(path)
    assert all(after[f"part=p{k}"] == before[f"part=p{k}"] for k in (0, 1, 2, 4)) and after["part=p3"] != before["part=p3"]
    want = {i: (v, p) for i, v, p in rows} | {3: (-1, "p3"), 8: (-2, "p9"), 100: (-3, "p3"), 101: (-4, None)}
    read = lambda: {x.id: (x.v, x.part) for x in spark.read.schema("id int, v int, part string").parquet(path).collect()}
    assert read() == want
    history.upsert_partitions(spark, path, changes)
    assert read() == want
    only = spark.createDataFrame([(0, 7, "p0"), (500, 7, "p0")], "id int, v int, part string")
    history.upsert_partitions(spark, path, only, insert=False)
    assert read() == want | {0: (7, "p0")}
    assert history.upsert_partitions(spark, path, only.limit(0)) == []


def test_a_partition_that_loses_all_rows(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string").write.partitionBy("part").parquet(path)
    history.upsert_partitions(spark, path, spark.createDataFrame([(1, "b")], "id int, part string"))
    assert sorted(map(tuple, spark.read.schema("id int, part string").parquet(path).collect())) == [(1, "b"), (2, "b")]


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(1000).selectExpr("concat('s', id % 50) source_id", "id v")
        history.save_bucketed(a, "bucketed_items", "source_id", 4, f"{tmp_path}/a")
        history.save_bucketed(a.groupBy("source_id").count(), "bucketed_sources", "source_id", 4, f"{tmp_path}/b")
        joined = spark.table("bucketed_items").join(spark.table("bucketed_sources"), "source_id").groupBy("source_id").agg(F.sum("v"), F.max("count"))
        assert joined.count() == 50
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # one side of a join with a table that is not bucketed stays where it is
        mixed = spark.table("bucketed_items").join(a.groupBy("source_id").agg(F.min("v").alias("least")), "source_id")
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        assert mixed.count() == 1000 and plan.split("bucketed_items")[0].count("Exchange hashpartitioning") <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table if exists bucketed_items")
        spark.sql("drop table if exists bucketed_sources")


def test_windows_from_days_equal_windows_from_facts(spark, tmp_path):
    r = random.Random(3)
    kinds = ["accepted", "rejected", "pending", "duplicate", None]
    rows = [(r.choice(["a", "b", None]), r.choice(kinds), f"2024-0{r.randrange(1, 4)}-{r.randrange(1, 28):02d} {r.randrange(24):02d}:59:59") for _ in range(200)] + [("a", "accepted", None)]
    facts = spark.createDataFrame(rows, "source_id string, outcome string, at string").withColumn("at", F.col("at").cast("timestamp"))
    want = sorted(map(str, jobs.rolling_outcomes(facts).collect()))
    assert sorted(map(str, history.rolling_from_daily(history.daily_outcomes(facts)).collect())) == want
    # in batches, one of them twice
    parts = [facts.filter(f"pmod(hash(at), 3) = {k}") for k in range(3)] + [facts.filter("at is null")]
    for k in (0, 1, 2, 1, 3):
        history.add_daily(parts[k], f"{tmp_path}/daily", k)
    assert sorted(map(str, history.rolling_from_daily(spark.read.parquet(f"{tmp_path}/daily")).collect())) == want


def test_daily_counts_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", "accepted", "2024-01-01 01:00:00"), ("a", "rejected", "2024-01-02 01:00:00"), ("b", "pending", "2024-01-01 05:00:00")], "source_id string, outcome string, at string").withColumn("at", F.col("at").cast("timestamp"))
    for late in (df.filter("outcome <> 'accepted'"), df.filter("outcome = 'accepted'")):
        late.write.mode("append").parquet(f"{tmp_path}/in")
        query = jobs.daily_to_table(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/daily", f"{tmp_path}/cp")
        assert query.awaitTermination(120)
    got = history.rolling_from_daily(spark.read.parquet(f"{tmp_path}/daily"))
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.rolling_outcomes(df).collect()))
