"""Reading and writing record tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of JSON lines under a declared schema. Lenient: unreadable lines are left out (bad_records shows them), a missing path is empty.
    Strict: the first bad line fails the job. Blank lines count for nothing."""
    try:
        if strict:
            return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        df = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        return df.filter("_corrupt is null").drop("_corrupt")
    except Exception as e:
        if not strict and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def bad_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line, file) of the lines that can't be read under the schema."""
    return spark.read.text(path).withColumn("file", F.input_file_name()).filter((F.trim("value") != "") & F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()).select(F.col("value").alias("line"), "file")


def write_records(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """A table with its columns in order of name. The commit protocol makes the write whole or nothing; append adds to what is there."""
    w = df.select(*sorted(df.columns)).write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).format(kind).save(path)


def export_tables(sources: DataFrame, items: DataFrame, events: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """The four tables flat, nested columns as JSON text; events only of items that are exported, and none that were seeded by hand."""

    def flat(df: DataFrame) -> DataFrame:
        return df.select(*[F.to_json(c).alias(f"{c}_json") if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])

    kept = events.filter(~F.col("reviewer").eqNullSafe("manual-seed")).join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return {"sources": flat(sources), "items": flat(items), "review_events": flat(kept), "articles": flat(articles)}


def load_config(spark: SparkSession, path: str, default: dict) -> dict:
    """A small JSON document read by way of Spark, so any store will do; a missing or broken one gives the default."""
    try:
        rows = spark.read.option("wholetext", True).text(path).limit(1).collect()
        return json.loads(rows[0][0]) if rows else default
    except Exception:  # the reader's errors and those of the document are alike here
        return default
