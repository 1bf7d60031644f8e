"""Helpers shared by the operators: reading, slabs of texts, shared working tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.batches import slabs
from quillmill.plans.working import forget, shared_dir, stored

__all__ = ["SPACE", "beside", "forget", "pick", "sha256_hex", "shared_dir", "slabs", "stored", "table", "through"]

#: The separators of words: space and the ASCII controls 09 to 0D. bytes.split() uses exactly these.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns needed, under the operator's own names; so extra columns, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in columns.items()])


def through(docs: DataFrame, text_col: str, start: Callable[[], Callable], added: str = "", slab_bytes: int = 1 << 20) -> DataFrame:
    """docs, with all their columns, in one pass of Arrow slabs. start is called once in each task and gives a function from a slab's texts to three things: which
    rows stay (None: all), the new texts (None: as they are), and a list of arrays for the columns in added. Columns of docs named in added give way to those.

    All that a task holds is a batch and what a slab of it needs, and one Python worker does all three. Inside, columns go by number, so names can't clash.
    """
    text = [x.lower() for x in docs.columns].index(text_col.lower())
    names = [f"c{i}" for i in range(len(docs.columns))]
    new = T._parse_datatype_string(added) if added else T.StructType()
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in slabs(batches, names[text], slab_bytes):
            stay, texts, arrays = work(batch.column(text).to_pylist())
            columns = list(batch.columns)
            if texts is not None:
                columns[text] = pa.array(texts, pa.string())
            out = pa.RecordBatch.from_arrays([*columns, *arrays], [*names, *(f"n{i}" for i in range(len(arrays)))])
            yield out if stay is None else out.filter(pa.array(stay, pa.bool_()))

    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields))])
    taken = {x.lower() for x in new.names}
    own = [F.col(k).alias(c) for k, c in zip(names, docs.columns, strict=True) if c.lower() not in taken]
    return plain.mapInArrow(run, schema).select(*own, *[F.col(f"n{i}").alias(c) for i, c in enumerate(new.names)])


def beside(rows: DataFrame, key: str, value: Column, name: str, share: int = 1000) -> DataFrame:
    """rows, with the aggregate `value` of all rows of their key beside each; null keys are one group. rows is read several times, so it should be a stored table.

    Keys that hold over 1 / share of all rows are fewer than share, so they are broadcast and their rows stay where they are; only the others' rows move, and none of
    those groups is large.
    """
    groups = stored(rows.groupBy(key).agg(value.alias(name), F.count(F.lit(1)).alias("group_rows")).withColumnRenamed(key, "group_key"), "groups")
    many = (groups.agg(F.sum("group_rows")).first()[0] or 0) / share
    same = F.col(key).eqNullSafe(F.col("group_key"))
    large, small = (groups.filter(x).drop("group_rows") for x in (F.col("group_rows") > many, F.col("group_rows") <= many))
    near = rows.join(F.broadcast(large), same)
    far = rows.join(F.broadcast(large.select("group_key")), same, "left_anti").join(small, same)
    return near.unionByName(far).drop("group_key")
