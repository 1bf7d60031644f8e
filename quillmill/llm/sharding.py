"""Sharding by histogram sort: exact counts below probes, refined until the splitters hold, then one exchange."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.base import pick, slabs, stored, table

SHARDS = 40
OVERHEAD = 16


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in slabs(batches, "text"):
        texts = [b"" if x is None else x.encode() for x in batch.column("text").to_pylist()]
        ids = batch.column("doc_id").to_pylist()
        # 40 bits of the text, then 23 of the document: copies lie side by side, and a group of any size can be cut between its documents
        high = np.array([xxhash.xxh64_intdigest(x, 7) >> 24 for x in texts], np.int64)
        low = np.array([xxhash.xxh64_intdigest(str(i), 7) >> 41 for i in ids], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) + OVERHEAD for x in texts], pa.int64()), pa.array([zlib.crc32(x) for x in texts], pa.int64()), pa.array(high << 23 | low)],
            ["doc_id", "size", "text_crc32", "key"],
        )


def _below(keyed: DataFrame, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each cut (sorted): one count per interval and task, then their sums; what reaches the driver has a row per cut."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(cuts, batch.column("key").to_numpy(zero_copy_only=False), "right")
            n += np.bincount(at, minlength=len(n))
            order = np.argsort(at, kind="stable")  # sums of integers stay exact
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(starts):
                size[at[order][starts]] += np.add.reduceat(batch.column("size").to_numpy(zero_copy_only=False)[order], starts)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(size[hit]), pa.array(n[hit])], ["at", "size", "n"])

    got = keyed.select("key", "size").mapInArrow(count, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).toArrow()
    size, n = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
    at = got["at"].to_numpy()
    size[at], n[at] = got["size"].to_numpy(), got["n"].to_numpy()
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


def splitters(keyed: DataFrame, total: int, count: int, shards: int, tolerance: float, probes: int) -> np.ndarray:
    """The keys at which shards 1.. start. Each wanted boundary keeps a bracket of two keys; every round counts `probes` keys within all open brackets at once. A bracket closes when a probe is within tolerance of the wanted bytes, or when it holds one row or its keys are adjacent: then no key can do better."""
    want = np.array([total * (i + 1) // shards for i in range(shards - 1)], dtype=object)
    low, high = [0] * len(want), [1 << 63] * len(want)
    below_low, below_high = [0] * len(want), [total] * len(want)
    rows_low, rows_high = [0] * len(want), [count] * len(want)
    near, done = int(tolerance * total / shards), [False] * len(want)
    cut = [0] * len(want)
    while not all(done):
        asked = sorted({low[i] + (high[i] - low[i]) * k // (probes + 1) for i in range(len(want)) if not done[i] for k in range(1, probes + 1)} - {0})
        below, n_below = _below(keyed, np.array([min(x, (1 << 63) - 1) for x in asked], np.int64))
        for i in range(len(want)):
            if done[i]:
                continue
            j = int(np.searchsorted(below, int(want[i]), "right"))  # the first probe with more below it than wanted
            if j and asked[j - 1] > low[i]:
                low[i], below_low[i], rows_low[i] = asked[j - 1], int(below[j - 1]), int(n_below[j - 1])
            if j < len(asked) and asked[j] < high[i]:
                high[i], below_high[i], rows_high[i] = asked[j], int(below[j]), int(n_below[j])
            lower_off, upper_off = int(want[i]) - below_low[i], below_high[i] - int(want[i])
            if min(lower_off, upper_off) <= near or rows_high[i] - rows_low[i] <= 1 or high[i] - low[i] <= 1:
                cut[i], done[i] = (low[i] if lower_off <= upper_off else high[i]), True
    return np.array([min(x, (1 << 63) - 1) for x in np.maximum.accumulate(np.array(cut, dtype=object))], np.int64)


def _runs(keyed: DataFrame, count: int, cuts: np.ndarray, steps: int, rows_a_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of runs, and the rows below each: the shards' own, and even steps of the key space. Where a run holds over twice the rows it should, as one around a
    group of copies can, it is divided and counted again, down to single keys."""
    runs = np.unique(np.concatenate([cuts, np.array([(1 << 63) * k // steps for k in range(1, steps)], dtype=object).astype(np.int64)]))
    while True:
        _, below = _below(keyed, runs)
        ends, starts = [*runs.tolist(), 1 << 63], [0, *runs.tolist()]
        held = np.diff(np.concatenate([[0], below, [count]]))
        more = {starts[i] + (ends[i] - starts[i]) * k // 64 for i in np.flatnonzero(held > 2 * rows_a_run) for k in range(1, 64)} - {0, *runs.tolist()}
        if not more:
            return runs, below
        runs = np.unique(np.concatenate([runs, np.array(sorted(more), np.int64)]))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = 0.001, probes: int = 255, rows_a_run: int = 500_000) -> DataFrame:
    """Documents dealt to shards of near equal bytes, in one order of keys (law `bytes`).

    Key: 40 bits of the text's hash, 23 of the document's. Equal texts so lie next to each other, within a shard unless a boundary
    falls into their group; a group of any size is cut there. Bytes: UTF-8 length plus 16; null texts count as empty.
    Boundaries come from histogram rounds (see splitters); finer boundaries from the last histogram divide each shard into
    runs of about rows_a_run rows, so that slots are numbered run by run with known offsets and no task sorts a whole shard.
    Repeated rows (same id, same text) have one key and stay together; their slots are dealt among them in any order.
    Empty input: no rows. Null ids are kept, with the key of the word None.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).
    """
    keyed = stored(mapped_keys(docs, id_col, text_col), "shard-keys")
    total, count = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    cuts = splitters(keyed, total, count, shards, tolerance, probes) if total else np.zeros(shards - 1, np.int64)
    runs, rows_below = _runs(keyed, count, cuts, max(shards, -(-count // rows_a_run)), rows_a_run)
    shard_of_run = np.searchsorted(cuts, np.concatenate([[0], runs]), "right")
    starts = np.concatenate([[0], rows_below])  # rows before each run
    first = np.array([starts[np.searchsorted(shard_of_run, s, "left")] for s in shard_of_run])
    base = (starts - first).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run = np.searchsorted(runs, batch.column("key").to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run), pa.array(shard_of_run[run].astype(np.int32)), pa.array(base[run])], [*batch.schema.names, "run", "shard", "base"])

    placed = keyed.mapInArrow(place, "doc_id long, size long, text_crc32 long, key long, run long, shard int, base long")
    within = F.row_number().over(Window.partitionBy("run").orderBy("key", "doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + within - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def mapped_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(_keyed, "doc_id long, size long, text_crc32 long, key long")


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_shard_documents": op7_shard_documents}
ORACLE_SQL: dict[str, str] = {}
