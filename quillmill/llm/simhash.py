"""SimHash near-duplicates by anchor points: fingerprints meet at the words of a covering code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.base import pick, slabs, stored, table, through
from quillmill.llm.components import components

#: The perfect binary code of length 23: every word lies within 3 flips of exactly one code word. Its generator polynomial is a fixed value.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0xC75
LINK = 3
SEED = 42


def fingerprints(texts: list[str | None], words_a_shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """64 bits for each text: a bit is set if it is in over half of the shingles' XXH64 hashes, repeats included. No words: zero."""
    import xxhash

    h: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        line = b" ".join(text.encode().lower().split()) if text else b""
        if not line:
            continue
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        if len(gaps) < words_a_shingle:
            h.append(digest(line, seed))
            sizes[i] = 1
            continue
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)][words_a_shingle - 1 :]
        h += [digest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)]
        sizes[i] = len(ends)
    out = np.zeros(len(texts), np.uint64)
    at = np.flatnonzero(sizes)
    if len(at):
        owned = np.cumsum(sizes[at]) - sizes[at]
        data = np.array(h, np.uint64)
        counts = np.stack([np.add.reduceat((data >> np.uint64(b)).astype(np.uint8) & np.uint8(1), owned, dtype=np.int64) for b in range(64)], axis=1)
        bits = 2 * counts > sizes[at][:, None]
        out[at] = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        words ^= np.where(words >> k & 1, GENERATOR << (k - CHECKS), 0)
    return words


def cells(flips: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How the code cuts the 23-bit words into cells: the remainder of the words' upper bits, and for each remainder the ways (as bits to change) to the
    anchors of the cells that at most `flips` flips can reach, with the least flips needed, padded by ways that need more."""
    upper = _remainder(np.arange(1 << (LENGTH - CHECKS), dtype=np.int64) << CHECKS)
    patterns = np.array([sum(1 << k for k in own) for n in range(RADIUS + 1) for own in combinations(range(LENGTH), n)], np.int64)
    leader = np.empty(1 << CHECKS, np.int64)
    leader[_remainder(patterns)] = patterns
    tried = np.array([sum(1 << k for k in own) for n in range(flips + 1) for own in combinations(range(LENGTH), n)], np.int64)
    cost = np.array([n for n in range(flips + 1) for _ in combinations(range(LENGTH), n)], np.int64)
    way = tried[None, :] ^ leader[np.arange(1 << CHECKS)[:, None] ^ _remainder(tried)[None, :]]
    first = [np.unique(row, return_index=True)[1] for row in way]
    most = max(map(len, first))
    ways, costs = np.zeros((1 << CHECKS, most), np.int64), np.full((1 << CHECKS, most), flips + 1, np.int64)
    for s, own in enumerate(first):
        own = own[np.argsort(cost[own], kind="stable")]
        ways[s, : len(own)], costs[s, : len(own)] = way[s, own], cost[own]
    return upper, ways, costs, patterns


def anchors(fps: np.ndarray, parts: tuple, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, anchor) for every anchor whose cell at most `flips` flips of the fingerprint's first 46 bits can reach.

    Two words of the 23-bit code make an anchor: together a code of length 46 and covering radius 6. The other 18 bits take no part; flips
    there cost an anchor nothing.
    """
    upper, ways, costs, _ = parts
    mask = (1 << LENGTH) - 1
    halves = [(fps & np.uint64(mask)).astype(np.int64), (fps >> np.uint64(LENGTH) & np.uint64(mask)).astype(np.int64)]
    own = [upper[w >> CHECKS] ^ (w & (1 << CHECKS) - 1) for w in halves]
    rows, keys = [], []
    for i in range(ways.shape[1]):
        for j in range(ways.shape[1]):
            hit = np.flatnonzero(costs[own[0], i] + costs[own[1], j] <= flips)
            if len(hit):
                rows.append(hit)
                keys.append((halves[0][hit] ^ ways[own[0][hit], i]) | (halves[1][hit] ^ ways[own[1][hit], j]) << LENGTH)
            elif costs[:, i].min() + costs[:, j].min() > flips:
                break
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Joins what is linked, and says of each link whether it was news."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = self.up[min(a, b)] = min(a, b)
        return a != b


def cell_links(fps: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links enough to connect what is connected within one large cell: from each fingerprint reached, only those not yet reached are compared."""
    left = fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = distance(left, at) <= limit
            if near.any():
                got = left[near]
                yield np.full(len(got), at), got
                todo += got.tolist()
                left = left[~near]


def links(fps: DataFrame, limit: int = LINK, large: int = 8192) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp: long), at most `limit` bits apart, that connect all those so linked.

    For x and y within limit some z lies within limit // 2 flips of one and the rest of the other; x and y both go to the anchor in whose cell z lies. So
    it is enough to send each fingerprint to the anchors of the cells that limit - limit // 2 flips reach, all of them within the covering radius
    plus the threshold. Partitions are sorted by anchor and read as a stream: small cells compare their pairs all at once, larger ones one step
    after another (cell_links). A task passes on a link only if its earlier ones don't already connect the two, so its rows stay below its fingerprints.

    Of a cell of over `large` fingerprints no task holds more than those: its members are passed on as they are and meet again by parts of the 18 bits that take no part in the code. These are
    cut into limit + 1 parts, so two members within limit are equal in one of them.
    """
    flips = limit - limit // 2
    parts = cells(flips)
    shared = fps.sparkSession.sparkContext.broadcast(parts[:3])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(own), 2000):
                row, anchor = anchors(own[k : k + 2000], (*shared.value, None), flips)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[k : k + 2000][row].view(np.int64))], ["anchor", "fp"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.linspace(2 * LENGTH, 64, limit + 2).astype(int).tolist()
        for batch in batches:
            anchor, fp = batch.column("anchor").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False)
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = fp.view(np.uint64) >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)
                # the anchor, the number of the part and its value, mixed to one key; cells that it joins by chance only compare more
                key = (anchor.view(np.uint64) * np.uint64(64 * (limit + 1)) + np.uint64(64 * k) + part) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("fp")], ["anchor", "fp"])

    def meeting(most: int | None) -> Callable:
        """What compares a stream sorted by anchor: rows (anchor null, a, b) of links, and (anchor, a, null) of members of cells beyond `most`."""

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = Forest()

            def rows(anchor: list | np.ndarray, a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchor, a, b)], ["anchor", "a", "b"])

            def news(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
                new = [(x, y) for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True) if forest.join(x, y)]
                return rows([None] * len(new), [x for x, _ in new], [y for _, y in new])

            def compare(anchor: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
                if not len(anchor):
                    return
                starts = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
                sizes = np.diff(np.append(starts, len(anchor)))
                small = np.flatnonzero((sizes > 1) & (sizes <= 16))
                for gap in range(1, int(sizes[small].max()) if len(small) else 0):
                    at = starts[small[sizes[small] > gap]]
                    width = sizes[small[sizes[small] > gap]] - gap
                    left = np.repeat(at - (np.cumsum(width) - width), width) + np.arange(width.sum())
                    near = distance(fp[left], fp[left + gap]) <= limit
                    if near.any():
                        yield news(fp[left[near]], fp[left[near] + gap])
                for k in np.flatnonzero(sizes > 16):
                    for a, b in cell_links(np.unique(fp[starts[k] : starts[k] + sizes[k]]), limit):
                        yield news(a, b)

            def passed(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
                return rows(anchor, fp.view(np.int64), [None] * len(fp))

            held_anchor, held_fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
            for batch in batches:
                anchor, fp = batch.column("anchor").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                if over is not None and len(anchor):
                    own = int(np.searchsorted(anchor, over, "right"))
                    yield passed(anchor[:own], fp[:own])
                    over, anchor, fp = over if own == len(anchor) else None, anchor[own:], fp[own:]
                if not len(anchor):
                    continue
                held_anchor, held_fp = np.concatenate([held_anchor, anchor]), np.concatenate([held_fp, fp])
                # the last anchor may go on in the next batch
                cut = int(np.searchsorted(held_anchor, held_anchor[-1], "left"))
                done_anchor, done_fp, held_anchor, held_fp = held_anchor[:cut], held_fp[:cut], held_anchor[cut:], held_fp[cut:]
                yield from small_and_large(done_anchor, done_fp, compare, passed, most)
                if most and len(held_anchor) > most:
                    yield passed(held_anchor, held_fp)
                    over, held_anchor, held_fp = int(held_anchor[-1]), held_anchor[:0], held_fp[:0]
            yield from small_and_large(held_anchor, held_fp, compare, passed, most)

        return met

    schema = "anchor long, a long, b long"
    dealt = lambda df: df.repartition("anchor").sortWithinPartitions("anchor")
    found = stored(dealt(fps.mapInArrow(sent, "anchor long, fp long")).mapInArrow(meeting(large), schema), "links")
    out, left = found.filter("anchor is null").select("a", "b"), found.filter("anchor is not null").selectExpr("anchor", "a as fp")
    if left.limit(1).count():
        out = out.unionByName(dealt(left.mapInArrow(again, "anchor long, fp long")).mapInArrow(meeting(None), schema).select("a", "b"))
    return out


def small_and_large(anchor: np.ndarray, fp: np.ndarray, compare: Callable, passed: Callable, most: int | None) -> Iterator[pa.RecordBatch]:
    """Whole cells, sorted: those of at most `most` members are compared, larger ones passed on."""
    if most and len(anchor) > most:
        _, number, sizes = np.unique(anchor, return_inverse=True, return_counts=True)
        large = sizes[number] > most
        if large.any():
            yield passed(anchor[large], fp[large])
            anchor, fp = anchor[~large], fp[~large]
    yield from compare(anchor, fp)


def fingerprinted(docs: DataFrame, id_col: str, text_col: str, words_a_shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text").to_pylist(), words_a_shingle).view(np.int64))], ["doc_id", "fp"])

    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def components_of(per_doc: DataFrame, limit: int = LINK) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of per_doc (doc_id, fp). Copies count once: only distinct fingerprints are compared."""
    per_fp = stored(per_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = components(links(per_fp.select("fp"), limit))
    named = labels.join(per_fp, labels["node"] == per_fp["fp"]).select("node", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    linked = stored(named.join(least, "root").selectExpr("node as fp", "least"), "linked-fingerprints")
    return per_fp.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_a_shingle: int = 3, limit: int = LINK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of every document.

    Null texts and texts without a word have fingerprint zero and link like any other. Repeated rows stay, in one component. Null ids never name a
    component unless it has no other. Other columns are not read.
    """
    per_doc = stored(fingerprinted(docs, id_col, text_col, words_a_shingle), "fingerprints")
    return per_doc.join(components_of(per_doc, limit), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_a_shingle: int = 3, limit: int = LINK) -> DataFrame:
    """Of each group of near-duplicates the one row that names it, with all its columns. Of repeated rows with that id one stays, whichever;
    where all ids of a group are null, one of each fingerprint. Null texts link as fingerprint zero; an empty table stays empty.

    Ids that stand in one row are judged by id alone. Only rows whose id is null or repeated are told apart by their fingerprints, computed again for them.
    """
    per_doc = stored(fingerprinted(docs, id_col, text_col, words_a_shingle), "fingerprints")
    named = stored(per_doc.join(components_of(per_doc, limit), "fp"), "named-documents")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = stored(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("first")).filter("first"), "first-documents")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    marked = docs.toDF(*columns)
    own, text = columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)]
    # one plan at every size: small tables of ids aren't broadcast, so figures of small inputs tell those of large ones
    kept = marked.join(ids.filter("doc_id is not null and n = 1").select("doc_id").hint("shuffle_hash"), F.col(own).cast("long") == F.col("doc_id"), "left_semi")
    several = ids.filter("doc_id is null or n > 1").select("doc_id")
    if several.limit(1).count():

        def start():  # noqa: ANN202
            return lambda texts: (None, None, [pa.array(fingerprints(texts, words_a_shingle).view(np.int64))])

        rows = through(marked.join(several, F.col(own).cast("long").eqNullSafe(F.col("doc_id")), "left_semi"), text, start, "fp long")
        firsts = named.filter(first).select(F.col("doc_id").alias("first_id"), F.col("fp").alias("first_fp")).distinct()
        rows = rows.join(firsts, F.col(own).cast("long").eqNullSafe(F.col("first_id")) & (F.col("fp") == F.col("first_fp")))
        one = rows.withColumn("fp", F.when(F.col("first_id").isNull(), F.col("fp"))).dropDuplicates(["first_id", "fp"])
        kept = kept.unionByName(one.select(*columns))
    return kept.select(*[F.col(k).alias(c) for k, c in zip(columns, docs.columns, strict=True)])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents, by the contract's shingles and limit."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
