"""Runs of words that repeat with a period, found as extended Lyndon roots; longest common extensions come from suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.base import pick, slabs, table

#: Words of a run at least, besides twice its period.
LEAST = 12
WORDS = r"[\x20\x09-\x0D]+"
_U = np.uint64
#: An odd multiplier of the hash that looks for repeated stretches; two stretches of one hash only cost time.
MIX = 0x9E3779B97F4A7C15
BUCKET_BITS = 22


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class SuffixTree:
    """Ukkonen's tree of a list of integers from 0 on, ended by a symbol of its own that is less than all others.

    order: suffixes from least to greatest; rank: the place of each in it. Of an Euler tour of the tree, shared keeps the depth of the highest node between any two
    leaves that follow one another: the words they share. Its sparse table answers every longest common extension by two look-ups.
    """

    def __init__(self, symbols: np.ndarray):
        s = [*(symbols + 1).tolist(), 0]
        order, shared = self._leaves(s, self._build(s))
        self.order, self.rank = np.array(order), np.empty(len(order), np.int64)
        self.rank[self.order] = np.arange(len(order))
        levels = [np.array(shared, np.int32)]
        while 2 << len(levels) - 1 <= len(shared):
            half, last = 1 << len(levels) - 1, levels[-1]
            levels.append(np.minimum(last[: len(last) - half], last[half:]))
        self._starts = np.cumsum([0, *(len(x) for x in levels)])
        self._least = np.concatenate(levels)

    @staticmethod
    def _build(s: list[int]) -> tuple[dict[int, int], list[int], list[int]]:
        """Edges by node * symbols + first symbol, the suffix that each node is the leaf of (or -1), and the depth of inner nodes."""
        size, n, whole = max(s) + 1, len(s), len(s) + 1
        start, end, link, leaf, depth = [0], [0], [0], [-1], [0]
        child: dict[int, int] = {}
        node = edge = length = left = 0
        for i, c in enumerate(s):
            left, fresh = left + 1, 0
            while left:
                if not length:
                    edge = i
                key = node * size + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i), end.append(whole), link.append(0), leaf.append(i - left + 1), depth.append(0)
                    if fresh:
                        link[fresh], fresh = node, 0
                else:
                    at = start[below]
                    size_of_edge = end[below] - at
                    if length >= size_of_edge and leaf[below] < 0:
                        node, edge, length = below, edge + size_of_edge, length - size_of_edge
                        continue
                    if s[at + length] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = len(start)
                    child[key] = split
                    start.append(at), end.append(at + length), link.append(0), leaf.append(-1), depth.append(depth[node] + length)
                    child[split * size + c] = split + 1
                    start.append(i), end.append(whole), link.append(0), leaf.append(i - left + 1), depth.append(0)
                    start[below] = at + length
                    child[split * size + s[at + length]] = below
                    if fresh:
                        link[fresh] = split
                    fresh = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - left + 1
        return child, leaf, depth

    @staticmethod
    def _leaves(s: list[int], tree: tuple[dict[int, int], list[int], list[int]]) -> tuple[list[int], list[int]]:
        """The suffixes in order, and what each shares with the one before it."""
        child, leaf, depth = tree
        edges = np.fromiter(child.keys(), np.int64, len(child))
        sort = np.argsort(edges)
        to = np.fromiter(child.values(), np.int64, len(child))[sort].tolist()
        bounds = np.searchsorted(edges[sort], np.arange(len(leaf) + 1) * (max(s) + 1)).tolist()
        order, shared, stack = [], [], [(0, 0)]
        while stack:
            node, above = stack.pop()
            if leaf[node] >= 0:
                order.append(leaf[node])
                shared.append(above)
                continue
            first, d = bounds[node], depth[node]
            stack.extend([(x, d) for x in to[bounds[node + 1] - 1 : first : -1]])
            stack.append((to[first], above))
        return order, shared

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes from i and from j share, for each two different ones."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        at = self._starts[level]
        return np.minimum(self._least[at + low], self._least[at + high + 1 - (1 << level.astype(np.int64))]).astype(np.int64)


def _next(rank: list[int], less: bool) -> np.ndarray:
    """For each place the next one of lesser (or greater) rank; the last place where there is none."""
    out, stack, last = [len(rank) - 1] * len(rank), [], len(rank) - 1
    for i in range(last + 1):
        r = rank[i]
        while stack and (rank[stack[-1]] > r) == less:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def runs_of(symbols: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a list of integers: start, length, period, by start and period.

    Every run's period is the length of a Lyndon word that is the longest one to begin where it stands, by one order of the symbols or by its reverse; such words end
    where the next suffix that is less begins. So 2 n candidates, each extended to both sides as far as symbols a period apart are equal, hold all runs.
    """
    n = len(symbols)
    if n < least:
        return []
    forward = SuffixTree(symbols)
    rank = forward.rank.tolist()
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([_next(rank, True)[:n], _next(rank, False)[:n]])
    i, j = i[j < n], j[j < n]
    end = j + forward.common(i, j)
    del forward, rank
    begin = i.copy()
    inner = np.flatnonzero(i > 0)
    if len(inner):
        begin[inner] -= SuffixTree(symbols[::-1]).common(n - i[inner], n - j[inner])
    found = np.flatnonzero(end - begin >= np.maximum(least, 2 * (j - i)))
    return sorted({(b, e - b, p) for b, e, p in zip(begin[found].tolist(), end[found].tolist(), (j - i)[found].tolist(), strict=True)})


def _suspects(number: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Which words may be in a run: those in stretches that hold some words twice, of which every word does.

    Of a run of length L and period q the first L - q words are its last ones too, and L - q is half of `least` words or more. So all its words are in
    sequences of that many words that occur twice within it.
    """
    size = max(1, least // 2)
    at, group = np.arange(len(number)), doc
    while True:
        before = len(at)
        whole = np.flatnonzero(group[size - 1 :] == group[: len(group) - size + 1]) if len(group) >= size else np.zeros(0, np.int64)
        key = group[whole].astype(_U)
        for k in range(size):
            key = (key ^ (key >> _U(29))) * _U(MIX) + number[at[whole + k]].astype(_U)
        key = (key ^ (key >> _U(32))) * _U(MIX)
        bucket = (key >> _U(64 - BUCKET_BITS)).astype(np.int64)
        likely = np.flatnonzero(np.bincount(bucket, minlength=1 << BUCKET_BITS)[bucket] > 1) if len(key) > 1 << 12 else np.arange(len(key))
        order = likely[np.argsort(key[likely], kind="stable")]
        equal = key[order][1:] == key[order][:-1]
        twice = whole[order[np.append(equal, False) | np.append(False, equal)]] if len(order) else whole[:0]
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + size, -1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        # stretches end where words or documents do
        cut = np.append(True, (np.diff(at[kept]) != 1) | (np.diff(group[kept]) != 0)) if len(kept) else np.zeros(0, bool)
        piece = np.cumsum(cut) - 1
        long = np.bincount(piece)[piece] >= least if len(kept) else np.zeros(0, bool)
        at, group = at[kept[long]], piece[long]
        if len(at) > 0.9 * before or not len(at):
            return at


def _document_runs(number: np.ndarray, at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs of one document, of whose words only those at may be in one. Symbols of their own stand between the stretches, so no run crosses from one to the next."""
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    own = np.unique(number[at], return_inverse=True)[1]
    seps = own.max() + 1 + np.arange(len(cuts))
    symbols = np.insert(own, cuts, seps)
    place = np.insert(at, cuts, -1)
    return [(int(place[s]), length, p) for s, length, p in runs_of(symbols, least)]


def slab_runs(words: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    numbers, sizes = _Numbers(), np.array([len(w) for w in words], np.int64)
    number = np.fromiter((numbers[w] for own in words for w in own), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    at = _suspects(number, np.repeat(np.arange(len(words)), sizes), least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    bounds = np.searchsorted(at, [*first.tolist(), int(sizes.sum())])
    for k in np.flatnonzero(np.diff(bounds)):
        own = at[bounds[k] : bounds[k + 1]] - first[k]
        out[k] = _document_runs(number[first[k] : first[k] + sizes[k]], own, least)
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by spaces."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The runs of every whole text, and the text without their repeats: doc_id, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of words in which words one period apart are equal, of `least` words and two periods at least, that no neighbour extends; period is its smallest one.
    collapsed joins by one space the words that no run holds after its first period. Words are what space and the controls 09 to 0D part. Null and empty texts have no runs
    and collapse to the empty text; repeated rows and null ids are kept, a row each; of an empty table nothing comes. Other columns, whatever their names, are not read.
    One pass, no shuffle; a task holds a slab of texts, and the trees of one document's suspect words, about 500 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text", 2 << 20):
            words = [(x or b"").split() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            found = slab_runs(words, least)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found]
            texts = [collapsed(w, own) for w, own in zip(words, found, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    plain = pick(docs, doc_id=id_col, text=text_col)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by the hash of its id repeats a stretch of itself from some word on (the query's contract); such texts have single spaces."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WORDS), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = pick(docs, doc_id="doc_id", text="text").withColumn("h", h)
    told = marked.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    cut = told.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    text = F.expr("array_join(concat(slice(words, 1, int(a)), transform(sequence(0, n - 1 - a), i -> words[int(a + i % p)])), ' ')")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its runs' number and digest, the longest run (ties: least start, then period), and the digest of what is left. Null ids count as not planted."""
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as back, -r.period as less)))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.less")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.less").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periods": op13_periods}
#: SQL has no way to find runs but to compare each word with all that follow; tests/llm/test_periods.py holds the query against that.
ORACLE_SQL: dict[str, str] = {}
