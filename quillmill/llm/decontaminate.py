"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, then exact weighted similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.base import pick, slabs, table, through
from quillmill.llm.substrings import BASES, Words, windows

SHINGLE = 5
SIMILAR = 0.8
#: With equal weights, windows of similarity 0.8 differ from the item in about 10 of 64 bits. Those farther off, as unequal weights bring about, reaching() finds.
RADIUS = 15
BLOCKS = 4
#: Items that look up their neighbours at a time, and windows fingerprinted at a time; they bound the arrays.
ITEMS_AT_ONCE, WINDOWS_AT_ONCE = 1024, 20_000
#: Benchmark text that the tasks get at a time; a larger benchmark goes in several blocks of items.
BLOCK_BYTES = 16 << 20
_TOKEN = re.compile(r"\w+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def hashes(words: list[str], seen: Words) -> np.ndarray:
    return np.array(list(map(seen.__getitem__, words)), _U)


class Index:
    """The items of a block by their different texts: shingles, weights, fingerprints. A shingle weighs 1 / (different item texts of the whole benchmark that hold it), one
    that no item holds weighs 1. If the block isn't the whole benchmark, shared gives the shingles held by several texts, sorted, and their weights.

    Built once, on the driver. state() is what the tasks get: arrays, whose size is that of the block."""

    def __init__(self, ids: list[int], texts: list[str | None], shared: tuple[np.ndarray, np.ndarray] | None = None):
        seen = Words()
        self.ids, self.items, self.shared = [], [], shared
        number: dict[bytes, int] = {}
        for i, text in zip(ids, texts, strict=True):
            h = hashes(words_of(text), seen)
            if not len(h):
                continue
            key = h.tobytes()
            if key not in number:
                number[key] = len(self.items)
                self.ids.append([])
                width = min(SHINGLE, len(h))
                self.items.append((len(h), width, windows(h, width, BASES[0])))
            self.ids[number[key]].append(i)
        self.known, held = np.unique(np.concatenate([np.zeros(0, _U), *(np.unique(x[2]) for x in self.items)]), return_counts=True)
        self.weights = 1 / held if shared is None else self.elsewhere(self.known)
        self.lengths = np.array([x[0] for x in self.items], np.int64)
        self.widths = sorted({x[1] for x in self.items})
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.known >> _U(44)).astype(np.int64)] = True
        self.prints = np.array([simhash(s, self.weight(s), np.array([0]), np.array([len(s)]))[0] for _, _, s in self.items], _U)
        self.totals = np.array([self.weight(s).sum() for _, _, s in self.items])
        self.masks = np.array([sum(1 << k for k in own) for n in range(RADIUS // BLOCKS + 1) for own in combinations(range(64 // BLOCKS), n)], np.int64)
        parts = [self.rarest(s) for _, _, s in self.items]
        shingle, item = np.concatenate([np.zeros(0, np.int64), *parts]), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        order = np.argsort(shingle, kind="stable")
        self.asked, self.ends = item[order], np.cumsum(np.bincount(shingle, minlength=len(self.known)))

    def state(self) -> dict:
        return self.__dict__

    @classmethod
    def of(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def rarest(self, shingles: np.ndarray) -> np.ndarray:
        """The numbers of an item's rarest shingles, of which a window of similarity SIMILAR, weighted or plain, has one at least: more than the share it may lack, by number and by
        weight. So a shingle of many items is asked for only by those that have hardly any others."""
        own, n = np.unique(self.at(shingles), return_counts=True)
        order = np.lexsort((own, -self.weights[own]))
        own, n = own[order], n[order]
        w, lack = np.cumsum(n * self.weights[own]), 1 - SIMILAR + 1e-6
        return own[: 1 + max(int(np.searchsorted(np.cumsum(n), lack * len(shingles), "right")), int(np.searchsorted(w, lack * w[-1], "right")))]

    def at(self, shingles: np.ndarray) -> np.ndarray:
        """The number of each shingle among the known ones, or -1."""
        out = np.full(len(shingles), -1, np.int64)
        maybe = np.flatnonzero(self.bitmap[(shingles >> _U(44)).astype(np.int64)])
        if len(maybe):
            k = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
            good = self.known[k] == shingles[maybe]
            out[maybe[good]] = k[good]
        return out

    def elsewhere(self, shingles: np.ndarray) -> np.ndarray:
        """Weights over the whole benchmark: of a shingle that isn't shared, held or not, it is 1."""
        if self.shared is None or not len(self.shared[0]):
            return np.ones(len(shingles))
        k = np.minimum(np.searchsorted(self.shared[0], shingles), len(self.shared[0]) - 1)
        return np.where(self.shared[0][k] == shingles, self.shared[1][k], 1.0)

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        k = self.at(shingles)
        return np.where(k >= 0, self.weights[k], self.elsewhere(shingles)) if len(self.weights) else self.elsewhere(shingles)


def simhash(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each run [start, end) of shingles: the sign of the weighted sum at each bit, by differences of running sums."""
    signs = ((shingles[:, None] >> np.arange(64, dtype=_U)) & _U(1)).astype(np.float64) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(signs * weights[:, None], axis=0)])
    return ((sums[ends] - sums[starts] > 1e-9).astype(_U) << np.arange(64, dtype=_U)).sum(axis=1, dtype=_U)


def within(prints: np.ndarray, items: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (print, item) at most RADIUS bits apart. Of BLOCKS blocks of bits one at least differs in no more than RADIUS // BLOCKS places; so for each
    block the windows are indexed by its value, every item looks up all values so near to its own, and what it meets is compared in full."""
    bits = 64 // BLOCKS
    found = [np.zeros(0, np.int64)]
    for b in range(BLOCKS):
        value = (prints >> _U(b * bits) & _U((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        ends = np.cumsum(np.bincount(value, minlength=1 << bits))
        for part in range(0, len(items), ITEMS_AT_ONCE):
            own = items[part : part + ITEMS_AT_ONCE]
            near = (own >> _U(b * bits) & _U((1 << bits) - 1)).astype(np.int64)[:, None] ^ masks[None, :]
            size = ends[near] - np.where(near > 0, ends[near - 1], 0)
            item, k = np.nonzero(size)
            n = size[item, k]
            first = ends[near[item, k]] - n
            # so many at once that the arrays stay bounded, whatever windows share a value
            cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 1 << 20), "left").tolist() + [len(n)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                m = n[lo:hi]
                rows = order[np.repeat(first[lo:hi] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                whose = np.repeat(item[lo:hi], m)
                good = np.bitwise_count(prints[rows] ^ own[whose]) <= RADIUS
                found.append(rows[good] * len(items) + whose[good] + part)
    both = np.unique(np.concatenate(found))
    return both // max(1, len(items)), both % max(1, len(items))


def reaching(size: np.ndarray, common: np.ndarray, weights: np.ndarray, item: np.ndarray, item_weight: float) -> np.ndarray:
    """Which of the windows that start at 0, 1, .. of a stretch of shingles (size: shingles of each) may have similarity SIMILAR to an item, weighted or plain: at best
    all shingles of the window that the item holds (common) are common to both. No window that reaches it is left out."""
    start = np.arange(len(size))
    n, heavy, every = (np.append(0.0, np.cumsum(x)) for x in (common, common * weights, weights))
    n, heavy, every = (x[start + size] - x[start] for x in (n, heavy, every))
    plain = (1 + SIMILAR) * n >= SIMILAR * (size + len(item)) - 1e-6
    return np.flatnonzero(plain | ((1 + SIMILAR) * heavy >= SIMILAR * (every + item_weight) - 1e-6))


def joined(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (first to last) as few that don't touch, key by key."""
    order = np.lexsort((first, key))
    key, first, last = key[order], first[order], last[order]
    step = int(last.max()) + 2 if len(last) else 1
    far = np.maximum.accumulate(last + key * step)
    new = np.flatnonzero(np.append(True, first[1:] + key[1:] * step > far[:-1] + 1)) if len(key) else np.zeros(0, np.int64)
    return key[new], first[new], far[np.append(new[1:] - 1, len(key) - 1).astype(np.int64)] - key[new] * step if len(key) else last


def similarity(a: np.ndarray, b: np.ndarray, index: Index) -> tuple[float, float]:
    """Jaccard similarity of two bags of shingles, weighted and plain."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    every = list(x | y)
    low, high = (np.array([f(x[s], y[s]) for s in every]) for f in (min, max))
    w = index.weight(np.array(every, _U))
    return float((w * low).sum() / (w * high).sum()), float(low.sum() / high.sum())


def leaks_of(words: list[np.ndarray], index: Index) -> list[tuple[int, int, float, int, int]]:
    """(document, item text, best similarity, its window's first word, number of windows) of all that reach SIMILAR.

    A window can reach it only with one of the item's rarest shingles (Index.rarest), so windows are laid, in the item's length, wherever they hold one, and nowhere else; nothing is lost by
    that, and a shingle of many items costs no more than one of few. A document shorter than the item is one window. Fingerprints within RADIUS by Hamming blocks and, as weights may
    carry a window beyond it, all windows whose common shingles may suffice (reaching) come to the exact test. Where no window reaches SIMILAR by
    weight, one that reaches it by plain similarity does too: else one foreign shingle would outweigh all that an item shares with others.
    """
    out: dict[tuple[int, int], list] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate([np.zeros(0, _U), *words])
    offset = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(words)), sizes)
    for width in index.widths:
        if len(flat) < width:
            continue
        shingles = windows(flat, width, BASES[0])
        k = np.where(doc[: len(shingles)] == doc[width - 1 :], index.at(shingles), -1)
        hit = np.flatnonzero(k >= 0)
        n_asked = index.ends[k[hit]] - np.where(k[hit] > 0, index.ends[k[hit] - 1], 0)
        hit, n_asked = hit[n_asked > 0], n_asked[n_asked > 0]
        item = index.asked[np.repeat(index.ends[k[hit]] - n_asked - (np.cumsum(n_asked) - n_asked), n_asked) + np.arange(n_asked.sum())]
        p = np.repeat(hit, n_asked)
        same = np.array([index.items[i][1] == width for i in item.tolist()], bool)
        item, p = item[same], p[same]
        if not len(p):
            continue
        n, begin = index.lengths[item], offset[doc[p]]
        last = begin + np.maximum(0, sizes[doc[p]] - n)
        item, first, last = joined(item, np.maximum(begin, np.minimum(p - n + width, last)), np.minimum(p, last))
        for n in np.unique(index.lengths[item]).tolist():
            own = np.flatnonzero(index.lengths[item] == n)
            _, lo, hi = joined(np.zeros(len(own), np.int64), first[own], last[own])
            start = np.repeat(lo - (np.cumsum(hi - lo + 1) - (hi - lo + 1)), hi - lo + 1) + np.arange((hi - lo + 1).sum())
            count = np.minimum(n, sizes[doc[start]]) - width + 1  # shingles of the window
            pairs = [np.zeros(0, np.int64)]
            items = np.flatnonzero(index.lengths == n)
            for part in range(0, len(start), WINDOWS_AT_ONCE):
                at, size = start[part : part + WINDOWS_AT_ONCE], count[part : part + WINDOWS_AT_ONCE]
                # only the shingles under the windows are summed
                _, lo, hi = joined(np.zeros(len(at), np.int64), at, at + size - 1)
                under = np.repeat(lo - (np.cumsum(hi - lo + 1) - (hi - lo + 1)), hi - lo + 1) + np.arange((hi - lo + 1).sum())
                place = np.searchsorted(under, at)
                w, i = within(simhash(shingles[under], index.weight(shingles[under]), place, place + size), index.prints[items], index.masks)
                pairs.append((w + part) * len(index.items) + items[i])
            for i, a, b in zip(item[own].tolist(), first[own].tolist(), last[own].tolist(), strict=True):
                size = count[np.searchsorted(start, a) : np.searchsorted(start, b) + 1]
                stretch = shingles[a : b + int(size[-1])]
                near = reaching(size, np.isin(stretch, index.items[i][2]), index.weight(stretch), index.items[i][2], index.totals[i])
                pairs.append((np.searchsorted(start, a) + near) * len(index.items) + i)
            for w, i in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(pairs)), len(index.items))), strict=True):
                for kind, s in enumerate(similarity(shingles[start[w] : start[w] + count[w]], index.items[i][2], index)):
                    if s >= SIMILAR - 1e-9:
                        d = int(doc[start[w]])
                        got = out.setdefault((d, i), [[0.0, 0, 0], [0.0, 0, 0]])[kind]
                        if s > got[0] + 1e-12:
                            got[:2] = [s, int(start[w] - offset[d])]
                        got[2] += 1
    return [(d, i, *(weighted if weighted[2] else plain)) for (d, i), (weighted, plain) in sorted(out.items())]


def _shared(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several different texts of the whole benchmark hold, sorted, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = Words()
        for batch in slabs(batches, "text", 2 << 20):
            own, texts = [np.zeros(0, _U)], [np.zeros(0, _U)]
            for text in batch.column("text").to_pylist():
                h = hashes(words_of(text), seen)
                if len(h):
                    own.append(np.unique(windows(h, min(SHINGLE, len(h)), BASES[0])))
                    texts.append(np.full(len(own[-1]), xxhash.xxh3_64_intdigest(h.tobytes()), _U))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (own, texts)], ["shingle", "text"])

    held = items.select("text").mapInArrow(run, "shingle long, text long").distinct().groupBy("shingle").count().filter("count > 1").toArrow()
    shingles, count = held.column("shingle").to_numpy().view(_U), held.column("count").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], 1 / count[order]


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> Iterator[tuple[list[int], list[str], tuple[np.ndarray, np.ndarray] | None]]:
    """The benchmark's ids and texts, at most about BLOCK_BYTES of text at a time, and the weights of shared shingles if there are several blocks; one empty block if there are no items."""
    items = pick(benchmark, item_id=item_id_col, text=item_text_col).selectExpr("cast(item_id as long) item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    shared = None if blocks == 1 else _shared(items)
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        got = own.orderBy("item_id", "text").toArrow()
        yield got.column("item_id").to_pylist(), got.column("text").to_pylist(), shared


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which leaks() finds nothing. A filter: no rows meet, so null and repeated ids don't matter. Null texts stay."""

    def flag(shared: Broadcast) -> Callable[[], Callable]:
        def start() -> Callable:
            index, seen = Index.of(shared.value), Words()

            def clean(texts: list[str | None]) -> tuple:
                found = {d for d, *_ in leaks_of([hashes(words_of(x), seen) for x in texts], index)} if index.ids else set()
                return [d not in found for d in range(len(texts))], None, []

            return clean

        return start

    for own in _blocks(benchmark, item_id_col, item_text_col):
        docs = through(docs, text_col, flag(docs.sparkSession.sparkContext.broadcast(Index(*own).state())))
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_windows of every document and benchmark item where a window of the item's length has a weighted
    similarity of 0.8 or more of 5-word shingles (of the whole item if it is shorter).

    Words are runs of letters and digits in lower case. The benchmark is held by each task, in blocks of BLOCK_BYTES of its text (one block here), with the weights of
    shingles that several items of the whole benchmark share, 16 bytes each; so results don't depend on the blocks. The documents are scanned once for each block and never moved. Null and empty items and texts match nothing. Rows with equal ids each give their own rows; null ids stay null.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    out = None
    for own in _blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Index(*own).state())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index, seen = Index.of(shared.value), Words()
            for batch in slabs(batches, "text", 2 << 20):
                found = leaks_of([hashes(words_of(x), seen) for x in batch.column("text").to_pylist()], index) if index.ids else []
                found = [(d, own, *x) for d, i, *x in found for own in index.ids[i]]
                ids = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d, *_ in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64())],
                    ["doc_id", "item_id", "similarity", "start_word", "n_windows"],
                )

        part = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_windows long")
        out = part if out is None else out.unionByName(part)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leaks() of all documents and the whole benchmark."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 6))


QUERIES = {"op5_decontaminate": op5_decontaminate}
#: The exact test alone, for items of five words or more; so it also shows whether fingerprints lose anything.
ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": r"""
        WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
        d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
        bs AS (SELECT item_id, len(w) AS n, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b)),
        ds AS (SELECT doc_id, len(w) AS m, i AS p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
        weight AS (SELECT s, 1.0::DOUBLE / count(DISTINCT item_id) AS v FROM bs GROUP BY s),
        bag AS (SELECT item_id, n, s, count(*) AS k FROM bs GROUP BY ALL),
        laid AS (
            SELECT DISTINCT doc_id, item_id, n, m, unnest(range(greatest(1, least(p - n + 5, greatest(1, m - n + 1))), least(p, greatest(1, m - n + 1)) + 1)) AS start FROM ds JOIN (SELECT DISTINCT item_id, n, s FROM bs) USING (s)),
        own AS (SELECT l.doc_id, l.item_id, l.start, ds.s, count(*) AS k FROM laid l JOIN ds ON ds.doc_id = l.doc_id AND ds.p BETWEEN l.start AND l.start + least(l.n, l.m) - 5 GROUP BY ALL),
        sums AS (
            SELECT o.doc_id, o.item_id, o.start, sum(o.k * coalesce(v, 1)) AS mine, sum(least(o.k, coalesce(bag.k, 0)) * coalesce(v, 1)) AS low
            FROM own o LEFT JOIN weight USING (s) LEFT JOIN bag ON bag.item_id = o.item_id AND bag.s = o.s GROUP BY ALL),
        whole AS (SELECT item_id, sum(k * v) AS theirs FROM bag JOIN weight USING (s) GROUP BY item_id),
        scored AS (SELECT doc_id, item_id, start, low / (mine + theirs - low) AS similarity FROM sums JOIN whole USING (item_id)),
        good AS (SELECT * FROM scored WHERE similarity >= 0.8 - 1e-9)
        SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, (arg_min(start, (-round(similarity, 10), start)) - 1)::BIGINT AS start_word, count(*) AS n_windows FROM good GROUP BY doc_id, item_id
    """
}
