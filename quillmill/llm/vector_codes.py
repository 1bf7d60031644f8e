"""Vectors as short codes: a codebook for each part of a vector, fitted by Lloyd's rounds over cover trees that each task builds once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.base import beside, forget, pick, stored, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components are held within this bound, so that squared distances of parts of up to 512 components fit in 64 bits; it stands for numbers of 8192 and more.
BOUND = 1 << 25
SLAB_ROWS = 4096
#: Points for each centre of a tree; a leaf has about as many.
LEAF = 16


class CoverTree:
    """A cover tree over integer points.

    Centres are taken farthest first, so those of level l (at least 2**l from all before) are 2**l apart and any point is within 2**(l+1) of one of them; a centre's parent is the
    nearest one of a level above its own. A node is a centre with its descendants of its level or less; its first child is itself a level of children further
    down, then come those children. Points lie in the order of a walk, so a node is a stretch of them, its sum is a difference of cumulative sums, and radius is
    the largest distance from the centre to any of them.
    """

    def __init__(self, order: np.ndarray, points: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.order, self.points, self.radius = order, points, radius
        self.begin, self.end, self.centre, self.first, self.kids = nodes.T
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0, dtype=np.int64)])

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        n = len(points)
        centres, apart, nearest, away = [0], [0], np.zeros(n, np.int64), squares(points, points[0])
        for _ in range(n // leaf):
            far = int(np.argmax(away))
            if not away[far]:
                break
            d = squares(points, points[far])
            closer = d < away
            nearest[closer], away = len(centres), np.where(closer, d, away)
            # ties apart, a centre is no farther from the others than the one before it was
            apart.append(int(d[centres].min()))
            centres.append(far)
        level = [1 << 10, *((d.bit_length() - 1) // 2 for d in apart[1:])]
        at = points[centres]
        below: list[list[int]] = [[] for _ in centres]
        for j in range(1, len(centres)):
            above = int(np.searchsorted(-np.array(level[:j]), -level[j], "left"))  # levels fall, so those above are a prefix
            below[int(np.argmin(squares(at[:above], at[j])))].append(j)
        own = np.split(np.argsort(nearest, kind="stable"), np.cumsum(np.bincount(nearest, minlength=len(centres)))[:-1])
        # the nodes, parents first; those of one parent stand together
        chain = [[[x for x in kids if level[x] == lv] for lv in sorted({level[x] for x in kids}, reverse=True)] for kids in below]
        todo, first, count = [(0, 0)], [], []
        for j, step in todo:
            kids = [(j, step + 1), *((x, 0) for x in chain[j][step])] if step < len(chain[j]) else []
            first.append(len(todo))
            count.append(len(kids))
            todo.extend(kids)
        size, begin = [0] * len(todo), [0] * len(todo)
        for x in range(len(todo) - 1, -1, -1):
            size[x] = sum(size[first[x] : first[x] + count[x]]) if count[x] else len(own[todo[x][0]])
        for x in range(len(todo)):
            start = begin[x]
            for y in range(first[x], first[x] + count[x]):
                begin[y] = start
                start += size[y]
        order = np.empty(n, np.int64)
        for x, (j, _) in enumerate(todo):
            if not count[x]:
                order[begin[x] : begin[x] + size[x]] = own[j]
        laid = points[order]
        where = np.empty(n, np.int64)
        where[order] = np.arange(n)
        radius = np.array([np.sqrt(squares(laid[b : b + m], at[j]).max()) for (j, _), b, m in zip(todo, begin, size, strict=True)])
        nodes = np.array([[b, b + m, where[centres[j]], f, c] for (j, _), b, m, f, c in zip(todo, begin, size, first, count, strict=True)], np.int64)
        return cls(order, laid, nodes, radius)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of points (begin, end) and the nearest entry of the book for all points of each; ties go to the lower entry.

        A node whose centre is nearer to one entry than to any other by more than twice the radius belongs to it as a whole. Others descend; points of a leaf are compared one by one.
        """
        node, out, single = np.zeros(1, np.int64), [], []
        while len(node):
            d = squares(self.points[self.centre[node], None, :], book[None])
            best = np.argmin(d, axis=1)
            root = np.sqrt(d.astype(np.float64))
            mine = root[np.arange(len(node)), best]
            root[np.arange(len(node)), best] = np.inf
            # a little more than twice the radius, for the rounding of roots
            sure = (root.min(axis=1) - mine > 2 * self.radius[node] * (1 + 1e-9) + 1e-9 * mine + 1e-6) | (self.radius[node] == 0)
            out.append((self.begin[node[sure]], self.end[node[sure]], best[sure]))
            node = node[~sure]
            single.append(node[self.kids[node] == 0])
            node = _stretches(self.first[node], self.kids[node])
        leaves = np.concatenate(single)
        at = _stretches(self.begin[leaves], self.end[leaves] - self.begin[leaves])
        out.append((at, at + 1, np.argmin(squares(self.points[at, None, :], book[None]), axis=1)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry of the book the number of its points and their sum."""
        begin, end, entry = self.assign(book)
        count, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        np.add.at(count, entry, end - begin)
        np.add.at(sums, entry, self.sums[end] - self.sums[begin])
        return count, sums

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point, in the order given to build, its entry and squared distance."""
        begin, end, entry = self.assign(book)
        code = np.empty(len(self.points), np.int64)
        code[self.order[_stretches(begin, end - begin)]] = np.repeat(entry, end - begin)
        error = np.empty(len(self.points), np.int64)
        error[self.order] = squares(self.points, book[code[self.order]])
        return code, error


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b
    return (d * d).sum(axis=-1)


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _whole(vectors: pa.ListArray, size: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -BOUND, BOUND).astype(np.int64).reshape(len(vectors), size)


def _planted(vectors: DataFrame, bounds: list[int], slab_rows: int) -> DataFrame:
    """A row for each slab of vectors: its ids, its labels, and a tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slab_rows):
                slab = batch.slice(at, slab_rows)
                whole, trees = _whole(slab.column("vector"), bounds[-1]), []
                for low, high in zip(bounds, bounds[1:], strict=False):
                    t = CoverTree.build(whole[:, low:high])
                    nodes = np.stack([t.begin, t.end, t.centre, t.first, t.kids], axis=1)
                    trees.append({k: x.tobytes() for k, x in zip(TREE, (t.order.astype(np.int32), t.points.astype(np.int32), nodes.astype(np.int32), t.radius), strict=True)})
                ends = pa.array([0, slab.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, slab.column(c)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.struct([(k, pa.binary()) for k in TREE])))], ["ids", "labels", "trees"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees array<struct<{', '.join(f'{k}: binary' for k in TREE)}>>")


TREE = ("at", "points", "nodes", "radius")


def _trees(row: list[dict[str, bytes]], bounds: list[int]) -> list[CoverTree]:
    out = []
    for t, low, high in zip(row, bounds, bounds[1:], strict=False):
        order, points, nodes = (np.frombuffer(t[k], np.int32).astype(np.int64) for k in TREE[:3])
        out.append(CoverTree(order, points.reshape(len(order), high - low), nodes.reshape(-1, 5), np.frombuffer(t["radius"])))
    return out


def _totals(planted: DataFrame, bounds: list[int], books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts and sums of every entry of every part: first within a task, then over all; the driver gets a row for each component of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)] for b in books]
        for batch in batches:
            for row in batch.column("trees"):
                for own, tree, book in zip(totals, _trees(row.as_py(), bounds), books, strict=True):
                    count, sums = tree.totals(book)
                    own[0] += count
                    own[1] += sums
        for part, (count, sums) in enumerate(totals):
            entry, at = np.divmod(np.arange(sums.size + len(count)), sums.shape[1] + 1)
            both = np.concatenate([count[:, None], sums], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(entry), pa.array(at), pa.array(both)], ["part", "entry", "at", "total"])

    rows = planted.select("trees").mapInArrow(run, "part long, entry long, at long, total long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).toArrow()
    out = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for part, entry, at, total in zip(*(rows[c].to_pylist() for c in ("part", "entry", "at", "total")), strict=True):
        out[part][entry, at] = total
    return [(x[:, 0], x[:, 1:]) for x in out]


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    slab_rows: int = SLAB_ROWS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors and the codebooks. The table: id, label, codes (an entry for each part), error (summed squared distance of the integer components).

    Components become floor(4096 x), within BOUND. Part p holds components p * size / parts and on. Its book starts as the parts of the `entries` least ids (ties by the
    vector, null ids last; fewer vectors make fewer entries), and each round replaces entries by the floor of their parts' means; unused ones stay, as do equal ones, of which the lower is used.
    Vectors that are null or hold a null or non-finite component are left out, as are those of another length than the first kept one's. An empty table gives no rows and no books.
    Repeated rows each get a row. Other columns, whatever their names, are not read.

    Each task plants trees over slabs of its vectors once, written as a table; rounds and the last assignment walk those. Only books and their sums pass the driver.
    """
    given = pick(vectors, id=id_col, vector=vector_col, label=label_col)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    finite_ones, by_id = given.filter(F.col("vector").isNotNull() & finite), (F.col("id").asc_nulls_last(), "vector")
    first = finite_ones.orderBy(*by_id).select(F.size("vector").alias("n")).first()
    size = first.n if first else 0
    kept = finite_ones.filter(F.size("vector") == size)
    seeds = kept.orderBy(*by_id).select("vector").limit(entries).toArrow()["vector"].combine_chunks()
    bounds = [size * p // parts for p in range(parts + 1)]
    whole = _whole(seeds, size) if size else np.zeros((len(seeds), 0), np.int64)
    books = [whole[:, low:high] for low, high in zip(bounds, bounds[1:], strict=False)]
    planted = stored(_planted(kept, bounds, slab_rows), "cover-trees")
    for _ in range(rounds if len(seeds) else 0):
        totals = _totals(planted, bounds, books)
        books = [np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], book) for book, (count, sums) in zip(books, totals, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [t.codes(b) for t, b in zip(_trees(batch.column("trees")[k].as_py(), bounds), books, strict=True)]
                codes = np.stack([c for c, _ in found], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel().astype(np.int32)))
                error = pa.array(sum(e for _, e in found))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, lists, error], ["id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    coded = stored(planted.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long"), "vector-codes")
    forget(planted)
    return coded, books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every kept vector, the error of all vectors of its label, and the digest of all books."""
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    told = beside(coded, "label", F.sum("error"), "label_error")
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    return told.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Every round as tables of its own: each part against all entries, then means by component."""
    steps = [
        """kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT n, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS r(p))",
        "book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM parts WHERE n <= 16)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
    SELECT n, p, any_value(x) AS x, min(16 * list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e) AS best
    FROM parts JOIN book{k} USING (p) GROUP BY n, p)""")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS MATERIALIZED (
    SELECT p, e, list((s - (s % m + m) % m) // m ORDER BY i) AS c
    FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS m FROM (SELECT p, best % 16 AS e, x, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} AS b LEFT JOIN mean{k} AS m USING (p, e))")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT n, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM near{ROUNDS} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (n)"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE_SQL = {"op12_vector_codes": _sql()}
