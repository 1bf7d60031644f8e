import hashlib
import math
import random

import numpy as np
import pytest
from quillmill.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, group_key long, error long"


def plain_codes(rows, entries=16, rounds=6):
    """Lloyd's rounds over Python integers, one vector at a time."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    books, size = [], len(kept[0][1]) // 8
    codes = [[] for _ in kept]
    error = [0] * len(kept)
    for p in range(8):
        xs = [v[p * size : (p + 1) * size] for _, v, _ in kept]
        book = [list(x) for x in xs[:entries]]

        def near(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

        for _ in range(rounds):
            own = [[] for _ in book]
            for x in xs:
                own[near(x, book)[1]].append(x)
            book = [[sum(col) // len(group) for col in zip(*group, strict=True)] if group else c for group, c in zip(own, book, strict=True)]
        for k, x in enumerate(xs):
            d, e = near(x, book)
            codes[k].append(e)
            error[k] += d
        books += [str(x) for c in book for x in c]
    by_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in code), e, by_label[label], digest) for (i, _, label), code, e in zip(kept, codes, error, strict=True)]


def some_rows(seed, n=400):
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.3) for _ in range(24)] for _ in range(6)]
    rows = [(r.randrange(10 * n), [float(np.float32(x + r.gauss(0, 0.05))) for x in r.choice(middles)], r.choice([1, 1, 1, 2, None, i])) for i in range(n)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[3][1], 7)] + [(k, rows[1][1], 3) for k in range(60)]
    return rows, [(1, None, 1), (2, [math.nan] * 24, 1), (3, [math.inf] * 24, None), (4, [None] + [0.5] * 23, 1), (6, [0.1] * 16, 1)]


def test_trees_hold_what_they_say():
    r = np.random.default_rng(2)
    for _ in range(60):
        x = r.integers(-50, 50, (int(r.integers(1, 300)), 3))
        x[len(x) // 2 :] = x[0] if r.random() < 0.3 else x[len(x) // 2 :]
        t = vc.CoverTree.build(x, 4)
        assert sorted(t.order.tolist()) == list(range(len(x))) and (t.points == x[t.order]).all()
        for b, e, c, rad, f, k in zip(t.begin, t.end, t.centre, t.radius, t.first, t.kids, strict=True):
            assert np.sqrt(vc.squares(t.points[b:e], t.points[c]).max()) == pytest.approx(rad)
            assert k == 0 or (t.begin[f], t.end[f + k - 1], sum(t.end[f : f + k] - t.begin[f : f + k])) == (b, e, e - b)


def test_trees_assign_like_a_full_comparison():
    r = np.random.default_rng(3)
    whole = 0
    for _ in range(80):
        s = int(r.choice([2, 30, 5000]))
        x = np.concatenate([r.integers(-s, s, (1, 4)) + r.integers(-2, 3, (40, 4)) for _ in range(6)])
        book = np.concatenate([x[:: len(x) // 9], x[:1], r.integers(-s, s, (3, 4))])
        t = vc.CoverTree.build(x, 5)
        d = vc.squares(x[:, None], book[None])
        code, error = t.codes(book)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
        count, sums = t.totals(book)
        assert all(count[e] == (code == e).sum() and (sums[e] == x[code == e].sum(0)).all() for e in range(len(book)))
        begin, end, _ = t.assign(book)
        whole += (end - begin)[end - begin > 1].sum()
    assert whole > 0  # subtrees do go as a whole


def test_query_against_plain_rounds(spark, tmp_path):
    rows, left_out = some_rows(4)
    data = [(i, v, label, "a", "b", 1, 2) for i, v, label in rows + left_out]
    spark.createDataFrame(data, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vc.op12_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_codes(rows)))


def test_slabs_and_partitions_change_nothing(spark):
    rows, _ = some_rows(5, 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    one, books = vc.vector_codes(df.repartition(1))
    many, same = vc.vector_codes(df.repartition(7), slab_rows=10)
    assert all((a == b).all() for a, b in zip(books, same, strict=True))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_few_none_and_large(spark, tmp_path):
    df = spark.createDataFrame([(2, [1.0] * 8, None), (1, [1e30, -1e30] * 4, 1)], "vec_id long, embedding array<double>, label string")
    coded, books = vc.vector_codes(df)
    assert [len(b) for b in books] == [2] * 8 and {(x.id, tuple(x.codes), x.error) for x in coded.collect()} == {(1, (0,) * 8, 0), (2, (1,) * 8, 0)}
    assert books[0].tolist() == [[vc.BOUND], [4096]]
    df.limit(0).selectExpr("vec_id", "cast(embedding as array<float>) embedding", "1 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vc.op12_vector_codes(spark, str(tmp_path)).count() == 0
