import hashlib
import random
import re
import zlib

import numpy as np
from quillmill.llm import periods


def plain_runs(w, least=12):
    """All runs by comparing each word with those that follow, period by period; a stretch keeps its smallest period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def random_words(r):
    n, k = r.randrange(0, 110), r.choice([1, 2, 3, 5, 60])
    w = [f"w{r.randrange(k)}" for _ in range(n)]
    for _ in range(r.randrange(3) if n > 12 else 0):
        a = r.randrange(n)
        p = 1 + (n - a) // r.randrange(2, 8)
        for i in range(a, min(n, a + r.randrange(5, 80))):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_of_random_lists():
    r = random.Random(3)
    for _ in range(800):
        w = random_words(r)
        for least in (12, 5, 2):
            assert periods.runs_of(np.unique(np.array(w), return_inverse=True)[1] if w else np.zeros(0, np.int64), least) == plain_runs(w, least)


def test_runs_of_many_documents_at_once():
    r = random.Random(4)
    docs = [[x.encode() for x in random_words(r)] for _ in range(400)]
    docs += [docs[0], [], [b"a"] * 11, [b"a"] * 12, [b"a", b"b"] * 6, docs[7][:6] + [b"%d" % i for i in range(40)] + docs[7][:6]]
    assert periods.slab_runs(docs) == [plain_runs(w) for w in docs]


def test_common_extensions():
    r = random.Random(5)
    s = np.array([r.randrange(2) for _ in range(90)])
    tree = periods.SuffixTree(s)
    pairs = [(i, j) for i in range(90) for j in range(90) if i != j]
    same = lambda i, j: next((k for k in range(90 - max(i, j)) if s[i + k] != s[j + k]), 90 - max(i, j))
    assert tree.common(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist() == [same(*p) for p in pairs]
    assert tree.order.tolist() == sorted(range(91), key=lambda i: s[i:].tolist())


def test_long_texts_take_linear_time():
    r = random.Random(6)
    for w in ([b"a"] * 60_000, [b"%d" % (i % 7) for i in range(60_000)]):
        assert [x[:2] for x in periods.slab_runs([w])[0]] == [(0, 60_000)]
    noise = [b"%d" % r.randrange(40) for _ in range(60_000)]
    assert periods.slab_runs([noise])[0] == []


def test_query_against_plain_runs(spark, tmp_path):
    r = random.Random(7)
    texts = [" ".join(random_words(r)) for _ in range(300)]
    texts += [None, "", " \n\t", "x" * 3000, "a b c " * 9, "a\x0bb\x1fc d e " * 8, "é ü " * 20, texts[3]]
    rows = [(i * 7, t, "c", "x") for i, t in enumerate(texts)] + [(None, "p q " * 30, None, None), (21, texts[3], None, None), (21, texts[3], None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def judged(i, text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        return (i, len(runs), *told, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))

    got = periods.op13_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(judged(x[0], x[1])) for x in rows)


def test_operator_keeps_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "s " + "a b " * 6 + "t"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in periods.find_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 12, 2)] and got[1].collapsed == "s a b t"
    assert got[2].runs == [] and got[2].collapsed == ""
    assert periods.find_runs(docs.limit(0)).count() == 0
