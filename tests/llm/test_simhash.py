import random
import re

import numpy as np
import xxhash
from quillmill.llm import simhash
from quillmill.llm.components import components


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                up[top(i)] = top(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(top(i), []).append(d)
    return [min((d for d in groups[top(i)] if d is not None), default=None) for i in range(len(ids))]


def test_prints_equal_brute_force():
    texts = [None, "", " \t", "A", "a B", "É a\x1cb c\xa0d", "the The THE the", *(" ".join(random.Random(s).choices("abcdefgh", k=s)) for s in range(40))]
    assert simhash.fingerprints(texts).tolist() == [brute_print(t) for t in texts]


def test_anchors_meet_at_every_distance_up_to_three():
    r = np.random.default_rng(0)
    parts = simhash.cells(2)
    x = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    for flips in range(4):
        y = x.copy()
        for i in range(len(y)):
            for b in r.choice(64, flips, replace=False):
                y[i] ^= np.uint64(1 << int(b))
        met = [set(), set()]
        for k, z in enumerate((x, y)):
            met[k] = {*zip(*(v.tolist() for v in simhash.anchors(z, parts, 2)), strict=True)}
        assert {row for row, _ in met[0] & met[1]} == set(range(400))


def test_links_connect_what_brute_force_connects(spark):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(40)]
    for base in prints[:10]:  # chains and dense groups
        x = base
        for _ in range(40):
            x ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 4])))
            prints.append(x)
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(signed, prints)
    first = {}
    for x, w in zip(signed, want, strict=True):
        first.setdefault(w, set()).add(got.get(x, x))
    assert all(len(v) == 1 for v in first.values())
    assert len({next(iter(v)) for v in first.values()}) == len(first)


def test_large_cells_meet_again_by_the_bits_outside_the_code(spark):
    r = random.Random(11)
    prints = [r.getrandbits(64) for _ in range(30)]
    for base in prints[:3]:
        for _ in range(150):
            prints.append(base ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 5, 6]))))
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {}
    for x, w in zip(signed, brute_components(signed, prints), strict=True):
        want.setdefault(w, set()).add(x)
    for large in (1, 3, 20):
        got = {}
        labels = {x.node: x.root for x in components(simhash.links(frame, large=large)).collect()}
        for x in signed:
            got.setdefault(labels.get(x, x), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), large


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299, 301: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def rows_of(seed):
    r = random.Random(seed)
    texts = [None, "", *(" ".join(r.choices("abcdefghijklmnop", k=60)) for _ in range(12))]
    out = [(i, r.choice(texts), "x") for i in range(60)]
    return out + [out[5], out[5], (None, texts[3], None), (None, "alone in its group of words", None), (None, None, "n")]


def test_query_equals_brute_force_with_nulls_and_repeats(spark):
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    prints = [brute_print(t) for _, t, _ in rows]
    want = brute_components([d for d, _, _ in rows], prints)
    assert got == sorted((str(d), f"{p:016x}", str(w)) for (d, _, _), p, w in zip(rows, prints, want, strict=True))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(w) for w in want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0
