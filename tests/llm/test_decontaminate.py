import random
import time
from collections import Counter

import numpy as np
from quillmill.llm import decontaminate as dc
from quillmill.llm.substrings import Words


def brute(docs, items):
    """All (doc, item) with an item-sized window of weighted similarity of 0.8 or more."""
    grams = {i: [tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)] for i, t in items if (w := dc.words_of(t))}
    holders = Counter(s for g in grams.values() for s in set(g))
    weight = {s: 1 / n for s, n in holders.items()}
    out = {}
    for d, t in docs:
        words = dc.words_of(t)
        for i, g in grams.items():
            width = len(g[0])
            n = len(g) + width - 1
            for s in range(max(1, len(words) - n + 1)):
                own = words[s : s + n]
                if len(own) < width:
                    continue
                x, y = Counter(tuple(own[k : k + width]) for k in range(len(own) - width + 1)), Counter(g)
                low = sum(weight.get(z, 1) * min(x[z], y[z]) for z in x | y)
                sim = low / sum(weight.get(z, 1) * max(x[z], y[z]) for z in x | y)
                if sim >= 0.8 - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def cases():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    common = [word() for _ in range(12)]
    items = [(i, " ".join(word() for _ in range(r.randrange(20, 50)))) for i in range(8)]
    items += [(20, " ".join([word() for _ in range(20)] + common)), (21, " ".join(common + [word() for _ in range(20)])), (22, "alpha beta"), (23, ""), (24, None)]
    docs = [(0, None), (1, ""), (2, " ".join(common)), (3, "Alpha, beta!"), (4, "x " * 400)]
    for i, t in items[:10]:
        w = t.split()
        docs.append((10 + i, " ".join([word() for _ in range(30)] + w + [word() for _ in range(9)]).upper()))
        docs.append((40 + i, " ".join([word() for _ in range(30)] + w[2:] + [word() for _ in range(9)])))
        docs.append((70 + i, " ".join(w[: len(w) * 9 // 10])))
        docs.append((100 + i, " ".join([word() for _ in range(30)] + w[: len(w) // 2] + ["zzz"] + w[len(w) // 2 :] + [word() for _ in range(9)])))
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert len(want) > 20
    frame = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, similarity double")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_empty_sides_and_blocks(spark, monkeypatch):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.leaks(d.limit(0), i).count() == 0 and dc.leaks(d, i.limit(0)).count() == 0
    whole = {(r.doc_id, r.item_id) for r in dc.leaks(d, i).collect()}
    wide = d.withColumn("item_id", d.doc_id).unionByName(spark.createDataFrame([(None, docs[5][1], None)], "doc_id long, text string, item_id long"))
    left = dc.without_leaks(wide, i)
    assert left.columns == wide.columns and {r.doc_id for r in left.collect()} == {k for k, _ in docs} - {k for k, _ in whole} and dc.without_leaks(d, i.limit(0)).count() == len(docs)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 600)
    assert {(r.doc_id, r.item_id) for r in dc.leaks(d, i).collect()} == whole
    assert {r.doc_id for r in dc.without_leaks(d, i).collect()} == {k for k, _ in docs} - {k for k, _ in whole}


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(2)
    items = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = np.repeat(items, 40)
    for k in range(len(prints)):
        for b in r.choice(64, k % 25, replace=False):
            prints[k] ^= np.uint64(1 << int(b))
    got = set(zip(*(x.tolist() for x in dc.within(prints, items, dc.Index([1], ["a b c"]).masks)), strict=True))
    assert got == {(a, b) for a in range(len(prints)) for b in range(len(items)) if int(prints[a] ^ items[b]).bit_count() <= dc.RADIUS}
    assert len(dc.hashes(["a", "a"], Words())) == 2


def repeated_cases():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    twice, ten, template = ([word() for _ in range(n)] for n in (60, 40, 44))
    items = [(1, " ".join(twice)), (2, " ".join(twice).upper())] + [(10 + k, " ".join(ten)) for k in range(10)]
    items += [(30 + k, " ".join(template + [word() for _ in range(6)])) for k in range(10)]
    docs = [(1, " ".join(twice[:30] + ["new"] + twice[31:])), (2, " ".join(ten[:-1] + ["new"])), (3, " ".join([word() for _ in range(20)] + items[-1][1].split()[:-1] + ["new"])), (4, " ".join(template[:20]))]
    return docs, items


def test_near_copies_of_repeated_and_templated_items(spark):
    docs, items = repeated_cases()
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert {(1, 1), (1, 2), (3, 39)} | {(2, 10 + k) for k in range(10)} <= found and not any(d == 4 for d, _ in found)
    assert {round(x.similarity, 6) for x in got if x.doc_id == 1} == {round(51 / 61, 6)}
    assert {round(x.similarity, 6) for x in got if x.doc_id == 2} == {round(35 / 37, 6)}


def test_light_shingles_carry_windows_beyond_the_radius():
    """A foreign shingle of weight 1 among light ones moves the fingerprint farther than RADIUS; the window reaches 0.8 all the same."""
    r, far = random.Random(1), 0
    for _ in range(30):
        words = [f"w{r.randrange(10**9)}" for _ in range(54)]
        index = dc.Index([k for k in range(10)], [" ".join(words + [f"x{r.randrange(10**9)}"] * (k > 0)) for k in range(10)])
        own = dc.hashes(words[:-1] + ["foreign"], Words())
        shingles = dc.windows(own, 5, dc.BASES[0])
        a = dc.simhash(shingles, index.weight(shingles), np.array([0]), np.array([len(shingles)]))[0]
        far += int(a ^ index.prints[0]).bit_count() > dc.RADIUS
        assert (0, 0) in {(d, i) for d, i, *_ in dc.leaks_of([own], index)}
    assert far


def test_figures_do_not_depend_on_the_blocks(spark, monkeypatch):
    docs, items = repeated_cases()
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    passage = [word() for _ in range(12)]
    own = [[word() for _ in range(30)] for _ in range(12)]
    items += [(100 + k, " ".join(w + passage)) for k, w in enumerate(own)]
    docs += [(100 + k, " ".join([word() for _ in range(9)] + w[k % 5 :] + passage + [word() for _ in range(9)])) for k, w in enumerate(own)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    figures = lambda: sorted((x.doc_id, x.item_id, round(x.similarity, 9), x.start_word, x.n_windows) for x in dc.leaks(d, i).collect())
    one, left = figures(), sorted(x.doc_id for x in dc.without_leaks(d, i).collect())
    assert len({x for x in one if x[2] < 1}) > 5
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1500)
    assert len(list(dc._blocks(i, "item_id", "text"))) > 3
    assert figures() == one and sorted(x.doc_id for x in dc.without_leaks(d, i).collect()) == left


def test_hot_shingles_and_many_items_of_one_length():
    """A stem shared by thousands of items, met all over a text, costs no loop over its holders."""
    r = random.Random(6)
    stem = [f"s{k}" for k in range(10)]
    own = [[f"i{k}_{j}" for j in range(25)] for k in range(4000)]
    index = dc.Index(list(range(4000)), [" ".join(stem + w) for w in own])
    assert len(index.asked) <= 10 * 4000
    seen = Words()
    text = stem * 4000 + stem + own[17] + [f"x{r.random()}" for _ in range(1000)] + stem + own[3999][:-1]
    start = time.time()
    got = dc.leaks_of([dc.hashes(text, seen), dc.hashes(stem, seen)], index)
    assert {(d, i) for d, i, *_ in got} == {(0, 17), (0, 3999)} and time.time() - start < 30


def test_random_texts_of_few_words_equal_brute_force():
    for seed in range(25):
        r = random.Random(seed)
        word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([6, 26])])
        items = [(i, " ".join(word() for _ in range(r.choice([3, 6, 9, 9, 14, 21])))) for i in range(12)]
        docs = [(i, " ".join(x for _ in range(4) for x in [*(word() for _ in range(r.randrange(9))), *r.choice(items)[1].split()])) for i in range(6)]
        docs += [(9, items[0][1]), (10, " ".join(items[1][1].split()[:-1]))]
        index, seen = dc.Index(*map(list, zip(*items, strict=True))), Words()
        got = {(docs[d][0], own): s for d, i, s, _, n in dc.leaks_of([dc.hashes(dc.words_of(t), seen) for _, t in docs], index) for own in index.ids[i] if n}
        want = brute_by_text(docs, items)
        # plain similarity counts where no window reaches it by weight, so more may be found than by weight alone
        assert want.keys() <= got.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), seed


def brute_by_text(docs, items):
    """brute(), with equal texts of items counted as one holder."""
    first = {}
    for i, t in items:
        first.setdefault(t, i)
    found = brute(docs, [(i, t) for t, i in first.items()])
    return {(d, j): s for (d, i), s in found.items() for j, t in items if first[t] == i}
