import random

from quillmill.llm import substrings


def brute(docs):
    """docs: (id or None, text). (n_words, kept words) of each."""
    words = [(t or "").encode().split() for _, t in docs]
    key = [substrings.LAST if d is None else d for d, _ in docs]
    first = {}
    for d, w in zip(key, words, strict=True):
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            first[g] = min(first.get(g, (d, s)), (d, s))
    out = []
    for d, w in zip(key, words, strict=True):
        gone = {s + k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (d, s) for k in range(20)}
        out.append((len(w), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def noise(r, letters, n):
    out = []
    while len(out) < n:
        out += [r.choice(letters)] * r.choice([1, 1, 1, 1, 2, 5, 30])
    return out[:n]


def check(spark, docs, **options):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, slab string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame, **options).collect())
    want = sorted((str(d), n, n - len(k.encode().split()), k) for (d, _), (n, k) in zip(docs, brute(docs), strict=True))
    assert got == want


def test_equals_brute_force_on_words_of_few_kinds(spark):
    docs = []
    for seed in range(5):
        r = random.Random(seed)
        letters = [chr(97 + i) for i in range([1, 2, 3, 8, 60][seed])]
        shared = [noise(r, letters, r.choice([19, 20, 21, 35, 70])) for _ in range(6)]
        for _ in range(24):
            parts = noise(r, letters, r.randrange(30))
            for _ in range(r.randrange(3)):
                parts += r.choice(shared) + noise(r, letters, r.randrange(25))
            docs.append((len(docs), " ".join(parts)))
    r = random.Random(9)
    r.shuffle(docs)
    check(spark, docs, slab_bytes=600, buckets=5)


def test_nulls_repeated_rows_and_long_texts(spark):
    r = random.Random(1)
    long = " ".join(str(r.randrange(100_000)) for _ in range(30_000))
    passage = " ".join(f"w{i}" for i in range(25))
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (None, passage), (None, passage + " tail"), (4, f"a\x1cb\t{passage}\n\n{passage} é"), (6, long), (5, long + " " + passage)]
    check(spark, docs)
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_repeated_window_is_a_candidate():
    """Whatever stands around equal windows, and wherever they are cut off, shared phrases reveal them."""
    seen = substrings.Words()
    revealed = every = 0
    for seed in range(300):
        r = random.Random(seed)
        letters = [chr(97 + i) for i in range(r.choice([1, 2, 3, 6, 12, 26]))] + [f"w{i}" for i in range(r.choice([0, 0, 200]))]
        shared = [noise(r, letters, r.choice([20, 20, 21, 24, 40])) if r.random() < 0.5 else r.choices(letters, k=r.choice([20, 20, 22, 45])) for _ in range(3)]
        docs = [" ".join([*r.choices(letters, k=r.randrange(12)), *r.choice(shared), *noise(r, letters, r.randrange(12)), *r.choice(shared)]).encode() for _ in range(8)]
        parts = [substrings.Slab(list(range(k, k + 2)), docs[k : k + 2], seen) for k in range(0, 8, 2)]
        keyed = [x.keys() for x in parts]
        times, held = {}, {}
        for _, _, found, counts in keyed:
            for key, n in zip(found.tolist(), counts.tolist(), strict=True):
                times[key] = times.get(key, 0) + n
        for k, part in enumerate(parts):
            for s in part.whole(20).tolist():
                held.setdefault(part.h[s : s + 20].tobytes(), []).append((k, s))
        got = set()
        for k, (part, (places, number, found, _)) in enumerate(zip(parts, keyed, strict=True)):
            common = [times[key] > 1 for key in found.tolist()]
            got |= {(k, s) for s in part.candidates(places, substrings.np.array(common, bool)[number]).tolist()}
        repeated = {x for v in held.values() if len(v) > 1 for x in v}
        assert repeated <= got, seed
        revealed += len(got)
        every += sum(map(len, held.values()))
    assert revealed < every
