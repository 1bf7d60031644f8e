import math
import random
import zlib
from collections import Counter

import pytest
from quillmill.llm import language, sharding

WORDS = {"en": "the of and water house there with light", "de": "der die und wasser haus nicht für licht", "fr": "le la et eau maison où être lumière"}


def prose(lang, seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS[lang].split(), k=n))


def test_shards_are_even_whole_and_gapless(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randrange(400), "s") for i in range(3000)] + [(i, "the same text", "s") for i in range(3000, 4500)] + [(None, None, None), (7, "again", "s"), (7, "again", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    out = sharding.shard_documents(docs, rows_a_run=100).collect()
    assert sorted(str(x.doc_id) for x in out) == sorted(str(x[0]) for x in rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert all((x.size, x.text_crc32) in texts[x.doc_id] for x in out)
    assert {(x.law, x.grown_shard) for x in out} == {("bytes", None)}
    sizes, slots = [0] * 40, [[] for _ in range(40)]
    for x in out:
        sizes[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 3 * 416
    again = sharding.shard_documents(docs.repartition(2), rows_a_run=1000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(x.size for x in sharding.shard_documents(docs).collect()) == [16, 17]
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_languages_of_held_out_texts(spark):
    rows = [(i, prose(lang, i), lang, 0.1) for i, lang in enumerate(["en", "de", "fr"] * 60)] + [(900, None, "en", 0.1), (901, "123 %%", "en", 0.2), (902, prose("de", 5), None, None), (None, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.train(docs.filter(~language.held_out()))
    assert model.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:180])
    assert [got[i].lang_pred for i in (900, 901, 902, None)] == ["und", "und", "de", "und"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == 0
    assert language.predict(docs, language.train(docs.limit(0))).filter("lang_pred != 'und'").count() == 0


def test_held_out_fold(spark):
    ids = list(range(50))
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", language.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_scores_in_runs_equal_single_scores(spark):
    docs = spark.createDataFrame([(i, prose(lang, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)], "doc_id long, text string, lang string")
    model = language.train(docs)
    texts = ["a", "é", "the wa", prose("fr", 3), "x " * 5000]
    together = model.score(texts)
    assert together[0] == [model.score([t])[0][0] for t in texts]
    assert together[1].tolist() == pytest.approx([model.score([t])[1][0] for t in texts])


def test_shards_follow_the_sorted_keys(spark):
    """One sorted list of all rows gives the same order, and no cut of it between two keys is nearer to a wanted boundary, beyond the tolerance."""
    r = random.Random(8)
    rows = [(i, "y" * r.randrange(900)) for i in range(2000)] + [(i, "a text of many copies") for i in range(2000, 3500)] + [(3500, "z" * 60_000), (3501, None), (3502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = {x.doc_id: x for x in sharding.mapped_keys(docs, "doc_id", "text").collect()}
    out = sorted(sharding.shard_documents(docs, rows_a_run=200).collect(), key=lambda x: (x.shard, x.slot))
    assert [keyed[x.doc_id].key for x in out] == sorted(x.key for x in keyed.values())
    total, below, cuts = sum(x.size for x in out), 0, [0]
    for x, following in zip(out, [*out[1:], None], strict=True):
        below += x.size
        if following is None or keyed[following.doc_id].key != keyed[x.doc_id].key:
            cuts.append(below)
    for i in range(1, sharding.SHARDS):
        want, got = total * i // sharding.SHARDS, sum(x.size for x in out if x.shard < i)
        assert abs(got - want) <= max(min(abs(c - want) for c in cuts), 0.001 * total / sharding.SHARDS)


def plain_grams(text):
    """Buckets of all n-grams of a text, one by one."""
    cleaned, full = language.letters(text), (1 << 32) - 1
    for at in range(len(cleaned)):
        h = 0
        for n, c in enumerate(cleaned[at : at + language.ORDER], 1):
            h = (ord(c) * language.MIX[0] if n == 1 else h * language.MIX[1] + ord(c)) & full
            yield (((h ^ h >> 16) * language.MIX[2] + n) * language.MIX[0] & full) >> 32 - language.BITS


def test_query_against_plain_naive_bayes(spark, tmp_path):
    r = random.Random(4)
    mixed = [" ".join(prose(lang, i, r.randrange(1, 6)) for lang in r.sample(list(WORDS), r.randrange(1, 4))) for i in range(60)]
    rows = [(i, prose(lang, i, 12), lang) for i, lang in enumerate(["en", "de", "fr", "en"] * 25)] + [(100 + i, t, None) for i, t in enumerate(mixed)]
    rows += [(200, None, "en"), (201, "12 %", "de"), (202, "", None), (203, prose("fr", 1, 30_000), "fr"), (0, rows[0][1], "en"), (None, prose("de", 1, 9), "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    learned = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and not held(i)]
    share = Counter(lang for _, lang in learned)
    counts = {lang: Counter(b for t, k in learned if k == lang for b in plain_grams(t)) for lang in share}

    def judged(text):
        found = Counter(plain_grams(text or ""))
        if not found:
            return "und", 0.0
        x = {}
        for lang, c in counts.items():
            whole = sum(c.values()) + 0.5 * (1 << language.BITS)
            x[lang] = math.log(share[lang] / len(learned)) + sum(n * math.log((c[b] + 0.5) / whole) for b, n in found.items())
        best = max(x, key=x.get)
        return best, 1 / sum(math.exp(v - x[best]) for v in x.values())

    got = sorted(language.op8_language_id(spark, str(tmp_path)).collect(), key=lambda x: str(x.doc_id))
    want = sorted(((i, held(i), *judged(t)) for i, t, _ in rows), key=lambda x: str(x[0]))
    assert [tuple(x)[:3] for x in got] == [x[:3] for x in want]
    assert [x.score for x in got] == pytest.approx([x[3] for x in want], abs=1e-6)
