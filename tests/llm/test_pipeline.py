"""The pipeline's stages, one by one, against plain Python on a small table."""

import random

import corpus_pipeline as pipeline
import pytest
from quillmill.llm import bpe, decontaminate, secrets

from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_simhash import brute_components, brute_print


def prose(lang, seed, n):
    r = random.Random(seed)
    base = {"en": "the of and water house there with light", "de": "der die und wasser haus nicht für licht"}[lang].split()
    return " ".join(r.choice(base) + r.choice(["", "", "", f"{r.choice('bdfgk')}{r.choice('aeiou')}{r.choice('lmnr')}"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("sf")
    item = prose("en", 999, 30)
    rows = [(i, prose(lang, i, 80 + i), lang, f"s{i}", 1) for i, lang in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[3][1], "de", "s", 1), (101, rows[3][1], "de", "s", 1), (102, rows[4][1] + " end", "en", "s", 1), (103, None, "en", "s", 0), (104, "12 34 !!", None, "s", 8)]
    rows += [(105, prose("en", 70, 50) + " " + item + " " + prose("en", 71, 9), None, None, None), (106, prose("en", 72, 60) + ' password = "abcdefgh12"', "en", "s", 1), (106, prose("en", 72, 60) + ' password = "abcdefgh12"', "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to), rows, item


def test_stages_against_plain_python(spark, folder):
    to, rows, item = folder
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{to}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]

    docs = pipeline.known_language(spark, docs, to)
    assert docs.columns == columns
    left = [r for r in rows if r[0] not in (103, 104)]
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in left)
    assert {r.lang for r in docs.filter("doc_id = 105").collect()} == {"en"}

    docs = pipeline.distinct_texts(spark, docs, to)
    assert docs.columns == columns
    first = set(brute_components([r[0] for r in left], [brute_print(r[1]) for r in left]))
    left = list({r[0]: r for r in left if r[0] in first}.values())
    assert not {100, 101} & first
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in left)

    docs = pipeline.no_leaks(spark, docs, to)
    assert docs.columns == columns
    gone = {d for d, _ in brute_leaks([(r[0], r[1]) for r in left], [(1, item)])}
    assert gone == {105}
    left = [r for r in left if r[0] not in gone]
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in left)

    docs = pipeline.no_secrets(spark, docs, to)
    assert docs.columns == columns
    texts = {r.doc_id: r for r in docs.collect()}
    assert sorted(texts) == sorted(r[0] for r in left)
    assert texts[106].text.endswith('[assign]"') and all(r.n_chars == len(r.text) for r in texts.values())
    assert not any(secrets.Scanner().spans(r.text) for r in texts.values())
    assert all(texts[r[0]].text == r[1] for r in left if r[0] != 106)

    out = {r.doc_id: r for r in pipeline.tokens(spark, docs, to).collect()}
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    for i, r in texts.items():
        n, ids, decoded = next(encoder.encode([r.text]))
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (n, bpe.sha256_hex(ids.encode()), bpe.sha256_hex(decoded.encode()))
    assert sorted(map(str, pipeline.run(spark, to).collect())) == sorted(map(str, out.values()))
    assert decontaminate.SIMILAR == 0.8


def written(spark, to, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, prose("en", 999, 30)), (2, None)], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return spark.read.parquet(f"{to}/documents.parquet")


def test_empty_table(spark, tmp_path):
    docs = written(spark, str(tmp_path), [], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_null_and_repeated_ids_and_a_very_long_text(spark, tmp_path):
    extra = ["__first", "lang_pred", "score", "fp", "c0", "n0", "first_id", "component_id"]
    texts = {1: prose("en", 1, 90), 2: prose("en", 2, 90), 3: prose("de", 3, 90), 4: prose("en", 4, 400_000), 5: None, 6: ""}
    rows = [(i, t, None, "s", 1) for i, t in texts.items()] + [(7, texts[1], "en", "s", 1), (3, texts[2], "de", "s", 1), (3, texts[3], "de", "s", 1), (None, prose("de", 8, 70), "de", "s", 1), (None, prose("de", 9, 70), "de", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = written(spark, str(tmp_path), [(*r, *extra) for r in rows], schema)
    out = docs
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
    left = out.collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "2", "3", "4", "None", "None"]
    # the row of id 3 that copies document 2 goes with it; the two alike are one
    assert {r.doc_id: r.text for r in left if r.doc_id} == {i: texts[i] for i in (1, 2, 3, 4)}
    assert all(r[c] == c for r in left for c in extra)
    assert pipeline.run(spark, str(tmp_path)).count() == 6
