"""What reviews found, each with the smallest input that shows it."""

import random

import __spark_entry__ as driver
import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillmill.operators import pages, relations, summaries
from quillmill.sources import feeds


def _equal_to_sql(spark, name, folder, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = driver.queries()[name](spark, str(folder))
    r = c.execute(driver.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(x) for x in df.columns]
    rows = sorted(repr(list(x)) for x in df.collect())
    assert rows == sorted(repr([x[i] for i in at]) for x in r.fetchall())
    return rows


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_texts_cut_at_white_space_of_any_kind(spark, tmp_path):
    texts = ["Head\n" + "x" * 3993 + c + "y" * 50 for c in ("\n\n", " \n", " \n", "zz")] + [" Edge \n　", "Straße\nbody", "STRASSE" + "y" * 4000, "Straße" + "\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _equal_to_sql(spark, "enriched_items", tmp_path, documents=docs, pages=spark.createDataFrame([(1, "http://a", "<p>x</p>")], "page_id long, url string, html string"))


def test_documents_without_language_or_number_are_entries(spark, tmp_path):
    rows = [(1, "One\nbody", "en", "a"), (2, "Two\nbody of it", None, "a"), (None, "Three\nbody", "de", "b"), (4, None, "en", "a"), (5, "Five", "en", None)]
    got = _equal_to_sql(spark, "feed_entries", tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert len(got) == 3


def test_feeds_are_read_once(spark):
    """One pass whatever the dialects; a filter or a union would repair and read every document again."""
    docs = spark.range(9).select(F.col("id").alias("source_id"), F.format_string("<rss><channel><item><title>%d</title></item></channel></rss>", "id").alias("xml"))
    out = feeds.explode_feeds(docs)
    assert _plan(out).count("Range (") == 1
    assert sorted(x.title for x in out.collect()) == [str(i) for i in range(9)]


def test_pages_go_in_slabs(spark):
    rows = [(i, "http://a", f"<p>Page {i} has one paragraph of text, " + "and then some more of it " * 4000 + "</p>") for i in range(60)] + [(60, None, None)]
    out = pages.article_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert "MapInArrow" in _plan(out)
    got = {x.id: x for x in out.collect()}
    assert set(got) == set(range(61)) and all(got[i].article_chars == len(got[i].article_text) > 90_000 and got[i].article_text.startswith(f"Page {i} has") for i in range(60)) and got[60].article_text == ""


def test_shingles_are_made_once(spark, monkeypatch):
    plans = []
    real = relations.stored
    monkeypatch.setattr(relations, "stored", lambda df, name: (plans.append((name, _plan(df))), real(df, name))[1])
    df = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40))), (2, "short"), (3, None)], "id long, text string").repartition(1)
    members, _ = relations.shingle_classes(df, "id", "text", 80)
    (whole,) = [p for name, p in plans if name == "shingle-sets"]
    assert "Filter" not in whole and [x.id for x in members.collect()] == [1]


def test_title_words_are_made_once_for_a_text(spark):
    df = spark.range(3).select("id", F.format_string("The open title %d\nA first sentence of thirty characters. And here is the second sentence of it.", "id").alias("text")).withColumn("title", F.substring_index("text", "\n", 1))
    out = summaries.score_sentences(df, "id", "text", "title")
    above = _plan(out).split("Generate")[0]
    assert "[A-Za-z][A-Za-z0-9-]" not in above and out.count() == 6


def test_packed_titles_have_their_own_common_characters():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
        return row[-1]

    r = random.Random(8)
    titles = ["".join(r.choices("abcdé開", k=k)) for k in (1, 63, 64, 65, 127, 128, 200, 5, 1, 64)] + ["a" * 64, "a" * 128]
    for bits in (1, 200, 1 << 16):
        for b in ["".join(r.choices("abcdé放", k=90)), "a", "zz", "a" * 300]:
            got = [0] * len(titles)
            for first, last, starts, full, masks in relations._packed(titles, bits):
                words = int(starts[-1]) + len(titles[last - 1]) // 64 + 1
                got[first:last] = relations._longest_common(starts, full, masks, b, words).tolist()
            assert np.array_equal(got, [plain(a, b) for a in titles])
