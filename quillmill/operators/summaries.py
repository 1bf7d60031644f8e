"""Extractive summaries: sentences scored, the best few kept in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import blanks, clean_text, clip, fold, has_cjk, let, strip, text, title_terms
from quillmill.plans.working import stored

# Phrases of page furniture, signs of addresses, of notes and of source lines, and words that mark sentences of substance.
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "subscribe", "newsletter", "advertisement", "recommended", "related posts", "share this", "all rights reserved",
    "登入", "註冊", "訂閱", "廣告", "推薦閱讀", "相關文章", "分享此文", "版權所有", "隱私權", "圖片來源", "資料來源", "延伸閱讀",
)
ADDRESSES = ("http://", "https://", "www.")
NOTE, NUMBERED, SOURCE = r"^[(（]?(註|注)\s*\d*", r"^\d+[.、]\s*", "歌詞|頁|出版|來源|ISBN|作者|譯者"
CUES = ("open source", "open data", "governance", "privacy", "security", "dataset", "research", "report")


def is_low_value(sentence: Column) -> Column:
    """Page furniture, addresses, notes and source lines. Plain phrases are looked for one by one, which is cheaper than one pattern of them all."""
    shouts = lambda low: reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in (*BOILERPLATE, *ADDRESSES)])
    colons = F.length(sentence) - F.length(F.translate(sentence, "：", ""))
    return let(fold(sentence), shouts) | sentence.rlike(NOTE) | (sentence.rlike(NUMBERED) & sentence.rlike(SOURCE)) | ((F.length(sentence) > 180) & (colons >= 4))


def sentences(x: Column | str) -> Column:
    """The sentences of a text of 30 characters or more that are of some value, at most 700 of each. The text is cleaned once, and only as far as it has references or tags; what is cleaned needs no more of it by sentence."""
    t = text(x)
    marked = F.contains(t, F.lit("<")) | F.contains(t, F.lit("&"))
    plain = strip(F.regexp_replace(blanks(t, r"\t\r\f\x0B"), r"(?U)\n\s+", "\n"))
    cut = lambda c: F.when(has_cjk(c), F.split(c, r"(?<=[。！？!?])\s*|\n+")).otherwise(F.split(c, r"(?<=[.!?])\s+|\n+"))
    whole = let(F.when(marked, clean_text(x, "block")).otherwise(plain), cut)
    long = F.filter(F.transform(whole, lambda s: clip(strip(s), 700)), lambda s: F.length(s) >= 30)
    return F.filter(long, lambda s: ~is_low_value(s))


def sentence_score(sentence: Column, index: Column, keywords: Column, terms: Column, cues: tuple[str, ...] = CUES) -> Column:
    """Early, of good length, with keywords (8 each), title words and cues (3 each) or a digit; short and very long ones lose. Keywords and title words are folded and without white space at their ends."""
    n = F.length(sentence)

    def scored(low: Column) -> Column:
        hits = lambda words: F.size(F.filter(words, lambda w: (w != "") & F.contains(low, w)))
        cue = sum((F.when(F.contains(low, F.lit(c)), 3.0).otherwise(0.0) for c in cues), F.lit(0.0))
        return (
            F.greatest(F.lit(0.0), 16 - index * 0.25) + F.least(n, F.lit(260)) / 55 + hits(keywords) * 8 + hits(F.slice(terms, 1, 12)) * 3 + cue
            + F.when(sentence.rlike(r"\d"), 1.5).otherwise(0.0) - F.when(n < 45, 3.0).otherwise(0.0) - F.when(n > 420, 2.0).otherwise(0.0)
        )

    return let(fold(sentence), scored)


def score_sentences(records: DataFrame, id_col: str, text_col: str, title_col: str, keywords_col: str | None = None, first: int | None = None) -> DataFrame:
    """(id, index, sentence, score) of all sentences, or of the first few."""
    folded = lambda words: F.transform(words, lambda w: fold(strip(w)))
    keywords = folded(F.coalesce(F.col(keywords_col), F.array().cast("array<string>"))) if keywords_col else F.array().cast("array<string>")
    # what a text has one of is made before its sentences are rows, else each of them would make it again
    whole = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), keywords.alias("keywords"), folded(title_terms(title_col)).alias("terms"))
    own = F.posexplode(sentences("text") if first is None else F.slice(sentences("text"), 1, first))
    rows = whole.select("id", "keywords", "terms", own.alias("index", "sentence"))
    return rows.select("id", "index", "sentence", sentence_score(F.col("sentence"), F.col("index"), F.col("keywords"), F.col("terms")).alias("score"))


def top_sentences(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best sentences of each text; ties go to the later one. The rank limit is pushed below the shuffle, so a text of any length sends few rows."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.desc("index")))).filter(F.col("rank") <= k)


def summarize(records: DataFrame, id_col: str, text_col: str, title_col: str, keywords_col: str | None = None, most_chars: int = 520, most: int = 3, first: int = 80) -> DataFrame:
    """(id, sentences, summary): of the five best among the first sentences those that fit, in their order; a sentence that holds another or is held by one is left out.
    A text without sentences has no row."""
    best = top_sentences(score_sentences(records, id_col, text_col, title_col, keywords_col, first))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("index", "sentence"))), lambda s: clean_text(s["sentence"], limit=240))
    size = lambda acc: F.aggregate(acc, F.lit(0), lambda n, s: n + F.length(s))

    def take(acc: Column, s: Column) -> Column:
        held = F.exists(acc, lambda t: F.contains(t, s) | F.contains(s, t))
        full = (F.size(acc) >= most) | (size(acc) >= most_chars)
        return F.when(full | held | ((size(acc) + F.length(s) > most_chars) & (F.size(acc) > 0)), acc).otherwise(F.concat(acc, F.array(s)))

    chosen = best.groupBy("id").agg(ordered.alias("o")).select("id", F.aggregate("o", F.array().cast("array<string>"), take).alias("sentences"))
    return chosen.withColumn("summary", F.array_join("sentences", " "))


def best_text(fields: list[tuple[str, str]], least: int = 1) -> Column:
    """(text, basis) of the first of (column, label) with `least` characters or more; basis `none` and empty text if there is none."""
    clean = [(clean_text(c, "document"), label) for c, label in fields]
    picked = [F.when(F.length(c) >= least, F.struct(c.alias("text"), F.lit(label).alias("basis"))) for c, label in clean]
    return F.coalesce(*picked, F.struct(F.lit("").alias("text"), F.lit("none").alias("basis")))


def existing_text(fields: list[Column], without: str | None = None, most: int = 12_000) -> Column:
    """What several fields say, one after another with an empty line between: each cleaned and clipped to 4,000 characters, those that begin like an earlier one (500 characters, without case)
    left out, as are those that hold the phrase `without`. Nulls count as empty."""
    good = lambda v: (v != "") & (~F.contains(v, F.lit(without)) if without else F.lit(True))
    values = F.filter(F.array(*[clean_text(c, limit=4000) for c in fields]), good)

    def unlike(own: Column) -> Column:
        keys = F.transform(own, lambda v: fold(clean_text(F.substring(v, 1, 500))))
        return let(keys, lambda k: F.filter(own, lambda v, i: (F.get(k, i) != "") & (F.array_position(k, F.get(k, i)) == i + 1)))

    return clean_text(F.array_join(let(values, unlike), "\n\n"), limit=most)


def enrich(items: DataFrame, page_texts: DataFrame, fields: list[Column], now: str, id_col: str = "id", title_col: str = "title", url_col: str = "url", keywords_col: str | None = None, least: int = 280) -> DataFrame:
    """items with `article_enrichment`: status, fetched_at, source_url, final_url, text_chars, used_original_url_text, extraction_method, summary_sentences, error.

    page_texts (id, article_text, method, final_url, error) is what fetched pages gave, a row for each at most. A text of `least` characters that doesn't begin with a login is used; else what the
    item's own fields say. status tells why: ok, fallback-short-extraction, fallback-fetch-error (no page, or one with an error), fallback-existing-summary (no address). Ids of items are unique.
    """
    p = page_texts.select(F.col("id").alias("__id"), F.struct(text("article_text").alias("article_text"), "method", text("final_url").alias("final_url"), text("error").alias("error")).alias("__page"))
    s = items.join(p, F.col(id_col) == F.col("__id"), "left").drop("__id")
    linked, failed = text(url_col).rlike("^https?://"), F.col("__page").isNull() | (F.col("__page.error") != "")
    body = F.col("__page.article_text")
    whole = (F.length(body) >= least) & ~F.contains(fold(F.substring(body, 1, 400)), F.lit("login"))
    status = F.when(~linked, "fallback-existing-summary").when(failed, "fallback-fetch-error").when(whole, "ok").otherwise("fallback-short-extraction")
    s = stored(s.withColumn("__status", status).withColumn("__text", F.when(F.col("__status") == "ok", body).otherwise(existing_text(fields))), "enrichment")
    best = summarize(s, id_col, "__text", title_col, keywords_col).select(F.col("id").alias("__id"), "sentences")
    s = s.join(best, F.col(id_col) == F.col("__id"), "left").drop("__id")
    fetched = linked & ~failed
    error = F.when(~linked, "no address to fetch").when(failed, F.coalesce(F.nullif("__page.error", F.lit("")), F.lit("not fetched"))).when(F.col("__status") == "ok", "").otherwise("the page gives too little text")
    record = F.struct(
        F.col("__status").alias("status"), F.lit(now).alias("fetched_at"), text(url_col).alias("source_url"), F.when(fetched, F.col("__page.final_url")).otherwise("").alias("final_url"), F.length("__text").alias("text_chars"),
        (F.col("__status") == "ok").alias("used_original_url_text"), F.when(fetched, F.col("__page.method")).otherwise("existing-summary").alias("extraction_method"),
        F.coalesce("sentences", F.array().cast("array<string>")).alias("summary_sentences"), error.alias("error"),
    )
    return s.withColumn("article_enrichment", record).select(*items.columns, "article_enrichment")


def reading_reasons(sentences_col: str, keywords: Column, topic: Column) -> Column:
    """Always three reasons: from the summary's sentences, then the matched keywords, then the topic."""
    labels = F.array(F.lit("subject"), F.lit("context"), F.lit("value"))
    own = F.zip_with(labels, F.slice(F.coalesce(F.col(sentences_col), F.array().cast("array<string>")), 1, 3), lambda a, s: F.when(s.isNotNull(), F.concat(a, F.lit(": "), clean_text(s, limit=110))))
    more = F.array(F.when(F.size(keywords) > 0, F.concat(F.lit("keywords: "), F.array_join(F.slice(keywords, 1, 5), ", "))))
    filler = F.array_repeat(F.concat(F.lit("background: "), text(topic)), 3)
    return F.slice(F.filter(F.concat(own, more, filler), lambda s: s.isNotNull()), 1, 3)
