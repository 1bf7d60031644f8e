import random
import re
from collections import Counter

import numpy as np
import pytest
from quillmill.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "a", "to", "in"] + [r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrst")] * 6) for _ in range(n)) + "."


TEXTS = [prose(i, 80 + i) for i in range(80)] + [None, "", " \n\t", "a\x1cb\xa0c é", "x\nx\n\nx\ny\r\ny\r\n", "a b c a b c a b", "the the the the the", " ".join(["w1 w2 w3 w4"] * 40)]


def test_base_counts_equal_brute_force_and_junk_is_dropped(spark):
    junk = [" ".join(f"{w}$$$" for w in prose(900 + i, 90).split()) for i in range(6)]
    texts = TEXTS + junk
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    rows = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(rows[i].kept for i in range(80))
    assert not any(rows[len(TEXTS) + i].kept for i in range(6))


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, prose(1, 60), "en")] * 3 + [(None, None, None)], "doc_id long, text string, lang string")
    out = quality.judge(docs).collect()
    assert len(out) == 4 and [r.kept for r in out if r.doc_id is None] == [False]
    assert quality.judge(docs.limit(0)).count() == 0


def test_distance_is_jensen_shannon():
    assert quality.distance(np.array([[1, 0], [1, 1], [0, 0]]), np.array([[0, 3], [5, 5], [1, 1]])) == pytest.approx([1, 0, 0])
    p, q = np.array([0.2, 0.8]), np.array([0.5, 0.5])
    m = (p + q) / 2
    want = np.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)
    assert quality.distance(np.array([[2, 8]]), np.array([[7, 7]])) == pytest.approx([want])


def test_clean_texts_of_rare_or_no_language_are_kept(spark):
    def words_in(seed, n, common):
        r = random.Random(seed)
        return " ".join(r.choice(common) if r.random() < 0.5 else r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrst") for _ in range(n)) + "."

    en, fr, fi = "the of and a to in".split(), "le de et une les dans".split(), "ja on ei se oli mutta".split()
    rows = [(i, words_in(i, 400, en), "en") for i in range(1000)]
    rows += [(2000 + i, words_in(2000 + i, 100, fr), "fr") for i in range(12)]
    rows += [(3000 + i, words_in(3000 + i, 100, fr), None if i % 2 else "") for i in range(6)]
    rows += [(4000 + i, words_in(4000 + i, 100, fi), "fi") for i in range(3)]
    rows += [(5000 + i, " ".join(f"{w}$$$" for w in words_in(5000 + i, 100, fr).split()), lang) for i, lang in enumerate([None, "fr"])]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(out) == len(rows)
    assert all(out[i].kept for i, *_ in rows if i < 5000)
    assert not out[5000].kept and not out[5001].kept
    assert all(out[4000 + i].word_distance == 0 for i in range(3))
