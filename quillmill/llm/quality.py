"""Quality rules: how far a document's character classes and common words lie from its language's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.base import SPACE, pick, slabs, stored, table

SYMBOLS = b"#*$%&|<>"
#: Classes of bytes: first byte of a character beyond ASCII, small letter, capital, digit, space, punctuation, other; the last, of following bytes, isn't counted.
CLASSES = 7
#: A word counts as common from this share of its language's words on; at most so many words can reach the half of it in the counts of the first pass.
COMMON_SHARE = 1 / 512
#: A language has a reference of its own from this share of all words or this number of words on; fewer are too few to learn from.
LANGUAGE_SHARE = 1 / 256
LEAST_LEARNED = 1000
POOLED = ""


def classes() -> np.ndarray:
    out = np.full(256, 6, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[b] = 0 if b >= 0xC0 else CLASSES
        elif c.isalpha():
            out[b] = 1 if c.islower() else 2
        elif c.isdigit():
            out[b] = 3
        elif c in SPACE:
            out[b] = 4
        elif c in ".,;:!?'\"()-":
            out[b] = 5
    return out


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts to the reference in the same row; 0 where either is empty."""
    p, q = (x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (counts.astype(float), reference.astype(float)))
    m = np.where(p + q > 0, (p + q) / 2, 1)
    parts = sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / m), 0).sum(axis=1) for x in (p, q)) / 2
    return np.where((counts.sum(axis=1) > 0) & (reference.sum(axis=1) > 0), np.sqrt(np.clip(parts, 0, 1)), 0.0)


def _own(lang: str | None, langs: set[str]) -> str:
    return lang if lang in langs else POOLED


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slab and language the words with half of COMMON_SHARE there, and the number of all words (word null)."""
    for batch in slabs(batches, "text"):
        by: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if text:
                by.setdefault(lang or POOLED, Counter()).update(text.encode().lower().split())
        pooled: Counter = Counter()
        for counts in by.values():
            pooled.update(counts)
        out: list[tuple[str, bytes | None, int]] = []
        for lang, counts in [*((k, v) for k, v in by.items() if k != POOLED), (POOLED, pooled)]:
            total = counts.total()
            out.append((lang, None, total))
            out += [(lang, w, n) for w, n in counts.items() if n >= total * COMMON_SHARE / 2]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], ["lang", "word", "n"])


def references(docs: DataFrame, common: int = 40) -> dict[str, tuple[list[bytes], np.ndarray, np.ndarray]]:
    """For each language, and for all documents together under the empty name: its common words, their counts with that of all other words last, and counts of character classes.

    Two scans, both over all documents. The first finds candidates: a word with COMMON_SHARE of a language's words has at least half that share left
    in the slabs where it is that frequent, so no common word is missed, and at most 2 / COMMON_SHARE words of a language pass. The second counts these.
    Languages with LANGUAGE_SHARE or LEAST_LEARNED words have a reference. So what the driver and the tasks hold grows with the number of languages
    (at most 2 / COMMON_SHARE words for each), not with the input.
    """
    heavy = stored(docs.mapInArrow(_heavy, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "heavy-words")
    totals = heavy.filter("word is null").select("lang", F.col("n").alias("total"))
    everything = totals.filter(F.col("lang") == POOLED).first()
    kept = totals.filter(F.col("total") >= min((everything["total"] if everything else 0) * LANGUAGE_SHARE, LEAST_LEARNED))
    langs = {r["lang"] for r in kept.collect()}
    if not langs:
        return {}
    words = heavy.filter("word is not null").join(F.broadcast(kept), "lang").filter(F.col("n") >= F.col("total") * COMMON_SHARE / 2)
    candidates: dict[str, dict[bytes, int]] = {x: {} for x in langs}
    for lang, word in words.select("lang", "word").orderBy("lang", "word").collect():
        candidates[lang][bytes(word)] = len(candidates[lang])
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact counts of candidates (at 0 and up), of all words (-1), and of character classes (-2 and down), summed over the task's documents."""
        of, by, kinds = shared.value, {}, classes()
        for batch in slabs(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if text:
                    data = text.encode()
                    counts, parts = Counter(data.lower().split()), np.bincount(kinds[np.frombuffer(data, np.uint8)], minlength=CLASSES)
                    for key in {_own(lang, of.keys()), POOLED}:
                        sums = by.setdefault(key, Counter())
                        sums.update({i: counts[w] for w, i in of[key].items() if w in counts} if len(of[key]) < len(counts) else {of[key][w]: n for w, n in counts.items() if w in of[key]})
                        sums[-1] += counts.total()
                        sums.update({-2 - k: int(parts[k]) for k in range(CLASSES)})
        out = [(lang, i, n) for lang, sums in by.items() for i, n in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())], ["lang", "at", "n"])

    got: dict[str, dict[int, int]] = {x: {} for x in langs}
    for r in docs.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect():
        got[r["lang"]][r["at"]] = r["n"]
    out = {}
    for lang, counts in got.items():
        total = counts.get(-1, 0)
        own = sorted(((counts.get(i, 0), w) for w, i in candidates[lang].items() if counts.get(i, 0) >= total * COMMON_SHARE), key=lambda x: (-x[0], x[1]))[:common]
        out[lang] = ([w for _, w in own], np.array([*(n for n, _ in own), total - sum(n for n, _ in own)], float), np.array([counts.get(-2 - k, 0) for k in range(CLASSES)], float))
    return out


def repeated(words: list[bytes], window: int = 3) -> int:
    """Words in windows that occur twice or more in the list, the first included."""
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    n, past = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            n += i + window - max(i, past)
            past = i + window
    return n


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    class_limit: float = 0.30,
    word_limit: float = 0.30,
    word_slack: float = 0.60,
    least_chars: int = 200,
    least_words: int = 50,
) -> DataFrame:
    """Base counts of every whole text, its distances to its language's reference, and whether it is kept.

    A document of at least least_chars bytes must have class_distance <= class_limit; one of at least least_words words must have
    word_distance <= word_limit + word_slack / sqrt(words), as the histogram of a short text is noisy. Shorter ones pass that test unseen.
    References are learned from all documents (see references). Documents without a language are held against every reference, that of all documents
    together included, and the smallest distances count. Languages with too few words to learn from pass these tests unseen, with distance 0.
    Null texts count as empty: no words, base_failed, not kept. Rows with equal or null ids stay as they are; other columns are not read.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).selectExpr("cast(doc_id as long) doc_id", "text", "lang")
    shared = rows.sparkSession.sparkContext.broadcast(references(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kinds = shared.value, classes()
        width = max([1, *(len(x[1]) for x in known.values())])
        every = [np.array([*counts[:-1], *[0] * (width - len(counts)), counts[-1]]) for _, counts, _ in known.values()]
        for batch in slabs(batches, "text"):
            base, hist, reference, parts, class_reference, nearest = [], [], [], [], [], {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                text = text or ""
                data = text.encode()
                words = data.split()
                lines = [x for x in data.split(b"\n") if x.strip()]
                base.append((len(words), len(text) - sum(map(text.count, SPACE)), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)))
                common, counts, class_counts = known.get(lang or POOLED, ([], np.zeros(1), np.zeros(CLASSES)))
                seen = Counter(data.lower().split())
                own = [seen[w] for w in common]
                pad = [0] * (width - len(own) - 1)
                hist.append([*own, *pad, len(words) - sum(own)])
                reference.append([*counts[:-1], *pad, counts[-1]])
                parts.append(np.bincount(kinds[np.frombuffer(data, np.uint8)], minlength=CLASSES)[:CLASSES])
                class_reference.append(class_counts)
                if not lang and len(known) > 1:
                    found = [[seen[w] for w in x[0]] for x in known.values()]
                    rows = np.array([[*x, *[0] * (width - len(x) - 1), len(words) - sum(x)] for x in found])
                    kinds_of = np.array([x[2] for x in known.values()])
                    nearest[len(base) - 1] = distance(np.tile(parts[-1], (len(known), 1)), kinds_of).min(), distance(rows, np.array(every)).min()
            base, parts = np.array(base, np.int64), np.array(parts)
            n = base[:, 0]
            class_distance, word_distance = distance(parts, np.array(class_reference)), distance(np.array(hist), np.array(reference))
            for k, both in nearest.items():
                class_distance[k], word_distance[k] = both
            failed = (n < 50) | (100 * base[:, 4] > 50 * n)
            near = (parts.sum(axis=1) < least_chars) | (class_distance <= class_limit)
            near &= (n < least_words) | (word_distance <= word_limit + word_slack / np.sqrt(np.maximum(n, 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & near), pa.array(class_distance), pa.array(word_distance)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )

    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _jsd(p: str, q: str) -> str:
    """SQL for one bin's part of the divergence."""
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sum(({half(p)} + {half(q)}) / 2)"


QUERIES = {"op1_quality": op1_quality}
ORACLE_SQL: dict[str, str] = {
    "op1_quality": rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
        -- base counts
        grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
        base AS (
            SELECT doc_id, lang, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, w
            FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w) LEFT JOIN covered USING (doc_id)),
        -- references by language and, under '', of all documents
        flat AS (SELECT doc_id, lang, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM (SELECT doc_id, lang, unnest(w) AS x FROM w)),
        per_doc AS (SELECT doc_id, lang, x, count(*) AS n FROM flat GROUP BY ALL),
        counts AS (SELECT lang, x, sum(n) AS n FROM (SELECT lang, x, n FROM per_doc WHERE lang <> '' UNION ALL SELECT '', x, n FROM per_doc) GROUP BY ALL),
        totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
        langs AS (SELECT lang, total FROM totals WHERE total >= (SELECT total FROM totals WHERE lang = '') * {LANGUAGE_SHARE}),
        common AS (SELECT lang, x, n, total FROM counts JOIN langs USING (lang) WHERE n >= total * {COMMON_SHARE} QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= 40),
        other AS (SELECT lang, NULL AS x, total - coalesce(s, 0) AS n, total FROM langs LEFT JOIN (SELECT lang, sum(n) AS s FROM common GROUP BY lang) USING (lang)),
        own AS (SELECT b.*, CASE WHEN l.lang IS NULL THEN '' ELSE l.lang END AS ref FROM base b LEFT JOIN langs l ON b.lang = l.lang),
        hits AS (SELECT o.doc_id, o.n_words, c.x, c.n / c.total AS q, coalesce(p.n, 0) AS n FROM own o JOIN common c ON o.ref = c.lang LEFT JOIN per_doc p ON p.doc_id = o.doc_id AND p.x = c.x),
        bins AS (
            SELECT doc_id, n / n_words AS p, q FROM hits WHERE n_words > 0 UNION ALL
            SELECT o.doc_id, (o.n_words - coalesce(h.s, 0)) / o.n_words, r.n / r.total FROM own o JOIN other r ON o.ref = r.lang LEFT JOIN (SELECT doc_id, sum(n) AS s FROM hits GROUP BY doc_id) h ON h.doc_id = o.doc_id WHERE o.n_words > 0),
        word_d AS (SELECT doc_id, sqrt(greatest(0, least(1, {_jsd("p", "q")}))) AS word_distance FROM bins GROUP BY doc_id),
        -- character classes
        kinds AS (
            SELECT doc_id, lang, ref, n_words, unnest(range(0, 7)) AS k, unnest([length(regexp_replace(t, '[\x00-\x7F]', '', 'g')), length(t) - length(regexp_replace(t, '[a-z]', '', 'g')), length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')),
                length(t) - length(regexp_replace(t, '[0-9]', '', 'g')), length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')), length(t) - length(regexp_replace(t, '[.,;:!?''"()-]', '', 'g')),
                length(t) - length(regexp_replace(t, '[^\x00-\x7Fa-zA-Z0-9\x20\x09-\x0D.,;:!?''"()-]', '', 'g')) ]) AS n FROM own),
        fixed AS (SELECT doc_id, lang, ref, k, CASE WHEN k = 6 THEN length(t) - s ELSE n END AS n FROM kinds JOIN (SELECT doc_id, sum(n) FILTER (k < 6) AS s FROM kinds GROUP BY doc_id) USING (doc_id) JOIN (SELECT doc_id, t FROM d) USING (doc_id)),
        class_ref AS (SELECT lang, k, sum(n) AS n FROM (SELECT ref AS lang, k, n FROM fixed WHERE ref <> '' UNION ALL SELECT '', k, n FROM fixed) GROUP BY ALL),
        class_all AS (SELECT lang, sum(n) AS total FROM class_ref GROUP BY lang),
        doc_all AS (SELECT doc_id, sum(n) AS total FROM fixed GROUP BY doc_id),
        class_d AS (
            SELECT doc_id, any_value(total) AS total, sqrt(greatest(0, least(1, {_jsd("p", "q")}))) AS class_distance
            FROM (SELECT f.doc_id, a.total, f.n / a.total AS p, r.n / c.total AS q FROM fixed f JOIN doc_all a USING (doc_id) JOIN class_ref r ON r.lang = f.ref AND r.k = f.k JOIN class_all c ON c.lang = f.ref WHERE a.total > 0) GROUP BY doc_id),
        judged AS (SELECT o.*, coalesce(class_distance, 0) AS cd, coalesce(word_distance, 0) AS wd, coalesce(total, 0) AS total, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM own o LEFT JOIN class_d USING (doc_id) LEFT JOIN word_d USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND (total < 200 OR cd <= 0.30) AND (n_words < 50 OR wd <= 0.30 + 0.60 / sqrt(greatest(n_words, 1))) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
        FROM judged
    """
}
