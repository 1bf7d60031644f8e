"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.base import pick, slabs, table, through

BITS = 15
#: n-grams of one to so many characters.
ORDER = 3
#: Odd multipliers of the n-gram hash.
MIX = (2654435761, 2246822519, 3266489917)
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
MOST_LANGUAGES = 512


def letters(text: str | None) -> str:
    """The text in lower case with each run of other characters as one space; empty if it has no letter."""
    if text is None or not any(c.isalpha() for c in text):
        return ""
    return " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "


def grams(cleaned: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text starts, and for each order the bucket of the n-gram that starts at each character of the joined texts: 2**BITS where it would reach into the next text. No text may be empty."""
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) for x in cleaned])
    found, h = [], codes * np.uint32(MIX[0])
    for n in range(1, ORDER + 1):
        if n > 1:
            h = h[:-1] * np.uint32(MIX[1]) + codes[n - 1 :]
        buckets = np.full(len(codes), 1 << BITS, np.int32)
        buckets[: len(h)] = ((h ^ (h >> np.uint32(16))) * np.uint32(MIX[2]) + np.uint32(n)) * np.uint32(MIX[0]) >> np.uint32(32 - BITS)
        for k in range(1, n):
            buckets[np.maximum(ends - k, 0)] = 1 << BITS
        found.append(buckets)
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), found


class Model:
    """Log-probabilities, a row for each language and a column for each bucket, with a last column of zeros: languages x 2**BITS floats, so its size is bounded."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        cleaned = [letters(x) for x in texts]
        at = [i for i, x in enumerate(cleaned) if x]
        if at and self.langs:
            starts, found = grams([cleaned[i] for i in at])
            x = np.stack([p + sum(np.add.reduceat(w[b], starts) for b in found) for w, p in zip(self.weights, self.prior, strict=True)])
            best = x.argmax(axis=0)
            scores[at] = 1 / np.exp(x - x.max(axis=0)).sum(axis=0)
            for i, k in zip(at, best, strict=True):
                names[i] = self.langs[k]
        return names, scores


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slabs(batches, "text", 2 << 20):
        by: dict[str, list[str]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if cleaned := letters(text):
                by.setdefault(lang, []).append(cleaned)
        for lang, texts in by.items():
            counts = sum(np.bincount(b, minlength=(1 << BITS) + 1)[:-1] for b in grams(texts)[1])
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(counts[hit].astype(np.int64))], ["lang", "bucket", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 2000, smoothing: float = 0.5) -> Model:
    """Fits on about `most_docs` whole documents of each language, or all if it has fewer: those whose ids hash low (a bounded sample; this parameter is its expected size).

    Rows with null text or lang are left out. No rows: a model that answers `und`. Priors are the shares of all labelled rows.
    More than 512 languages is an error, as the matrix that every task gets would lose its size bound.
    """
    rows = pick(labelled, doc_id=id_col, text=text_col, lang=lang_col).filter("text is not null and lang is not null")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(shares)
    if not langs:
        return Model([], np.zeros((0, (1 << BITS) + 1)), np.zeros(0))
    # a document takes part if its id's hash, as a share of all hashes, is below its language's rate: no group is sorted or gathered
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    wanted = F.lit(False)
    for lang in langs:
        wanted = wanted | ((F.col("lang") == lang) & (share < most_docs / shares[lang]))
    sample = rows.filter(wanted).select("text", "lang")
    got = sample.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), 1 << BITS), smoothing)
    row = {x: i for i, x in enumerate(langs)}
    counts[np.array([row[x] for x in got["lang"].to_pylist()], np.int64), got["bucket"].to_numpy()] += got["n"].to_numpy()
    prior = np.array([shares[x] for x in langs], np.float64)
    weights = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return Model(langs, np.hstack([weights, np.zeros((len(langs), 1))]), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", least_score: float | None = None) -> DataFrame:
    """docs with lang_pred and score (posterior probability). Null texts and texts with no letter: `und`, 0. A column of docs with one of these names is replaced.

    With least_score, documents of language `und` or a lower score go, in the same pass. Repeated rows and null ids are rows like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.prior))

    def start():  # noqa: ANN202
        model = Model(*shared.value)

        def label(texts: list[str | None]) -> tuple:
            names, scores = model.score(texts)
            stay = None if least_score is None else [n != UNKNOWN and s >= least_score for n, s in zip(names, scores.tolist(), strict=True)]
            return stay, None, [pa.array(names, pa.string()), pa.array(scores)]

        return label

    return through(docs, text_col, start, "lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the fold that is never trained on; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
