"""A corpus pipeline of five stages: language, near-duplicates, benchmark leaks, secrets, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, decontaminate, language, secrets, simhash
from quillmill.llm.base import table
from quillmill.plans.working import remove, shared_dir, swept

#: A document stays if its language is known with at least this posterior probability.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no text, no letters, or a doubtful language. Those without a label get the predicted one."""
    model = language.train(docs.filter(~language.held_out()))
    # the prediction has names of its own, so that columns of the documents with the same names survive
    text, columns = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]
    judged = language.predict(docs.toDF(*columns), model, f"c{text}", LEAST_SCORE)
    return judged.select(*[(F.coalesce(k, "lang_pred") if c == "lang" else F.col(k)).alias(c) for k, c in zip(columns, docs.columns, strict=True)])


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of repeated rows one."""
    return simhash.keep_first(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark of its kind; all documents stay."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode(docs, bpe.default_path(), outputs=False)


STAGES = [
    ("language", known_language),
    ("near_duplicates", distinct_texts),
    ("decontamination", no_leaks),
    ("secrets", no_secrets),
    ("tokens", tokens),
]
#: SQL has neither XXH64 nor byte-pair merges; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, in order; doc_id, n_tokens and the digests of ids and decoded text of each document that is left.

    Each stage's result is written to the shared folder and read by the next, so lost executors cost no more than the running stage. Once it
    is written, the working tables of the stage and the table it read are deleted; the last one read stays, as the result is lazy.
    An empty table of documents gives no rows. Repeated rows are one document, as are near-duplicates; documents with null ids are kept
    like others, one for each fingerprint. Other columns, whatever their names, go along up to the last stage.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{shared_dir(spark)}/{k}-{name}-{uuid.uuid4().hex}"
        with swept(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if read:
            remove(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
