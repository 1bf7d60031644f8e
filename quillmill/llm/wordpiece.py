"""Token counts by linear longest-match: a vocabulary trie with failure links and counts of the tokens they pop."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.base import pick, slabs, table
from quillmill.llm.bpe import default_path

MOST_WORDS = 120_000


def pieces(path: str) -> list[bytes]:
    """The byte strings of a file of ranks."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


def automaton(vocabulary: list[bytes]) -> dict[str, np.ndarray]:
    """Edges of the trie as sorted keys node * 256 + byte, and for each node where its failure link leads and how many tokens following it pops.

    If a node's string is a token, failing there pops that token and goes on from the root. Otherwise it pops what its parent pops, and
    more along the parent's links, until some node can take the byte. Every single byte must be a token, so that a link always leads on.
    """
    children: list[dict[int, int]] = [{}]
    token = [False]
    for piece in vocabulary:
        node = 0
        for byte in piece:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                token.append(False)
            node = children[node][byte]
        token[node] = True
    if len(children[0]) < 256 or not all(token[x] for x in children[0].values()):
        raise ValueError("the vocabulary lacks a single byte")
    link, popped = [0] * len(children), [0] * len(children)
    todo = deque([0])
    while todo:
        node = todo.popleft()
        for byte, child in children[node].items():
            todo.append(child)
            if token[child]:
                link[child], popped[child] = 0, 1
                continue
            at, n = link[node], popped[node]
            while byte not in children[at]:
                at, n = link[at], n + popped[at]
            link[child], popped[child] = children[at][byte], n
    keys = np.array([node << 8 | byte for node, own in enumerate(children) for byte in own], np.int64)
    to = np.array([x for own in children for x in own.values()], np.int32)
    order = np.argsort(keys)
    return {"keys": keys[order], "to": to[order], "link": np.array(link, np.int32), "popped": np.array(popped, np.int32)}


def count_pieces(words: list[bytes], a: dict[str, np.ndarray]) -> np.ndarray:
    """How many longest-match pieces each word has; all words step through the automaton together."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = lengths[order]
    node, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    left = len(words)
    for step in range(int(sizes[0]) if len(words) else 0):
        while left and sizes[left - 1] <= step:
            left -= 1
        byte = data[starts[:left] + step].astype(np.int64)
        todo = np.arange(left)
        while len(todo):
            key = node[todo] << 8 | byte[todo]
            at = np.minimum(np.searchsorted(a["keys"], key), len(a["keys"]) - 1)
            hit = a["keys"][at] == key
            node[todo[hit]] = a["to"][at[hit]]
            todo = todo[~hit]
            n[todo] += a["popped"][node[todo]]
            node[todo] = a["link"][node[todo]]
    todo = np.flatnonzero(node)
    while len(todo):
        n[todo] += a["popped"][node[todo]]
        node[todo] = a["link"][node[todo]]
        todo = todo[node[todo] != 0]
    out = np.empty(len(words), np.int64)
    out[order] = n
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text: its words, each with a space before it, cut greedily into the longest pieces of the vocabulary.

    path: a file of ranks with all single bytes, read on the driver; the tasks get its automaton, whose size is the vocabulary's.
    Null texts and texts without a word count 0. Rows with equal or null ids stay as they are; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(pieces(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in slabs(batches, "text", 4 << 20):
            parts = [x.encode().split() if x else [] for x in batch.column("text").to_pylist()]
            fresh = [w for w in set().union(*parts) if w not in seen]
            if len(seen) + len(fresh) > MOST_WORDS:
                seen = {}
                fresh = list(set().union(*parts))
            seen.update(zip(fresh, count_pieces([b" " + w for w in fresh], shared.value).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in parts], pa.int64()), pa.array([sum(map(seen.__getitem__, x)) for x in parts], pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
