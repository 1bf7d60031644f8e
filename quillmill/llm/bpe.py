"""BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.base import pick, sha256_hex, slabs, table

END = "</w>"
#: Fixed values of the tokenizer's file format: the pattern of words, with the White_Space characters that its \s stands for.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"
#: Distinct words that a task remembers; beyond it the memory starts anew, so it stays bounded.
MOST_WORDS = 120_000
#: Bytes from which a word is merged by a queue of its pairs: the rounds read the rest of a word once for each of its merges, which a word of any length may have thousands of.
LONG = 512


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def vocabulary(path: str) -> dict:
    """What the tasks need of the tokenizer's file, read on the driver. Its size is that of the vocabulary, not of the data."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    ids, merges = model["model"]["vocab"], model["model"]["merges"]
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)], np.int64)
    keys = pairs[:, 0] << 32 | pairs[:, 1]
    order = np.argsort(keys, kind="stable")
    letters = byte_letters()
    return {
        "special": special,
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "merged": pairs[order, 2].astype(np.int32),
        "inner": np.array([ids[x] for x in letters], np.int32),
        "last": np.array([ids[x + END] for x in letters], np.int32),
        "strings": {i: s for s, i in ids.items()} | {i: s for s, i in special.items()},
    }


def merge_rounds(words: list[bytes], v: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many words in one flat array, and where each word ends. No word may be empty.

    A round finds the rank of every neighbouring pair by binary search over the sorted pair keys, then joins in each word all places of
    its lowest-ranking pair, from the left, without overlap. Words without a pair leave the rounds.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    symbols = v["inner"][data].astype(np.int64)
    symbols[ends - 1] = v["last"][data[ends - 1]]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner = [], []
    worst = len(v["keys"])
    while len(symbols):
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(v["keys"], key), worst - 1)
        rank = np.where((v["keys"][at] == key) & (owner[:-1] == owner[1:]), v["ranks"][at], worst)
        rank = np.append(rank, worst)  # the last symbol begins no pair
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(owner)))
        open_ = np.repeat(best < worst, sizes)
        done_symbols.append(symbols[~open_])
        done_owner.append(owner[~open_])
        hit = (rank == np.repeat(best, sizes)) & open_
        # in a run of overlapping places every second one is joined, the first included
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit, -1, place))
        hit &= (place - run) % 2 == 1
        where = np.flatnonzero(hit)
        symbols[where] = v["merged"][at[where]]
        keep = open_
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    symbols, owner = np.concatenate([np.zeros(0, np.int64), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_owner])
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.cumsum(np.bincount(owner, minlength=len(words)))


def merge_long(word: bytes, v: dict, table: dict[int, tuple[int, int]]) -> list[int]:
    """The ids of one long word in n log n: the places of all pairs wait in a queue by rank, then place, so each merge looks at its two neighbours alone. table: rank and
    merged symbol of each pair's key."""
    data = np.frombuffer(word, np.uint8)
    first = v["inner"][data].astype(np.int64)
    first[-1] = v["last"][data[-1]]
    key = first[:-1] << 32 | first[1:]
    at = np.minimum(np.searchsorted(v["keys"], key), len(v["keys"]) - 1)
    hit = v["keys"][at] == key
    rank = [*np.where(hit, v["ranks"][at], -1).tolist(), -1]
    symbols, n = first.tolist(), len(first)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    # one number for a rank and a place; an entry is stale once the pair at its place has another rank
    queue = ((v["ranks"][at].astype(np.int64) << 32) + np.arange(n - 1))[hit].tolist()
    heapify(queue)
    while queue:
        own, i = divmod(heappop(queue), 1 << 32)
        if rank[i] != own:
            continue
        j = after[i]
        symbols[i], symbols[j] = table[symbols[i] << 32 | symbols[j]][1], -1
        rank[j], after[i] = -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0:
                nxt = after[k]
                got = table.get(symbols[k] << 32 | symbols[nxt]) if nxt < n else None
                rank[k] = got[0] if got else -1
                if got:
                    heappush(queue, got[0] << 32 | k)
    return [x for x in symbols if x >= 0]


def lowered(text: str) -> str:
    """Composed (NFC), then lower case character by character: a capital sigma becomes the ordinary small one anywhere."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


class Encoder:
    """Words of texts to ids, remembering the ids of the words it has seen."""

    def __init__(self, v: dict):
        import regex

        self.v, self.find = v, regex.compile(WORDS).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, v["special"])) + ")").split if v["special"] else None
        self.seen: dict[str | int, tuple[int, str, str]] = {}
        self.table: dict[int, tuple[int, int]] = {}
        self.long: list[str] = []

    def words(self, text: str) -> list[str | int]:
        """The words in order; a special token, which the text spells out, comes as its id."""
        if not self.split or not any(s in text for s in self.v["special"]):
            return self.find(lowered(text))
        parts: list[str | int] = []
        for k, x in enumerate(self.split(text)):
            parts += [self.v["special"][x]] if k % 2 else self.find(lowered(x))
        return parts

    def learn(self, words: set[str | int]) -> None:
        for w in self.long:  # long words serve one slab, so what is remembered stays bounded in bytes too
            self.seen.pop(w, None)
        self.long = []
        if len(self.seen) + len(words) > MOST_WORDS:
            self.seen = {}
        strings = self.v["strings"]
        fresh = [w for w in words if w not in self.seen]
        for w in fresh:
            if isinstance(w, int):
                self.seen[w] = (1, str(w), strings[w])
        data = {w: w.encode("utf-8", "surrogatepass") for w in fresh if isinstance(w, str)}
        for w in [w for w, x in data.items() if len(x) >= LONG]:
            if not self.table:
                self.table = dict(zip(self.v["keys"].tolist(), zip(self.v["ranks"].tolist(), self.v["merged"].tolist(), strict=True), strict=True))
            own = merge_long(data.pop(w), self.v, self.table)
            self.long.append(w)
            self.seen[w] = (len(own), " ".join(map(str, own)), " ".join([strings[i] for i in own]))
        fresh = list(data)
        for k in range(0, len(fresh), 50_000):
            part = fresh[k : k + 50_000]
            ids, ends = merge_rounds([data[w] for w in part], self.v)
            ids, at = ids.tolist(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                own = ids[at:end]
                self.seen[w] = (len(own), " ".join(map(str, own)), " ".join([strings[i] for i in own]))
                at = end

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, the ids in decimal joined by spaces, and the decoded text."""
        parts = [self.words(x) if x else [] for x in texts]
        self.learn(set().union(*parts))
        for words in parts:
            got = [self.seen[w] for w in words]
            yield sum([n for n, _, _ in got]), " ".join([x for _, x, _ in got]), " ".join([x for _, _, x in got])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """Token ids of every whole text, as the tokenizers library gives them without added special tokens, and the text decoded from them.

    path: the tokenizer's file, read on the driver. Returns doc_id, n_tokens, ids (array<int>), decoded, ids_sha256 and decoded_sha256;
    without outputs the two large columns are left out. Null texts count as empty: no ids, an empty decoded text. Special tokens that a text
    spells out are encoded as such. Decoding joins the vocabulary's strings by spaces, as the file names no decoder.
    Rows with equal or null ids stay as they are; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in slabs(batches, "text", 1 << 20):
            got = list(encoder.encode(batch.column("text").to_pylist()))
            columns = [batch.column("doc_id"), pa.array([n for n, _, _ in got], pa.int64())]
            names = ["doc_id", "n_tokens"]
            if outputs:
                columns += [pa.array([list(map(int, x.split())) for _, x, _ in got], pa.list_(pa.int32())), pa.array([x for _, _, x in got], pa.string())]
                names += ["ids", "decoded"]
            columns += [pa.array([sha256_hex(x.encode()) for _, x, _ in got]), pa.array([sha256_hex(x.encode()) for _, _, x in got])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids_sha256", "decoded_sha256"])

    large = "ids array<int>, decoded string, " if outputs else ""
    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {large}ids_sha256 string, decoded_sha256 string")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode() over all documents, without the ids and texts themselves."""
    return encode(table(spark, sf_dir, "documents"), default_path(), outputs=False)


QUERIES = {"op3_bpe": op3_bpe}
ORACLE_SQL: dict[str, str] = {}
