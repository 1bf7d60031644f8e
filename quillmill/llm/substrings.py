"""Substring dedup by recompression: token runs and pairs are named, and names of several symbols in a row that occur twice reveal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.base import pick, slabs, stored, table

WINDOW = 20
#: Rounds of pairs, after one of runs.
ROUNDS = 2
#: Words of a phrase at least. Equal windows without a run of equal words share a phrase that begins at most EDGE words after their start: see symbols().
KEY = 9
EDGE = 4
#: Bytes of text for each bucket, so that what a bucket gets keeps its size as the input grows.
BUCKET_BYTES = 8 << 20
LAST = (1 << 63) - 1
MOST_WORDS = 300_000
_U = np.uint64
#: Odd multipliers: of the mixing steps and of the two polynomials.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(MIX[0])
    x = (x ^ (x >> _U(27))) * _U(MIX[1])
    return x ^ (x >> _U(31))


class Words(dict):
    """64-bit hashes of words, given as bytes or as str, remembered."""

    def __missing__(self, word: bytes | str) -> int:
        import xxhash

        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word)
        return h


def windows(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of every `size` neighbouring words; the words' hashes are the coefficients of a polynomial modulo 2**64."""
    if len(h) < size:
        return np.zeros(0, _U)
    up, down = np.full(len(h), base, _U), np.full(len(h), pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate([np.zeros(1, _U), np.add.accumulate(h * up)])
    return mix((sums[size:] - sums[:-size]) * down[: len(h) - size + 1])


def symbols(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each symbol starts after one round of runs and ROUNDS of pairs, and its name.

    A name is a hash of what it stands for, so every task gives equal runs and pairs equal names without asking another. The first round names runs of
    equal words; each round then names neighbours (a, b) where a hash bit of a is 0 and that of b is 1, which only these two decide, and no two pairs overlap.

    So equal windows are cut alike but near their ends. Take a window without two equal words in a row: its first word may belong to a run that began before it. Of
    the symbols it starts in, the one that reaches over the start may join its right neighbour in one place and not in another; if it may, that neighbour's bit is
    1 and it joins nothing to its right, so the neighbour's end is a cut in both places, else its start is. So the first common cut lies at most 1 word in after the runs, 2 after the
    first round of pairs, and 2 + 2 = EDGE after the second; likewise at the end. In between, where WINDOW - 2 * EDGE = 12 words are left, cuts and names are the same. A symbol there has 4 words
    at most, so from the first common cut on, symbols of KEY to KEY + 3 = 12 words in all stand in both places.
    """
    name, at, own = h, np.arange(len(h)), doc
    same = np.append(False, (name[1:] == name[:-1]) & (own[1:] == own[:-1])) if len(h) else np.zeros(0, bool)
    heads = np.flatnonzero(~same)
    length = np.diff(np.append(heads, len(name))).astype(_U)
    name = np.where(length > 1, mix(name[heads] + length * _U(MIX[2])), name[heads])
    at, own = at[heads], own[heads]
    for k in range(ROUNDS):
        right = mix(name + _U((k + 1) * MIX[2] % (1 << 64))) >> _U(63) == 1
        pair = np.append(~right[:-1] & right[1:] & (own[1:] == own[:-1]), False)[: len(name)]
        name = name.copy()
        where = np.flatnonzero(pair)
        name[where] = mix(name[where] * _U(MIX[0]) + mix(name[where + 1] + _U(k)))
        keep = np.append(True, ~pair[:-1])[: len(name)]
        name, at, own = name[keep], at[keep], own[keep]
    return at, name


class Slab:
    """The words of some documents, laid end to end in the order of their ids."""

    def __init__(self, ids: list[int | None], texts: list[bytes], seen: Words):
        keys = np.array([LAST if i is None else i for i in ids], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.words = [texts[i].split() for i in self.order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.id = keys[self.order][self.doc]
        self.h = np.array([seen[w] for own in self.words for w in own], _U)

    def whole(self, size: int) -> np.ndarray:
        """The words at which `size` words of one document begin."""
        if len(self.doc) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[size - 1 :] == self.doc[: len(self.doc) - size + 1])

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases: where each starts, the number of its key in the sorted distinct keys, those keys, and how often each occurs. self.ends: the word after each phrase; self.plain: which
        ones are plain words.

        At every symbol the phrase is the names of it and the next ones up to KEY words. Runs may cut off a window's end, so within them phrases are KEY plain words, those from each of the
        run's words on and those up to it.
        """
        whole = np.zeros(len(self.doc), bool)
        whole[self.whole(KEY)] = True
        at, name = symbols(self.h, self.doc)
        cuts = np.append(at, len(self.doc))
        first = np.flatnonzero(whole[at])
        last = np.searchsorted(cuts, at[first] + KEY)  # the cut after the phrase
        up = np.full(len(name) + 1, BASES[0], _U)
        up[0] = 1
        up = np.multiply.accumulate(up)
        sums = np.append(_U(0), np.add.accumulate(name * up[:-1])) if len(name) else np.zeros(1, _U)
        down = np.full(len(name) + 1, pow(BASES[0], -1, 1 << 64), _U)
        down[0] = 1
        down = np.multiply.accumulate(down)
        phrases = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U) * _U(MIX[1]))
        twin = np.append((self.h[1:] == self.h[:-1]) & (self.doc[1:] == self.doc[:-1]), False)[: len(self.h)]
        self.twin = twin
        runs = np.flatnonzero(twin | np.append(False, twin[:-1])[: len(twin)])
        plain = np.unique(np.concatenate([runs, runs[runs >= KEY - 1] - (KEY - 1)]))
        plain = plain[whole[plain]]
        places = np.concatenate([at[first], plain])
        self.ends, self.plain = np.concatenate([cuts[last], plain + KEY]), np.arange(len(places)) >= len(first)
        found, number, counts = np.unique(np.concatenate([phrases, mix(windows(self.h, KEY, BASES[0])[plain] + _U(MIX[2]))]), return_inverse=True, return_counts=True)
        return places, number, found, counts

    def candidates(self, places: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The starts of windows that may repeat. Without two equal words in a row they have a shared phrase at most EDGE words after their start, and none that isn't shared
        between EDGE words from either end, as all those there are cut alike in equal windows. Others have shared plain words from or up to a word of the run."""
        n = len(self.doc) + 1
        good, bad, plain, twin = (np.zeros(n, np.int64) for _ in range(4))
        good[places[shared & ~self.plain] + 1] = 1
        plain[places[shared & self.plain] + 1] = 1
        twin[1:] = self.twin
        # an unshared phrase rules out the windows that start between so many words before its end and so many before its start
        alone = ~shared & ~self.plain
        lo, hi = np.maximum(0, self.ends[alone] - (WINDOW - EDGE)), places[alone] - EDGE
        np.add.at(bad, lo[lo <= hi], 1)
        np.add.at(bad, hi[lo <= hi] + 1, -1)
        good, plain, twin = np.cumsum(good), np.cumsum(plain), np.cumsum(twin)
        bad = np.cumsum(bad)
        at = self.whole(WINDOW)
        run = twin[at + WINDOW - 1] > twin[at]
        cut = (good[at + EDGE + 1] > good[at]) & (bad[at] == 0)
        return at[np.where(run, plain[at + WINDOW - KEY + 1] > plain[at], cut)]

    def distinct(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at these starts: hashes of 64 and 32 bits of each distinct one, where it is first, the number of each window among them, and
        whether a window stands where a first one does (which repeated rows do)."""
        a = windows(self.h, WINDOW, BASES[0])[at]
        b = (windows(mix(self.h), WINDOW, BASES[1])[at] >> _U(32)).astype(np.uint32)
        order = np.lexsort((at, b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(at) else np.zeros(0, bool)
        first = at[order][new]
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        is_first = (self.id[at] == self.id[first[number]]) & (self.start[at] == self.start[first[number]])
        return a[order][new], b[order][new], first, number, is_first


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _stored_slabs(docs: DataFrame, id_col: str, text_col: str, slab_bytes: int) -> DataFrame:
    """The texts in compressed runs of about slab_bytes: slab, ids, sizes and data."""
    import zstandard

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=3)
        n = 0
        for batch in slabs(batches, "text", slab_bytes):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | n], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int32())), pa.array([press.compress(b"".join(texts))], pa.binary())],
                ["slab", "ids", "sizes", "data"],
            )
            n += 1

    rows = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(cut, "slab long, ids array<long>, sizes array<int>, data binary")
    return stored(rows, "slabs")


def _open(row: dict, seen: Words) -> Slab:
    import zstandard

    data, texts, at = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, sum(row["sizes"]))), [], 0
    for n in row["sizes"]:
        texts.append(data[at : at + n])
        at += n
    return Slab(row["ids"], texts, seen)


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the hashes by bucket (their upper bits), and where each bucket ends in it."""
    bucket = (hashes >> _U(32)) * _U(buckets) >> _U(32)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))


def _answer(answers: list[dict] | None, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that the buckets sent back for a slab's hashes; a bucket that had nothing to say sent nothing."""
    out = np.zeros(len(hashes), bool)
    order, ends = _by_bucket(hashes, buckets)
    for x in answers or []:
        own = order[ends[x["bucket"] - 1] if x["bucket"] else 0 : ends[x["bucket"]]]
        out[own] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(own)).astype(bool)
    return out


def _candidates(row: dict, slab: Slab, buckets: int) -> np.ndarray:
    places, number, keys, counts = slab.keys()
    shared = _answer(row["shared"], keys, buckets) | (counts > 1)
    return slab.candidates(places, shared[number])


ANSWER = "slab long, bucket int, bits binary"
ENTRY = "bucket int, slab long, data binary"


def _gathered(messages: DataFrame, judge, name: str) -> DataFrame:  # noqa: ANN001
    """For each slab the list of its buckets' answers. judge sees one bucket: the concatenated entries of all slabs."""

    def run(group: pa.Table) -> pa.Table:
        slab, bucket, data = group.column("slab").to_pylist(), group.column("bucket").to_pylist(), group.column("data").to_pylist()
        bits, sizes = judge(data)
        ends = np.cumsum(sizes)
        out = [(s, b, packed(bits[e - n : e])) for s, b, e, n in zip(slab, bucket, ends, sizes, strict=True) if bits[e - n : e].any()]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["slab", "bucket", "bits"])

    answers = messages.groupBy("bucket").applyInArrow(run, ANSWER)
    return answers.groupBy("slab").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def _seen_twice(data: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Which keys occur in two slabs; each slab sends a key once."""
    keys = np.frombuffer(b"".join(data), _U)
    _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[number] > 1, [len(x) // 8 for x in data]


SENT = np.dtype([("a", "<u8"), ("id", "<i8"), ("b", "<u4"), ("start", "<u4")])


def _not_first(data: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Which windows start earlier elsewhere: in a smaller document, or in the same one at an earlier word."""
    rows = np.frombuffer(b"".join(data), SENT)
    order = np.lexsort((rows["start"], rows["id"], rows["b"], rows["a"]))
    r = rows[order]
    new = np.append(True, (r["a"][1:] != r["a"][:-1]) | (r["b"][1:] != r["b"][:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(rows), bool)
    out[order] = (r["id"] != r["id"][first]) | (r["start"] != r["start"][first])
    return out, [len(x) // SENT.itemsize for x in data]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slab_bytes: int = 1 << 20, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every document.

    Removed is each word in a window of WINDOW words that also starts earlier: in a document with a smaller id, or earlier in the same one; windows are
    judged on the input. Three passes over the texts, which are stored once in compressed slabs:
    1. every slab names its runs and pairs and sends the keys of its phrases, each once, to buckets by hash; a bucket answers each slab with one bit a key: shared or not;
    2. windows that may repeat by these answers (see Slab.candidates) are sent likewise, by 96-bit hash, each distinct one of a slab once with its first place; the answer is
       one bit a window: starts earlier elsewhere or not;
    3. with both answers each slab removes its words.
    A key that occurs in many documents reaches its bucket once per slab. The number of buckets follows the counted bytes of the texts, so what one of them gets does not grow with
    the input. Null ids come after all others and count as one document; rows with one id count as
    one document, and windows of theirs at the same start are no earlier than each other, so repeated rows stay alike. Null texts have no words.
    """
    texts = _stored_slabs(docs, id_col, text_col, slab_bytes)
    size = texts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n = buckets or max(16, -(-size // BUCKET_BYTES))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Slab]]:
        seen = Words()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield row, _open(row, seen)

    def sent(slab: int, hashes: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, ends = _by_bucket(hashes, n)
        parts = [(b, rows[order[ends[b - 1] if b else 0 : ends[b]]].tobytes()) for b in range(n)]
        parts = [x for x in parts if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([slab] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["bucket", "slab", "data"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, slab in opened(batches):
            found = slab.keys()[2]
            yield from sent(row["slab"], found, found)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, slab in opened(batches):
            a, b, first, _, _ = slab.distinct(_candidates(row, slab, n))
            out = np.empty(len(a), SENT)
            out["a"], out["b"], out["id"], out["start"] = a, b, slab.id[first], slab.start[first]
            yield from sent(row["slab"], a, out)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, slab in opened(batches):
            at = _candidates(row, slab, n)
            a, _, _, number, is_first = slab.distinct(at)
            gone = at[_answer(row["later"], a, n)[number] | ~is_first]
            edge = np.zeros(len(slab.doc) + 1, np.int64)
            edge[gone] += 1
            edge[gone + WINDOW] -= 1
            keep = (np.cumsum(edge)[:-1] == 0).tolist()
            texts, sizes, start = [], [], 0
            for own in slab.words:
                left = [w for w, k in zip(own, keep[start : start + len(own)], strict=True) if k]
                start += len(own)
                texts.append(b" ".join(left))
                sizes.append(len(left))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["ids"][i] for i in slab.order], pa.int64()), pa.array(slab.sizes), pa.array(slab.sizes - np.array(sizes, np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    shared = _gathered(texts.mapInArrow(keys, ENTRY), _seen_twice, "shared")
    shared = stored(shared, "shared-keys")
    with_shared = texts.join(shared.hint("shuffle_hash"), "slab", "left")
    later = stored(_gathered(with_shared.mapInArrow(repeats, ENTRY), _not_first, "later"), "later-windows")
    both = with_shared.join(later.hint("shuffle_hash"), "slab", "left")
    return both.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() of all documents, with the digest of the words left."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_substrings": op10_substrings}
ORACLE_SQL: dict[str, str] = {
    "op10_substrings": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d),
        win AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS h FROM starts),
        firsts AS (SELECT h, min(row(doc_id, s)) AS f FROM win GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM win JOIN firsts USING (h) WHERE row(doc_id, s) <> f),
        words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """
}
