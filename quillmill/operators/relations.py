"""Relations between texts: shared shingles and similar titles."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import CJK_WIDE, clean_text, fold, let, text
from quillmill.plans.working import stored

LEAST_SHINGLES = 18
#: Of the smaller of two texts, the share of shingles that any relation needs.
LEAST_SHARED = 2 * 0.12 / 1.12


def shingles(x: Column | str) -> Column:
    """The distinct shingles of a text: four characters where CJK abounds, else three words, or the words if there are fewer."""
    return let(clean_text(x, "document"), _shingles)


def _shingles(clean: Column) -> Column:
    def of(t: Column) -> Column:
        by_word = let(F.regexp_extract_all(t, F.lit(rf"[a-z0-9{CJK_WIDE}]+"), 0), triples)
        # only a text with such letters is read for their share
        return F.array_distinct(F.when(t.rlike(f"[{CJK_WIDE}]"), let(F.regexp_replace(t, rf"(?U)[^\w{CJK_WIDE}]+", ""), lambda c: F.when(F.regexp_count(c, F.lit(f"[{CJK_WIDE}]")) >= F.greatest(F.lit(8), F.floor(F.length(c) / 8)), fours(c)).otherwise(by_word))).otherwise(by_word))

    def fours(c: Column) -> Column:
        return F.when(F.length(c) >= 4, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))

    def triples(w: Column) -> Column:
        three = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, w).otherwise(three)

    return let(fold(clean), of)


def _gated(text_col: str, least_chars: int) -> Column:
    """The shingles of a text of least_chars with enough of them, else null; within one expression, so that no filter computes the shingles again."""
    enough = lambda s: F.when(F.size(s) >= LEAST_SHINGLES, s)
    return let(clean_text(text_col, "document"), lambda c: F.when(F.length(c) >= least_chars, let(_shingles(c), enough)))


def shingle_table(texts: DataFrame, id_col: str, text_col: str, least_chars: int = 0) -> DataFrame:
    """(id, n, shingle) of the texts of least_chars with enough shingles; n is how many the text has."""
    own = texts.select(F.col(id_col).alias("id"), _gated(text_col, least_chars).alias("s")).filter("s is not null")
    return own.select("id", F.size("s").alias("n"), F.explode("s").alias("shingle"))


def shingle_classes(texts: DataFrame, id_col: str, text_col: str, least_chars: int = 0, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts folded by equal shingle sets: members (id, set_id, n), a row for each text, and sets (id, n, shingle), where id is the set's and shingles are 64-bit hashes.

    Shingles are computed once and written as sorted hashes, 8 bytes each; sets are equal if their sizes and 128 bits of hash are. Of each set one row is read again; only keys are grouped. Set ids hold
    for this table alone. With `among` (shingle) only shingles that it has are given, so whole sets of a large table never move.
    """
    hashes = let(_gated(text_col, least_chars), lambda s: F.array_sort(F.transform(s, lambda x: F.xxhash64(x))))
    own = texts.select(F.col(id_col).alias("id"), hashes.alias("shingles"))
    key = F.struct(F.size("shingles").alias("n"), F.xxhash64(F.lit(1), "shingles").alias("a"), F.xxhash64(F.lit(2), "shingles").alias("b"))
    # a filter on the shingles before they are written would go below them, and make them twice
    whole = stored(own.select("id", F.monotonically_increasing_id().alias("row"), key.alias("key"), "shingles"), "shingle-sets").filter("shingles is not null")
    first = stored(whole.groupBy("key").agg(F.min("row").alias("set_id")), "shingle-classes")
    members = whole.select("id", "key").join(first, "key").select("id", "set_id", "key.n")
    flat = lambda df: df.select(F.col("row").alias("id"), "key.n", F.explode("shingles").alias("shingle"))
    if among is None:
        return members, flat(whole.join(first.select(F.col("set_id").alias("row")), "row", "left_semi"))
    few = flat(whole).join(among.select("shingle").distinct(), "shingle", "left_semi")
    return members, few.join(first.select(F.col("set_id").alias("id")), "id", "left_semi")


def overlaps(probes: DataFrame, others: DataFrame, common: int = 100, own: bool = False) -> DataFrame:
    """(probe, other, n_probe, n_other, n_shared) of shingle tables: every pair that classify can keep, with its exact count; those of an id with itself only if `own`.

    A kept pair shares over LEAST_SHARED of the smaller text's shingles (Jaccard 0.12 is 0.12 / 1.12 of both together, so 0.214 of the smaller). Shingles of more than `common` texts would join each
    of them with each; a text needs no more than its rarest ones beyond that share to meet its partners, so of common shingles the smaller text sends only
    those few it can't do without, usually none. All others join as they are, and what a pair shares of the common ones is counted from its two small sets.
    """
    p = stored(probes, "shingles")
    # what no probe has can't be shared
    o = stored(others if probes is others else others.join(p.select("shingle").distinct(), "shingle", "left_semi"), "shingles")
    hot = stored(p.select("shingle").unionAll(o.select("shingle")).groupBy("shingle").count().filter(F.col("count") > common), "common-shingles")
    p_cold, o_cold = (x.join(hot, "shingle", "left_anti") for x in (p, o))
    both = lambda a, b: a.select(F.col("id").alias("probe"), F.col("n").alias("n_probe"), "shingle").join(b.select(F.col("id").alias("other"), F.col("n").alias("n_other"), "shingle"), "shingle").filter(F.lit(own) | (F.col("probe") != F.col("other")))
    pair = ["probe", "other", "n_probe", "n_other"]
    cold = both(p_cold, o_cold).groupBy(*pair).agg(F.count(F.lit(1)).alias("n_shared"))
    if not hot.limit(1).count():
        return cold
    p_hot, o_hot = (stored(x.join(hot, "shingle"), "common-of-texts") for x in (p, o))
    spare = F.ceil(F.col("n") * LEAST_SHARED) - 1
    kept = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "shingle"))).filter(F.col("rank") > spare)
    warm = both(kept(p_hot), o_hot).filter("n_probe <= n_other").select(*pair).unionByName(both(p_hot, kept(o_hot)).filter("n_probe > n_other").select(*pair)).distinct()
    sets = lambda x, name: x.groupBy(F.col("id").alias(name)).agg(F.collect_list("shingle").alias(f"{name}_set"))
    pairs = cold.unionByName(warm.withColumn("n_shared", F.lit(0).cast("long"))).groupBy(*pair).agg(F.sum("n_shared").alias("n_shared"))
    pairs = pairs.join(sets(p_hot, "probe"), "probe", "left").join(sets(o_hot, "other"), "other", "left")
    return pairs.select(*pair, (F.col("n_shared") + F.coalesce(F.size(F.array_intersect("probe_set", "other_set")), F.lit(0))).alias("n_shared"))


def classify(pairs: DataFrame) -> DataFrame:
    """overlaps with coverage both ways, Jaccard similarity, relation (full-source, subset, related), score, confidence and direction; unrelated pairs go."""
    of_other, of_probe = F.col("n_shared") / F.col("n_other"), F.col("n_shared") / F.col("n_probe")
    s = pairs.withColumns({"other_covered": of_other, "probe_covered": of_probe, "jaccard": F.col("n_shared") / (F.col("n_probe") + F.col("n_other") - F.col("n_shared"))})
    other, probe, jaccard = F.col("other_covered"), F.col("probe_covered"), F.col("jaccard")
    full = (other >= 0.72) & (F.col("n_probe") >= F.col("n_other") * 1.08)
    subset = (probe >= 0.72) | (other >= 0.58)
    related = (jaccard >= 0.12) | (F.greatest(other, probe) >= 0.3)
    s = s.withColumn("relation", F.when(full, "full-source").when(subset, "subset").when(related, "related")).filter("relation is not null")
    score = F.when(F.col("relation") == "full-source", F.greatest(other, jaccard)).when(F.col("relation") == "subset", F.greatest(other, probe)).otherwise(F.greatest(jaccard, F.least(other, probe)))
    direction = F.when(other > probe + 0.08, "other-in-probe").when(probe > other + 0.08, "probe-in-other").otherwise("similar-size")
    return s.withColumn("score", score).withColumn("confidence", F.when(F.col("score") >= 0.78, "high").when(F.col("score") >= 0.48, "medium").otherwise("low")).withColumn("direction", direction)


def related_classes(probes: DataFrame, others: DataFrame, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations without copies: pairs of sets (probe, other: set_id of their side, as classify gives them), and the members of both sides (id, set_id). Thousands of equal texts are one
    set, that meets its like on the other side once; their pairs are what members say, and are not made."""
    p_members, p_sets = shingle_classes(probes, id_col, text_col, 120)
    p_sets = stored(p_sets, "shingles")
    o_members, o_sets = shingle_classes(others, id_col, text_col, 80, p_sets)
    return classify(overlaps(p_sets, o_sets, own=True)), p_members.drop("n"), o_members.drop("n")


def text_relations(probes: DataFrame, others: DataFrame, id_col: str = "id", text_col: str = "text", most: int | None = 10) -> DataFrame:
    """The relations of each probe text (120 characters or more) to other texts (80 or more), best first: by relation, then score, then the other's id; at most `most` each.

    Equal sets of shingles are compared once. With `most`, only so many members of a set can be wanted of it, and one more, as a text is not its own; without, all pairs of texts are made,
    those of copies too: see related_classes for a result that doesn't.
    """
    found, p_members, o_members = related_classes(probes, others, id_col, text_col)
    order = F.when(F.col("relation") == "full-source", 0).when(F.col("relation") == "subset", 1).otherwise(2)
    best = [order, F.desc("score"), "other"]
    row = F.row_number()
    if most is not None:
        o_members = o_members.withColumn("n", row.over(Window.partitionBy("set_id").orderBy("id"))).filter(F.col("n") <= most + 1).drop("n")
    pairs = found.withColumnRenamed("other", "o_set").join(o_members.select(F.col("set_id").alias("o_set"), F.col("id").alias("other")), "o_set")
    if most is not None:
        pairs = pairs.withColumn("rank", row.over(Window.partitionBy("probe").orderBy(*best))).filter(F.col("rank") <= most + 1)
    pairs = pairs.withColumnRenamed("probe", "p_set").join(p_members.select(F.col("set_id").alias("p_set"), F.col("id").alias("probe")), "p_set").filter("probe != other").drop("p_set", "o_set")
    return pairs if most is None else pairs.withColumn("rank", row.over(Window.partitionBy("probe").orderBy(*best))).filter(F.col("rank") <= most)


def _packed(titles: list[str], most_bits: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, int, dict[str, int]]]:
    """Titles, by order, side by side in the bits of one integer of about `most_bits`: (first, last + 1, where each begins in words of 64 bits, all characters' bits, for each character the bits of its places).
    A title has a bit for each character and at least one more that stays free, so no carry of its sum reaches the next one."""
    first = 0
    while first < len(titles):
        starts, masks, at, last = [], {}, 0, first
        while last < len(titles) and (last == first or at + len(titles[last]) < most_bits):
            starts.append(at // 64)
            for k, c in enumerate(titles[last], at):
                masks.setdefault(c, []).append(k)
            at += (len(titles[last]) // 64 + 1) * 64
            last += 1
        places = np.zeros(at, np.uint8)
        whole = dict.fromkeys(masks, 0)
        for c, ks in masks.items():
            places[:] = 0
            places[ks] = 1
            whole[c] = int.from_bytes(np.packbits(places, bitorder="little").tobytes(), "little")
        yield first, last, np.array(starts), sum(whole.values()), whole
        first = last


def _longest_common(starts: np.ndarray, full: int, masks: dict[str, int], b: str, words: int) -> np.ndarray:
    """Characters of the longest common subsequence of each packed title and b, all titles at a time."""
    open_ = full
    for c in b:
        hit = masks.get(c)
        if hit is not None:
            u = open_ & hit
            open_ = (open_ + u | open_ ^ u) & full
    held = np.frombuffer((full ^ open_).to_bytes(words * 8, "little"), np.uint64)
    return np.add.reduceat(np.bitwise_count(held), starts, dtype=np.int64)


def alike(probes: list[str], others: list[str], least: float) -> tuple[list[tuple[int, int, float]], int]:
    """(number of the probe, number of the other, ratio) of all pairs of titles with a ratio of at least `least`, and for how many pairs it was computed.

    Matching blocks never cross, so what they hold is a common subsequence; a ratio of r needs one of r * (length + length) / 2 characters. One other title meets all probes of a pack in the bits
    of one integer, a few microseconds for each of its characters; only pairs that pass are matched block by block.
    """
    out, computed = [], 0
    length = np.array([len(x) for x in probes], np.int64)
    for first, last, starts, full, masks in _packed(probes):
        own, words = length[first:last], int(starts[-1]) + len(probes[last - 1]) // 64 + 1
        shortest, longest = int(own.min()), int(own.max())
        for j, b in enumerate(others):
            # with fewer or more characters than these no probe of the pack can be like it
            if 2 * len(b) < least * (len(b) + shortest) - 1e-9 or 2 * longest < least * (len(b) + longest) - 1e-9:
                continue
            common = _longest_common(starts, full, masks, b, words)
            for i in np.flatnonzero(2 * common >= least * (own + len(b)) - 1e-9).tolist():
                computed += 1
                ratio = SequenceMatcher(None, probes[first + i], b).ratio()
                if ratio >= least:
                    out.append((first + i, j, ratio))
    return sorted(out), computed


def title_matches(probes: DataFrame, others: DataFrame, id_col: str = "id", title_col: str = "title", least: float = 0.6, most: int = 6, block: int = 512) -> DataFrame:
    """(probe, other, similarity, rank): titles whose matching-blocks ratio is at least `least`, the best few for each probe (ties: by the other's id).

    Equal titles are compared once, whoever has them. A ratio of r needs lengths within a band, so titles are dealt to buckets of length, those of a bucket to blocks of about `block` titles,
    and each block of probes meets the blocks of its band: a task compares two blocks at a time, however many titles a bucket has. See `alike` for how. Null and empty titles match nothing.
    """
    folded = lambda df, name: df.select(F.col(id_col).alias(name), fold(text(title_col)).alias("title")).filter("title != ''")
    p, o = stored(folded(probes, "probe"), "titles"), folded(others, "other")
    # more ids than a probe's list is long can't be wanted of one title, but for the probe's own
    first = F.row_number().over(Window.partitionBy("title").orderBy("other"))
    o = stored(o.withColumn("n", first).filter(F.col("n") <= most + 1).drop("n"), "titles")
    bucket = lambda n: F.floor(F.log(n) / 0.2)
    low, high = least / (2 - least), (2 - least) / least

    def dealt(titles: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Distinct titles with bucket and block, and the number of blocks of each bucket: a row for each fifth of a power of e of a title's length."""
        t = titles.select("title").distinct().withColumn(f"{name}_bucket", bucket(F.length("title")))
        n = t.groupBy(f"{name}_bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias(f"{name}_blocks"))
        return t.join(F.broadcast(n), f"{name}_bucket").withColumn(f"{name}_block", F.pmod(F.xxhash64("title"), f"{name}_blocks")).drop(f"{name}_blocks"), n

    (pt, pn), (ot, on) = dealt(p, "p"), dealt(o, "o")
    reach = F.sequence(bucket(F.greatest(F.exp(F.col("p_bucket") * 0.2) * low * 0.999, F.lit(1.0))), bucket(F.exp((F.col("p_bucket") + 1) * 0.2) * high * 1.001))
    meet = F.broadcast(stored(pn.withColumn("o_bucket", F.explode(reach)).join(on, "o_bucket"), "title-buckets"))
    key = ["p_bucket", "p_block", "o_bucket", "o_block"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = pt.join(meet, "p_bucket").withColumn("o_block", every("o_blocks")).select(*key, "title")
    right = ot.join(meet, "o_bucket").withColumn("p_block", every("p_blocks")).select(*key, "title")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a["title"].to_pylist(), b["title"].to_pylist()
        found = alike(a, b, least)[0] if a and b else []
        return pa.table({"title": [a[i] for i, _, _ in found], "other_title": [b[j] for _, j, _ in found], "similarity": [x for _, _, x in found]}, pa.schema([("title", pa.string()), ("other_title", pa.string()), ("similarity", pa.float64())]))

    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "title string, other_title string, similarity double")
    found = p.join(pairs, "title").join(o.withColumnRenamed("title", "other_title"), "other_title").filter("probe != other").select("probe", "other", "similarity")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("similarity"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def comparison_text(columns: list[str], summary: str = "summary") -> Column:
    """The first of several text columns with 80 characters or more, else the summary."""
    clean = [clean_text(c, "document") for c in columns]
    return F.coalesce(*[F.when(F.length(c) >= 80, c) for c in clean], clean_text(summary, "document"))


def relation_votes(votes: DataFrame) -> DataFrame:
    """votes (probe, other, provider, label) as one row per pair: the label of each provider (its last by `at` if given) and the most frequent one."""
    one = votes.groupBy("probe", "other", "provider").agg((F.max_by("label", "at") if "at" in votes.columns else F.max("label")).alias("label"))
    by = F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "label"))))
    return one.groupBy("probe", "other").agg(by.alias("by_provider"), F.mode("label", True).alias("majority"))


def relation_candidates(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """Both kinds of candidates in one table, a row for each pair and kind: probe, other, kind (title or content), score, relation (null for titles)."""
    by_title = titles.select("probe", "other", F.lit("title").alias("kind"), F.round("similarity", 4).alias("score"), F.lit(None).cast("string").alias("relation"))
    by_text = texts.select("probe", "other", F.lit("content").alias("kind"), F.round("score", 4).alias("score"), "relation")
    return by_title.unionByName(by_text).groupBy("probe", "other", "kind").agg(F.max_by(F.struct("score", "relation"), "score").alias("best")).select("probe", "other", "kind", "best.*")
