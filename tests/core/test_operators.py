import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmill.operators import checks, claims, health, ingest, licences, listings, markdown, pages, relations, summaries, triage
from quillmill.operators.triage import Keywords, Taste

CONFIG = {"open": Keywords(keep=("alpha",), skip=("beta",), mechanism=("gamma",))}


@pytest.mark.parametrize(
    ("words", "want"),
    [("", "skip"), ("gamma", "ask"), ("beta", "skip"), ("beta gamma", "ask"), ("alpha", "keep"), ("alpha gamma", "keep"), ("alpha beta", "skip"), ("alpha beta gamma", "skip")],
)
def test_triage_truth_table(spark, words, want):
    df = spark.createDataFrame([("1", "open", words.upper())], "id string, track string, title string")
    assert triage.triage(df, CONFIG).first().triage.recommendation == f"suggest-{want}"


def items(spark, *rows):
    """rows: dicts; missing fields are null."""
    fields = {"id": "string", "track": "string", "title": "string", "summary": "string", "source_name": "string", "author": "string", "tags": "array<string>", "url": "string", "status": "string", "origin": "string", "captured_at": "string", "published_at": "string"}
    schema = ", ".join(f"{k} {v}" for k, v in fields.items()) + ", local_decision struct<action:string,reason:string,decided_at:string>"
    return spark.createDataFrame([tuple(r.get(k) for k in fields) + ((r.get("action"), r.get("reason"), None),) for r in rows], schema)


def test_editorial_upgrades_and_guards(spark):
    history = items(
        spark, *[{"id": f"h{i}", "source_name": "good", "tags": ["t1", "t2"], "action": "accepted-for-editing"} for i in range(3)], *[{"id": f"r{i}", "source_name": "bad", "tags": ["x1", "x2"], "action": "rejected", "reason": "no"} for i in range(3)]
    )
    new = triage.triage(
        items(
            spark, {"id": "collect", "track": "open", "title": "alpha", "source_name": "good"}, {"id": "review", "track": "open", "title": "alpha", "source_name": "other", "tags": ["x1"]}, {"id": "skip", "track": "open", "title": "nothing", "source_name": "other"},
            {"id": "taste", "track": "open", "title": "Theme Motif", "source_name": "other"}, {"id": "beat", "track": "open", "title": "my beat", "source_name": "other"}, {"id": "mech", "track": "open", "title": "gamma", "source_name": "other"},
            {"id": "tracked", "track": "open", "title": "line seven", "source_name": "other"}, {"id": "keep", "track": "open", "title": "alpha", "source_name": "bad", "tags": ["x1", "x2"]}, {"id": "drafts", "track": "open", "title": "plain", "source_name": "other", "tags": ["d1", "d2"]},
            {"id": "firm", "track": "open", "title": "note", "source_name": "Gartner", "summary": "Theme first"}, {"id": "spam", "track": "open", "title": "beta line seven my beat", "source_name": "bad", "tags": ["x1", "x2"]},
        ),
        CONFIG,
    )
    taste = Taste(themes={"open": ("Theme", "Motif")}, beats=("my beat",), tracked={"seven": ("line seven",)})
    drafts = items(spark, {"id": "draft", "tags": ["D1", "d2"], "captured_at": "2024-01-01"})
    out = {r.id: r.editorial_triage for r in triage.editorial_triage(new, triage.history_profile(history), CONFIG, taste, drafts=drafts).collect()}
    got = {k: (v.recommendation.removeprefix("suggest-"), v.upgrade) for k, v in out.items()}
    assert got == {
        "collect": ("collect", ""), "review": ("review", ""), "skip": ("skip", ""), "taste": ("review", "taste"), "beat": ("ask", "beat"), "mech": ("ask", "mechanism"), "tracked": ("ask", "tracked"),
        "keep": ("ask", "keep"), "drafts": ("review", "drafts"), "firm": ("ask", "commercial"), "spam": ("skip", ""),
    }
    assert out["drafts"].related_drafts == ["draft"] and len(out["collect"].view_reasons) == 3 and out["skip"].view_reasons == []


def test_retriage_keeps_the_time_of_what_did_not_change(spark):
    first = triage.retriage(items(spark, {"id": "1", "track": "open", "title": "alpha"}, {"id": "2", "track": "open", "title": "beta"}), CONFIG, "t1").drop("changed")
    again = triage.retriage(first.withColumn("title", F.when(F.col("id") == "2", "gamma").otherwise(F.col("title"))), CONFIG, "t2")
    assert {r.id: (r.triage.generated_at, r.changed) for r in again.collect()} == {"1": ("t1", False), "2": ("t2", True)}


def test_tags(spark):
    df = triage.triage(items(spark, {"id": "1", "track": "open", "title": "alpha gamma", "tags": ["Gamma!"]}), CONFIG)
    assert triage.suggest_tags(df, {"alpha": "A-label", "gamma": "Gamma!"}).first().suggested_tags == ["A-label"]
    assert df.select(triage.canonical_tags(F.array(F.lit("OS"), F.lit("open source"), F.lit("x")), {"os": "Open", "open source": "Open"}).alias("v")).first().v == ["Open", "x"]
    assert triage.score_tracks(df, {**CONFIG, "b": Keywords(keep=("zeta",))}).first().track == "open"


def sequential(rows, seen):
    seen, out, keep = set(seen), {}, {}
    for rank, keys, blocked in sorted(rows):
        if set(keys) & seen:
            out[rank] = "duplicate"
        elif blocked:
            out[rank] = "blocked"
        else:
            out[rank] = "new"
            seen |= set(keys)
            keep[rank] = keys
    return out


@pytest.mark.parametrize("seed", range(3))
def test_new_entries_equal_a_sequential_pass(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.sample([f"k{j}" for j in range(30)], r.randrange(0, 4)), r.random() < 0.2) for i in range(60)]
    df = spark.createDataFrame([(i, k, b) for i, k, b in rows], "pos int, keys array<string>, gate boolean")
    got = {x.pos: x.entry_outcome for x in ingest.new_entries(df, spark.createDataFrame([("k0",), ("k1",)], "key string"), ["pos"], "gate").collect()}
    assert got == sequential(rows, ["k0", "k1"])


def test_chain_of_keys(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, [])], "pos int, keys array<string>")
    got = {x.pos: x.entry_outcome for x in ingest.new_entries(df, spark.createDataFrame([], "key string"), ["pos"]).collect()}
    assert got == {1: "new", 2: "duplicate", 3: "new", 4: "new"}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 entries, each sharing a key with the next: every second one is new."""
    calls = []
    monkeypatch.setattr(ingest, "stored", lambda df, name, f=ingest.stored: (calls.append(name), f(df, name))[1])
    df = spark.range(10_000).selectExpr("cast(id as int) pos", "array(concat('k', id), concat('k', id + 1)) keys")
    out = ingest.new_entries(df, spark.createDataFrame([], "key string"), ["pos"])
    assert {(x.pos % 2, x.entry_outcome) for x in out.select("pos", "entry_outcome").distinct().collect()} == {(0, "new"), (1, "duplicate")}
    assert calls.count("pending") <= 4 and calls.count("links") < 20


def test_rounds_leave_no_working_tables(spark):
    from quillmill.plans.working import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([(i, [f"k{i // 3}", f"k{i % 7}"]) for i in range(30)], "pos int, keys array<string>")
    ingest.new_entries(df, spark.createDataFrame([], "key string"), ["pos"]).collect()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} <= {"entries", "known", "labels"}


def capped(rows, seen, most):
    seen, out, n = set(seen), {}, {}
    for source, pos, keys, blocked in sorted(rows):
        if n.get(source, 0) == most:
            out[pos] = "unseen"
        elif set(keys) & seen:
            out[pos] = "duplicate"
        elif blocked:
            out[pos] = "blocked"
        else:
            out[pos] = "new"
            seen |= set(keys)
            n[source] = n.get(source, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_capped_entries_equal_a_sequential_pass(spark, seed):
    """The cap within the pass: what a full source still has hides nothing. Sources in a row, and mixed."""
    r = random.Random(seed)
    rows = [(r.randrange(5) if seed < 2 else i % 3, i, r.sample([f"k{j}" for j in range(25)], r.randrange(0, 4)), r.random() < 0.2) for i in range(70)]
    order = ["source_id", "pos"] if seed < 2 else ["pos"]
    df = spark.createDataFrame([(f"s{a}", i, k, b) for a, i, k, b in rows], "source_id string, pos int, keys array<string>, gate boolean")
    got = {x.pos: x.entry_outcome for x in ingest.new_entries_capped(df, spark.createDataFrame([("k0",)], "key string"), order, "gate", 3).collect()}
    if seed < 2:
        assert got == capped(rows, ["k0"], 3)
    else:
        seen, n, want = {"k0"}, {}, {}
        for source, pos, keys, blocked in rows:
            want[pos] = "unseen" if n.get(source, 0) == 3 else "duplicate" if set(keys) & seen else "blocked" if blocked else "new"
            if want[pos] == "new":
                seen |= set(keys)
                n[source] = n.get(source, 0) + 1
        assert got == want


def test_due_and_fetchable(spark):
    s = spark.createDataFrame(
        [("new", "daily", None, "active", "rss", "open", "https://a/f"), ("soon", "weekly", "2024-01-30", "active", "rss", "open", "https://a/f"), ("late", "6h", "2024-01-30T12:00:00Z", "active", "rss", "open", "https://a/f"), ("off", "paused", None, "active", "rss", "open", "https://a/f"),
         ("ask", "manual", None, "active", "rss", "open", "https://a/f"), ("arch", "daily", None, "archived", "rss", "open", "https://a/f"), ("type", "daily", None, "active", "social", "open", "https://a/f"), ("unc", "daily", None, "active", "rss", "unclassified", "https://a/f"), ("url", "odd", None, "active", "rss", "open", "ftp:x")],
        "id string, fetch_frequency string, last_fetched_at string, status string, source_type string, track string, feed_url string",
    ).withColumn("rss_health", F.expr("cast(null as struct<last_success_at:string,last_checked_at:string>)"))
    got = {r.id: r.skip_reason for r in ingest.fetchable_sources(s, "2024-01-31 00:00:00", ["rss"]).collect()}
    assert got == {"new": None, "soon": "weekly is not due yet", "late": None, "off": "paused", "ask": "only on update", "arch": "not active", "type": "type is not enabled", "unc": "unclassified", "url": "address can't be fetched"}


def test_source_gate(spark):
    e = spark.createDataFrame([("s", "Alpha news", None), ("s", "Alpha beta", None), ("s", "other", None), ("t", "any", None)], "source_id string, title string, summary string").withColumns({"author": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "url": F.lit("")})
    s = spark.createDataFrame([("s", ["alpha"], ["beta"]), ("t", None, None)], "id string, required_keywords array<string>, excluded_keywords array<string>")
    assert {(r.title, r.blocked) for r in ingest.source_keyword_gate(e, s).collect()} == {("Alpha news", False), ("Alpha beta", True), ("other", True), ("any", False)}


def test_queue_and_decisions(spark):
    schema = "id string, url string, status string, local_decision struct<action:string,reason:string,decided_at:string>"
    own = spark.createDataFrame([("a", "https://x.org/1", "inbox", None), ("b", "https://x.org/2", "triaged", None)], schema)
    cand = spark.createDataFrame([("a", "https://y.org", "c", None), ("c", "https://x.org/2?utm_source=z#f", "c", None), ("d", "https://x.org/9", "c", None)], schema)
    assert {(r.queue, r.id) for r in ingest.pending_queue(own, cand).collect()} == {("item", "a"), ("candidate", "d")}
    decisions = spark.createDataFrame([("a", "direct_pr", "", "t"), ("d", "reject", "no", "t")], "id string, action string, reason string, at string")
    got = {(r.id, r.goes_to, r.status, r.local_decision.action if r.local_decision else None) for r in ingest.apply_decisions(own, cand, decisions).collect()}
    assert got == {("a", "items", "ready", "direct-pr-small-news"), ("a", "gone", "c", None), ("b", "items", "triaged", None), ("c", "candidates", "c", None), ("d", "rejected", "parked", "rejected")}


def test_upsert_and_merges(spark):
    t, c = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    assert sorted(ingest.upsert(t, c).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(ingest.upsert(t, c, insert=False).collect()) == [("a", 1), ("b", 9)]
    m = ingest.merge_first_seen(t.withColumn("n", F.col("v")), c.withColumn("n", F.col("v")), "n")
    assert sorted((r.id, r.v, r.n) for r in m.collect()) == [("a", 1, 1), ("b", 9, 2), ("c", 3, 3)]


def test_chunks_lose_nothing(spark):
    body = "\n\n".join(" ".join(f"w{i}-{j}." for j in range(40)) for i in range(9)) + "\n\n" + "x" * 500
    chunks = ingest.plan_chunks(spark.createDataFrame([(1, body), (2, "")], "id int, body string"), "id", "body", most=300)
    rows = chunks.collect()
    assert all(len(r.text) <= 300 or " " not in r.text for r in rows) and {r.item_id for r in rows} == {1}
    assert ingest.assemble_chunks(chunks).first().body.split() == body.split()
    assert ingest.assemble_chunks(chunks.filter("chunk_no > 0")).count() == 0
    assert ingest.resume_chunks(chunks, chunks.filter("chunk_no = 0")).count() == len(rows) - 1


def test_health_rules(spark):
    s = spark.createDataFrame(
        [("arch", "archived", "ok", 0, 0, 0), ("fail", "active", "failed", 0, 0, 0), ("rej", "active", "ok", 0, 0, 0), ("kw", "active", "ok", 0, 0, 12), ("dup", "active", "ok", 1, 10, 0), ("good", "active", "ok", 9, 0, 0), ("none", "active", "ok", 9, 0, 0), ("else", "active", "ok", 9, 0, 0)],
        "id string, status string, st string, new int, dup int, kw int",
    ).select("id", "status", F.lit("daily").alias("fetch_frequency"), F.struct(F.col("st").alias("last_fetch_status"), F.col("new").alias("new_items"), F.col("dup").alias("skipped_duplicate_recent"), F.col("kw").alias("skipped_source_keywords")).alias("rss_health"))
    facts = spark.createDataFrame([("rej", "rejected")] * 5 + [("good", "accepted")] * 5 + [("else", "pending")] + [("kw", "pending")], "source_id string, outcome string").withColumn("at", F.lit("2024-01-30").cast("timestamp"))
    out = {r.id: r.level for r in health.assess(s, health.outcome_counts(facts, "2024-01-31 00:00:00")).collect()}
    assert out == {"arch": "archived", "fail": "danger", "rej": "danger", "kw": "watch", "dup": "watch", "good": "healthy", "none": "new", "else": "watch"}


def test_checks(spark):
    links = spark.createDataFrame([("1", "a", "b", "full", "outbound"), ("2", "b", "a", "full", "inbound"), ("3", "a", "c", "full", "outbound")], "id string, item_id string, ref string, relation string, direction string")
    assert [r.row_key for r in checks.link_symmetry(links).collect()] == ["3"]
    raw = spark.createDataFrame([("1", '{"tags": ["a"], "review": {}}'), ("2", '{"tags": "a", "review": []}'), ("3", '{"tags": null}')], "id string, j string")
    assert sorted((r.row_key, r.detail) for r in checks.shapes(raw, "t", "j", {"tags": "array", "review": "object"}).collect()) == [("2", "review"), ("2", "tags")]
    df = spark.createDataFrame([("1", " "), ("1", "x"), (None, None)], "id string, v string")
    assert sorted((r.row_key, r.detail) for r in checks.required(df, "t", ["v"]).collect()) == [("", "v"), ("1", "v")]
    assert [(r.row_key, r.detail) for r in checks.unique(df, "t").collect()] == [("1", "2")]


def test_common_shingles_lose_no_pair(spark):
    r = random.Random(9)
    stock = [f"c{i}" for i in range(40)]
    texts = [(k, " ".join([*r.sample(stock, r.choice([0, 10, 40])), *(f"w{r.randrange(60)}" for _ in range(r.choice([20, 60])))])) for k in range(24)] + [(30, " ".join(stock)), (31, " ".join(stock + ["end"])), (32, " ".join(stock[:25]))]
    df = spark.createDataFrame(texts, "id int, text string")
    t = relations.shingle_table(df, "id", "text")
    plain = {tuple(x) for x in relations.classify(relations.overlaps(t, t)).select("probe", "other", "n_shared").collect()}
    assert len(plain) > 4
    for common in (1, 2, 5):
        assert {tuple(x) for x in relations.classify(relations.overlaps(t, t, common)).select("probe", "other", "n_shared").collect()} == plain


def brute_shingles(t):
    import re

    w = re.findall(r"[a-z0-9]+", t.casefold())
    return set(w) if len(w) < 3 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}


def test_relations(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    whole = " ".join(r.sample(words, 120))
    part = " ".join(whole.split()[20:70])
    rows = [("whole", whole), ("part", part), ("mixed", part + " " + " ".join(r.sample(words, 60))), ("other", " ".join(f"z{i}" for i in range(90))), ("17", " ".join(whole.split()[:19])), (None, None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(x.probe, x.other): x for x in relations.text_relations(df, df, most=None).collect()}
    assert got["whole", "part"].relation == "full-source" and got["part", "whole"].relation == "subset" and ("whole", "other") not in got and not any("17" in k for k in got)
    for (a, b), x in got.items():
        s, t = brute_shingles(dict(rows)[a]), brute_shingles(dict(rows)[b])
        assert (x.n_shared, round(x.jaccard, 6)) == (len(s & t), round(len(s & t) / len(s | t), 6)) and got[b, a].n_shared == x.n_shared
    cjk = spark.createDataFrame([("開放資料與公共數位基礎建設",)], "t string").select(relations.shingles("t").alias("s")).first().s
    assert cjk[0] == "開放資料" and len(cjk) == 10


def test_copies_are_members_and_no_pairs(spark):
    """5,000 equal texts: 5,000 rows of membership, one pair of their set with itself, one each way with a near copy; ranked lists are as those of all pairs."""
    words = [f"word{i}" for i in range(60)]
    same, near = " ".join(words), " ".join(words[:50] + ["other"] * 3)
    rows = [(i, same) for i in range(5000)] + [(5000, near), (5001, "  " + same + " ")]
    df = spark.createDataFrame(rows, "id int, text string")
    pairs, members, _ = relations.related_classes(df, df)
    assert pairs.count() == 4 and members.count() == 5002 and members.select("set_id").distinct().count() == 2
    few = spark.createDataFrame(rows[4990:], "id int, text string")
    ranked = {(x.probe, x.other, x.rank) for x in relations.text_relations(few, few, most=3).collect()}
    every = relations.text_relations(few, few, most=None).collect()
    order = {"full-source": 0, "subset": 1, "related": 2}
    want = set()
    for probe in range(4990, 5002):
        best = sorted((x for x in every if x.probe == probe), key=lambda x: (order[x.relation], -x.score, x.other))
        assert len(best) == 11
        want |= {(probe, x.other, k) for k, x in enumerate(best[:3], 1)}
    assert ranked == want


def test_titles_equal_all_pairs(spark):
    from difflib import SequenceMatcher

    r = random.Random(5)
    titles = [" ".join(r.choices(["open", "data", "law", "house", "of", "the", "river"], k=r.randrange(1, 6))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {(x.probe, x.other) for x in relations.title_matches(df, df, most=1000).collect()}
    assert got == {(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if i != j and SequenceMatcher(None, a, b).ratio() >= 0.6}


def test_title_bounds_leave_few_to_match():
    """No pair is lost to the bounds, and few that they pass are below the ratio."""
    from difflib import SequenceMatcher

    r = random.Random(6)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkqjxz", range(26, 0, -1), k=r.randrange(2, 9))) for _ in range(300)]
    titles = [" ".join(r.choices(words, k=r.randrange(1, 30))) for _ in range(120)] + ["開放資料", "é", "a", "aa", "x" * 400]
    others = ["".join(c for c in t if r.random() < 0.85) for t in titles[:60]] + [" ".join(r.choices(words, k=r.randrange(1, 30))) for _ in range(80)] + ["開放資", "a"]
    got, computed = relations.alike(titles, others, 0.6)
    want = [(i, j, SequenceMatcher(None, a, b).ratio()) for i, a in enumerate(titles) for j, b in enumerate(others)]
    assert got == [x for x in want if x[2] >= 0.6]
    assert computed < 0.05 * len(want)


def test_titles_of_many_copies_and_blocks(spark):
    from difflib import SequenceMatcher

    r = random.Random(7)
    titles = [" ".join(r.choices(["open", "data", "law", "house", "river"], k=r.randrange(1, 5))) for _ in range(60)] + ["open data law"] * 30 + [None, ""]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    rows = [(i, j, SequenceMatcher(None, a, b).ratio()) for i, a in enumerate(titles) for j, b in enumerate(titles) if a and b and i != j]
    want = set()
    for i in range(len(titles)):
        best = sorted((x for x in rows if x[0] == i and x[2] >= 0.6), key=lambda x: (-x[2], x[1]))[:6]
        want |= {(*x, k) for k, x in enumerate(best, 1)}
    assert {tuple(x) for x in relations.title_matches(df, df, block=7).collect()} == want


def test_votes(spark):
    v = spark.createDataFrame([("a", "b", "p1", "same"), ("a", "b", "p2", "same"), ("a", "b", "p3", "other")], "probe string, other string, provider string, label string")
    x = relations.relation_votes(v).first()
    assert x.majority == "same" and x.by_provider == {"p1": "same", "p2": "same", "p3": "other"}


def test_summary_rules(spark):
    long = "This sentence about open data is long enough to be kept in the list {}."
    body = " ".join(long.format(i) for i in range(6)) + " Subscribe to our newsletter for more of these stories today. " + long.format("with the number 7") + " Short one."
    out = summaries.summarize(spark.createDataFrame([(1, body, "Data list"), (2, "x", "t")], "id int, body string, title string"), "id", "body", "title").collect()
    assert len(out) == 1 and len(out[0].sentences) == 3 and "newsletter" not in out[0].summary and sum(map(len, out[0].sentences)) <= 520
    df = spark.createDataFrame([(["a sentence"], ["k1"])], "s array<string>, k array<string>")
    assert df.select(summaries.reading_reasons("s", F.col("k"), F.lit("topic")).alias("r")).first().r == ["subject: a sentence", "keywords: k1", "background: topic"]
    texts = spark.createDataFrame([("abc", "long enough"), ("abc", None)], "x string, y string")
    assert [tuple(r.b) for r in texts.select(summaries.best_text([("x", "first"), ("y", "second")], 5).alias("b")).collect()] == [("long enough", "second"), ("", "none")]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("see https://creativecommons.org/licenses/by-sa/4.0/ here", "CC BY-SA 4.0"), ("licensed under CC-BY-NC 4.0", "CC BY-NC 4.0"), ("Licensed under Attribution-NonCommercial-NoDerivatives 4.0 International", "CC BY-NC-ND 4.0"),
        ("licensed under cc by", "unspecified"), ("CC BY 4.0 is a name", "unspecified"), ("All rights reserved", "non-CC: copyright"), ("is licensed CC0", "CC0 1.0"), ("nothing", "unspecified"), (None, "unspecified"), ("released under cc by-sa 3.0 Taiwan", "CC BY-SA 3.0 TW"),
    ],
)
def test_licences(spark, body, want):
    df = spark.createDataFrame([(body,)], "body string")
    x = licences.infer_license(df, [("body", F.col("body"), True)]).first().license
    assert x.name == want
    if want == "CC BY-SA 3.0 TW":
        assert x.license_url == "https://creativecommons.org/licenses/by-sa/3.0/tw/"


def test_licence_words_come_before_letters(spark):
    """Spelled-out words are tried before letters, whatever stands first in the text; no version, or one that runs on into a CJK letter, is no licence."""
    bodies = {
        "Attribution-ShareAlike, licensed under CC BY-NC 4.0": "CC BY-SA 4.0", "CC BY-NC-ND 4.0 is licensed, with attribution": "CC BY-NC-ND 4.0", "is licensed: attribution 4.0": "CC BY 4.0",
        "授權 CC BY-SA 4.0 國際": "CC BY-SA 4.0", "採用 CC BY 4.0授權": "unspecified", "本作品 CC BY 3.0 台灣": "CC BY 3.0 TW", "creative commons": "unspecified",
        "著作權所有": "non-CC: copyright", "著作權所有,未標示": "unspecified", "Creative Commons Attribution NonCommercial 4.0 or Attribution-NoDerivatives": "CC BY-NC 4.0",
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = {r.body: r.license.name for r in licences.infer_license(df, [("body", F.col("body"), True)]).collect()}
    assert got == bodies


def test_claims(spark):
    df = spark.createDataFrame([("no such thing", "The firm won a prize. It may be that prizes matter. All is well.", "high"), ("a prize was given", "The firm won a prize.", "high")], "source string, out string, confidence string")
    rows = claims.guard_claims(df, "source", "out", "(?i)prize", "(?i)may", "confidence").collect()
    assert [(r.guarded, r.n_dropped, r.confidence) for r in rows] == [("It may be that prizes matter. All is well.", 1, "low"), ("The firm won a prize.", 0, "high")]
    recs = spark.createDataFrame([("a",), ("b",)], "id string")
    reviews = spark.createDataFrame([("a", "p", "keep", "s", ["r1"], 1), ("a", "q", "skip", "s", None, 2), ("a", "p", "ask", "s", [], 3)], "item_id string, provider string, recommendation string, summary string, reasons array<string>, at int")
    got = {r.id: r for r in claims.apply_reviews(recs, reviews, "p").collect()}
    assert got["a"].chosen_review.recommendation == "ask" and len(got["a"].chosen_review.reasons) == 3 and set(got["a"].reviews) == {"p", "q"} and got["b"].reviews is None
    batches = claims.assign_batches(spark.range(1000).select(F.col("id").cast("string").alias("id")), {"p": 3, "q": 1}, 50)
    counts = {r.provider: r["count"] for r in batches.groupBy("provider").count().collect()}
    assert counts["p"] > 2 * counts["q"] and batches.groupBy("provider", "batch").count().agg(F.max("count")).first()[0] < 100


def test_markdown(spark):
    assert markdown.rewrite("# Title\nFirst paragraph.\nSecond paragraph.") == "# Title\n\nFirst paragraph.\n\nSecond paragraph."
    assert markdown.rewrite("Intro\n- a\n- b\n| x |\n| y |\n> q\n> r\n```\ncode\n\nmore\n```\nEnd") == "Intro\n\n- a\n- b\n\n| x |\n| y |\n\n> q\n> r\n\n```\ncode\n\nmore\n```\n\nEnd"
    body = "a\nb\nc\nd\ne\nf"
    rows = markdown.normalize_paragraphs(spark.createDataFrame([(1, body, 11), (2, "a\n\nb", 4), (3, None, None)], "id int, b string, n int"), "b", "n").collect()
    assert {(r.id, r.changed, r.n) for r in rows} == {(1, True, 16), (2, False, 4), (3, False, None)}
    links = markdown.link_candidates(spark.createDataFrame([(1, "[S](https://a.org/series/x) [C](https://a.org/book/ch1) [A](https://a.org/author/q)")], "id int, b string"), "id", "b")
    assert {(r.title, r.skip_reason) for r in links.collect()} == {("S", "index page"), ("C", None), ("A", "author page")}


def test_existing_texts_are_merged_once(spark):
    long = "x y " * 200
    df = spark.createDataFrame([("Title", " title ", long + "a", long + "b", "not available: none"), (None, "", None, "b", None)], "a string, b string, c string, d string, e string")
    got = [x.v for x in df.select(summaries.existing_text([F.col(c) for c in "abcde"], "not available").alias("v")).collect()]
    assert got == ["Title\n\n" + long + "a", "b"]


def test_enrichment_tells_where_a_text_is_from(spark):
    body = " ".join(f"Sentence number {i} of the body tells about open data in the city." for i in range(9))
    items = spark.createDataFrame([(1, "T", "own summary", "https://a"), (2, "T", "own summary", "https://b"), (3, "T", "own summary", "https://c"), (4, "T", "own summary", "ftp:d"), (5, "T", "own summary", "https://e"), (6, None, None, None)], "id int, title string, summary string, url string")
    pages_ = spark.createDataFrame([(1, body, "semantic-block", "https://a/x", None), (2, "short", "all-paragraphs", "https://b", ""), (3, "", "none", "", "timeout"), (5, "Login here. " + body, "semantic-block", "https://e", "")], "id int, article_text string, method string, final_url string, error string")
    out = {x.id: x.article_enrichment for x in summaries.enrich(items, pages_, [F.col("title"), F.col("summary")], "now").collect()}
    assert {i: x.status for i, x in out.items()} == {1: "ok", 2: "fallback-short-extraction", 3: "fallback-fetch-error", 4: "fallback-existing-summary", 5: "fallback-short-extraction", 6: "fallback-existing-summary"}
    assert out[1].used_original_url_text and out[1].text_chars == len(body) and len(out[1].summary_sentences) == 3 and out[1].final_url == "https://a/x"
    assert out[2].text_chars == len("T\n\nown summary") and out[2].extraction_method == "all-paragraphs" and out[3].error == "timeout" and out[3].extraction_method == "existing-summary"
    assert out[6].text_chars == 0 and out[6].summary_sentences == []


def test_explanations(spark):
    t = "struct<matched_keywords: array<string>>"
    e = "struct<content_kind: string, recommendation: string, deletion_score: int>"
    rows = [("1", "open", "Title", "First one. Second one.", None, (["a", "b", "c", "d", "e"],), ("small-news", "suggest-review", 0)), ("2", "x", "標題", "English only. More.", ["t1", "t2", "t3", "t4"], ([],), ("needs-review", "suggest-skip", 2)), ("3", "open", None, "第一句。第二句！第三句。", [], ([],), ("featured-article", "suggest-skip", 0))]
    df = spark.createDataFrame(rows, f"id string, track string, title string, summary string, tags array<string>, triage {t}, editorial_triage {e}")
    got = {x.id: x.explanation for x in triage.explained(df, {"open": "Open things"}).collect()}
    assert [got[k].topic for k in "123"] == ["a, b, c, d", "t1, t2, t3", "Open things"]
    assert got["1"].summary_text == "Title\nabout a, b, c, d; it seems plain news. First clue: First one." and got["2"].summary_text.startswith("標題\nabout t1, t2, t3; it seems for a person to judge. Its summary is not")
    assert got["3"].summary_text == "untitled\n第一句。第二句！" and got["2"].summary_reason.startswith("like") and got["3"].summary_reason.startswith("too few") and got["1"].next_step.startswith("check")


def test_rewritten_columns_equal_the_plain_version(spark):
    r = random.Random(9)
    lines = ["- a", "* b  b", "1. one", "12) x", "-nolist", "> q", ">q2", "| x | y |", "|---|:-:|", "--- | ---", "|open", "```", "```python", "~~~", "text of a line", "  indented", "\t", "", "# Head", "-----", "![i](u)", "a\x07b", "\u3000wide\u3000", "`c`"]
    rows = [(i, r.choice(["\n", "\n", "\r\n"]).join(r.choices(lines, k=r.randrange(0, 14)))) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, b string")
    got = {x.id: x.v for x in df.select("id", markdown.rewritten(F.col("b")).alias("v")).collect()}
    assert got == {i: markdown.rewrite(b) for i, b in rows}
    kept = {x.id: (x.b, x.changed) for x in markdown.normalize_paragraphs(df, "b").collect()}
    for i, b in rows:
        t = b.replace("\r\n", "\n")
        needs = t.strip() and not re.search(r"\n[ \t]*\n", t) and t.count("\n") >= 5
        want = markdown.rewrite(b) if needs else b
        assert kept[i] == (want, want != b)


PAGE = """<html lang="zh-TW"><head><title>Plain &amp; title</title><meta property="og:title" content="Card &quot;title&quot;"><meta name="author" content="A. Writer"><meta content="2024-02-03T01:00:00Z" property="article:published_time">
<link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="license" href="https://creativecommons.org/licenses/by/4.0/"></head><body><article><p>card text that is long enough to count as a paragraph here.</p></article>
<div class="wysiwyg"><p>%s</p></div><div class="x wysiwyg"><h2>Head</h2><p>%s</p><ul><li>an entry of the list that is long</li></ul></div></body></html>"""


def test_page_metadata_and_text(spark):
    one, two = "First long paragraph of the body. " * 6, "Second long paragraph of the <a href='/y'>body</a>. " * 6
    df = spark.createDataFrame([(1, "https://a.org/2020/01/02/slug", PAGE % (one, two)), (2, "https://a.org/2020/01/02/slug", "<p>Only short text is here on this page, really.</p>"), (3, None, None)], "page_id int, url string, html string")
    m = {r.id: r for r in pages.page_metadata(df).collect()}
    assert (m[1].title, m[1].author.value, str(m[1].published.value), m[1].license.source, m[1].language.value) == ('Card "title"', "A. Writer", "2024-02-03", "rel=license", "zh-Hant")
    assert str(m[2].published.value) == "2020-01-02" and m[2].published.source == "url" and m[3].title == ""
    t = {r.id: r for r in pages.article_text(df).collect()}
    assert t[1].method == "semantic-block" and "First long" in t[1].article_text and "Second long" in t[1].article_text and "card text" not in t[1].article_text and "## Head" in t[1].article_markdown and "(https://a.org/y)" in t[1].article_markdown
    assert t[2].method == "all-paragraphs" and t[3].article_text == ""
    assert [(r.id, r.feed_url) for r in pages.discover_feed_links(df).collect()] == [(1, "https://a.org/feed.xml")]


def test_access_and_fulltext(spark):
    rows = [("Just a moment... enable javascript and cookies to continue", 200, 0), ("Please sign in to read", 403, 0), ("denied", 403, 0), ("x", 429, 900), ("long text", 200, 900), ("subscribe to continue", 200, 10), (None, 200, None)]
    df = spark.createDataFrame([(h, s, n, "https://a.org") for h, s, n in rows], "html string, status int, chars int, url string")
    assert [r.access_issue for r in pages.classify_access(df, "html", "status", "chars").collect()] == ["cdn-challenge", "login-or-subscription", "http-access-denied", "rate-limited", None, "login-or-subscription", None]
    u = spark.createDataFrame([("https://arxiv.org/abs/2401.01234v1", ""), ("https://a.org/x", "")], "url string, html string").select(pages.preferred_fulltext("url", "html").alias("v")).collect()
    assert [r.v for r in u] == ["https://arxiv.org/html/2401.01234v1", None]


def test_enrichment(spark):
    cur = spark.createDataFrame([("1", "own", None), ("2", None, None)], "id string, description string, image_url string")
    new = spark.createDataFrame([("1", "page", "i"), ("2", "page", "i")], "id string, description string, image_url string")
    assert sorted((r.id, r.description, r.image_url) for r in pages.merge_metadata(cur, new, ["description", "image_url"]).collect()) == [("1", "own", "i"), ("2", "page", "i")]
    q = spark.createDataFrame([("never", None, ["x"]), ("old", "2024-01-01", ["x"]), ("recent", "2024-01-30", ["x"]), ("full", None, [])], "id string, last_attempt_at string, missing_fields array<string>")
    assert [r.id for r in pages.enrichment_queue(q, "2024-01-31 00:00:00", most=2).collect()] == ["never", "old"]
    m = spark.createDataFrame([("", "d", None)], "i string, d string, a string").select(pages.missing_fields(F.col("i"), F.col("d"), F.col("a")).alias("v")).first().v
    assert m == ["image", "article"]
    i = spark.createDataFrame([(None, 'x <img src="https://a.org/1.png"> https://b.org/2.jpg')], "c string, s string").select(pages.image_candidates(["c"], "s").alias("v")).first().v
    assert i == ["https://a.org/1.png", "https://b.org/2.jpg"]
    f = spark.createDataFrame([("a.png", bytearray(b"\x89PNG\r\n\x1a\n00000000")), ("b.jpg", bytearray(b"GIF89a..........")), ("c.webp", bytearray(b"RIFF0000WEBP0000"))], "path string, content binary")
    assert [(r.format, r.ending_agrees) for r in pages.sniff_images(f).collect()] == [("png", True), ("gif", False), ("webp", True)]
    c = pages.complete_metadata(spark.createDataFrame([("1", "T", "A", "word " * 50)], "id string, title string, author string, summary string")).first()
    assert (c.original_title, c.original_author_source, c.original_language, c.original_license_source) == ("T", "feed", "en", "inferred")


def test_listings(spark):
    df = spark.createDataFrame([(str(i), f"t{i % 3}") for i in range(50)], "id string, title string")
    placed = listings.with_neighbours(listings.positions(df, [F.col("title"), F.col("id")]))
    want = [r.id for r in df.orderBy("title", "id").collect()]
    rows = sorted(placed.collect(), key=lambda r: r.pos)
    assert [r.id for r in rows] == want and [r.next_id for r in rows] == [*want[1:], None] and [r.previous_id for r in rows] == [None, *want[:-1]]
    home = listings.homepage_order([df.filter("id in ('1', '2')"), df.filter("id in ('2', '3')")], [F.col("id")]).collect()
    assert [(r.id, r.group_no) for r in home] == [("1", 0), ("2", 0), ("3", 1)]
    arts = spark.createDataFrame([("A", ["2", "9", "1"])], "id string, item_ids array<string>")
    its = spark.createDataFrame([("1", "one", "img1"), ("2", "two", "")], "id string, title string, image_url string")
    b = listings.article_bridge(arts, its).first()
    assert [x.id for x in b["items"]] == ["2", "1"] and b.hero_image == "img1"
    both = listings.ordered_records(spark.createDataFrame([(0, "2"), (1, "1")], "pos int, id string"), its, its.withColumn("title", F.lit("candidate"))).collect()
    assert [(r.id, r.title) for r in both] == [("2", "two"), ("1", "one")]
    assert [r.slug for r in listings.stale_outputs(spark.createDataFrame([("a",), ("b",)], "slug string"), spark.createDataFrame([("a",)], "slug string")).collect()] == ["b"]


def test_titles_autofill_and_records(spark):
    df = spark.createDataFrame([("關於開放的英文資料：X", "# Real", "https://a.org/2024/02/03/x", "", "", "Long description")], "a string, b string, url string, published_at string, summary string, description string")
    assert df.select(listings.display_title(["a", "b"]).alias("v")).first().v == "Real"
    one = triage.triage(df.withColumns({"track": F.lit("open"), "title": F.lit("alpha")}), CONFIG)
    x = pages.autofill(one).first()
    assert (x.published_at, x.summary, x.notes) == ("2024-02-03", "Long description", "terms: alpha")
    md = spark.createDataFrame([("First paragraph.\n\nA heading:\n\n• entry\n\nLast one.", "T")], "b string, t string")
    assert md.select(pages.text_to_markdown(F.col("b"), F.col("t")).alias("v")).first().v == "# T\n\nFirst paragraph.\n\n## A heading\n\n- entry\n\nLast one."
    lic = licences.infer_license(spark.createDataFrame([("released under CC BY 4.0", "T", "u", None, "S"), ("x", "T", "u", None, None)], "body string, title string, url string, author string, source_name string"), [("body", F.col("body"), True)])
    rows = licences.license_record(lic, "2024-01-31").collect()
    assert rows[0].license_record.attribution_table[0].attribution == "S" and rows[0].license_record.evidence["access_date"] == "2024-01-31" and rows[1].license_record.attribution_table is None
    assert not rows[0].license_record.uncertain and rows[1].license_record.provenance.source_field == "default"
    assert df.select(pages.needs_fulltext(F.lit(None), F.lit("u")).alias("v")).first().v


def test_candidates_of_both_kinds(spark):
    titles = spark.createDataFrame([("a", "b", 0.7), ("a", "b", 0.9)], "probe string, other string, similarity double")
    texts = spark.createDataFrame([("a", "b", 0.8, "subset")], "probe string, other string, score double, relation string")
    assert sorted(tuple(r) for r in relations.relation_candidates(titles, texts).collect()) == [("a", "b", "content", 0.8, "subset"), ("a", "b", "title", 0.9, None)]


def test_structured_data_of_all_scripts(spark):
    script = '<script type="application/ld+json">%s</script>'
    deep = '{"@graph": [{"@type": "WebPage"}, {"author": [{"name": " "}, {"headline": "Deep <b>Writer</b>"}], "license": {"url": "https://a.org/terms"}, "mainEntity": {"dateCreated": "2023-05-06T01:00:00Z", "inLanguage": "de"}}]}'
    rows = [(1, script % "{broken" + script % deep), (2, script % '[{"creator": {"@id": "x"}}, {"author": "Later"}]'), (3, script % ("[" * 30_000)), (4, '<time class="x">now</time><time content="2022-03-04">then</time>'), (5, None)]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id int, url string, html string")
    m = {r.id: r for r in pages.page_metadata(df).collect()}
    assert (m[1].author.value, m[1].author.source, m[1].license.value, str(m[1].published.value), m[1].published.source, m[1].language.value) == ("Deep Writer", "json-ld", "https://a.org/terms", "2023-05-06", "json-ld", "de")
    assert m[2].author.value == "Later" and m[3].author is None and m[5].author is None
    assert (str(m[4].published.value), m[4].published.source) == ("2022-03-04", "time")


def test_licence_records(spark):
    rows = ["{}", '{"license": null}', '{"license": {}}', '{"license": []}', '{"license": {"name": " CC0 1.0 ", "evidence": {}, "attribution_table": [], "provenance": {"a": 1}}}', '{"license": {"name": "free: own", "evidence": null}}', '{"license": {"name": "odd", "attribution_table": "[", "provenance": "{"}}', "no json", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, j string")
    got = sorted((r.row_key, r.rule, r.detail) for r in checks.licence_records(df, "t", "j", ["CC0 1.0"], "free:").collect())
    assert got == [("3", "shape", "license"), ("5", "shape", "license.evidence"), ("6", "shape", "license.attribution_table"), ("6", "shape", "license.provenance"), ("6", "vocabulary:license.name", "odd")]


def test_titles_by_their_use(spark):
    schema = "id string, editorial_title string, title string, url string, reading_metadata struct<editorial_title:string,translated_zh_title:string,title:string>, editorial_triage struct<zh_title:string,p_zh_title:string,p_review:struct<zh_title:string>,q_review:struct<zh_title:string>>"
    rows = [("1", " ", "own", "u", ("", "translated", "page"), (None, "early", ("",), ("second",))), ("2", None, None, "u", None, None), ("3", "**bold**", "own", "u", None, ("edited", None, None, None)), ("4", None, "own", "u", (None, None, "page"), None)]
    df = spark.createDataFrame(rows, schema)
    of = lambda chain, markdown=False: [r.v for r in df.orderBy("id").select(listings.first_title(listings.title_fields(chain, ["p", "q"]), markdown=markdown).alias("v")).collect()]
    assert of("record") == ["second", "u", "**bold**", "own"]
    assert of("relation", True) == ["translated", "u", "bold", "own"]
    assert of("translation") == ["translated", "", "**bold**", "page"]
    assert of("review") == ["second", "", "edited", ""]


def test_topic_counts_and_published_articles(spark):
    shown = spark.createDataFrame([("t", "tag", "a", True), ("s", "source", "x", True), ("none", "tag", "z", True), ("off", "tag", "a", False)], "slug string, type string, key string, published boolean")
    its = spark.createDataFrame([("1", "one", "featured-article", None, ["a", "a"], "x"), ("2", None, "small-news", None, None, "x"), ("3", "three", None, None, ["a"], None)], "id string, title string, kind string, time timestamp, tags array<string>, source_id string")
    assert sorted(tuple(r) for r in listings.topic_counts(shown, its).collect()) == [("none", 0, 0, 0, 0), ("s", 2, 1, 1, 0), ("t", 2, 1, 0, 1)]
    arts = spark.createDataFrame([("a", "published", "2024-01-01"), ("b", " published ", "2024-02-01"), ("c", "draft", "2024-03-01"), ("d", None, None), ("e", "published", None)], "id string, status string, updated_at string")
    assert [r.id for r in listings.published_articles(arts).collect()] == ["b", "a", "e"]


def test_code_among_paragraphs(spark):
    from quillmill.functions.text import is_code_like

    bracketed = "[" + ", ".join(f"{{a{i}: [1, 2]}}" for i in range(30)) + "]"
    texts = ["const a = load(x); b(); c();", "The outlet had a long history in the house of the river.", bracketed, "import a\n}) => {{\nvar b = 1", "let us go (now) and see (all) of the [long] list; it is = good", "short =>"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(is_code_like("t").alias("c")).collect()]
    assert got == [pages._code_like(t) for t in texts] == [True, False, True, True, True, False]
    html = f"<article><p>{bracketed}</p><p>{'A plain paragraph of the article. ' * 12}</p></article>"
    x = pages.article_text(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).first()
    assert "a1" not in x.article_text and x.article_text.startswith("A plain")
