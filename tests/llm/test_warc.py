import base64
import gzip
import hashlib
import random
import re
from contextlib import contextmanager
from pathlib import Path

import pytest
from quillmill.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
TRAPS = ["\nWARC/1.", "\r\n\r\nWARC/1.1\r\n", FAKE, "\r\n\r\n" + FAKE, "\n" + FAKE * 3, "\r\n", "\nWARC/1", "WARC/1.1\r\nContent-Length: 9999999\r\n\r\n", "\r\n\r\n", "\n\nWARC/1.1\r\nContent-Length: 40\r\n\r\n", "é", "W"]


@contextmanager
def pieces_of(spark, size):
    """Files are read in pieces of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        yield
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def payloads(seed, n=40):
    r = random.Random(seed)
    return ["".join(r.choice(TRAPS) if r.random() < 0.5 else "x" * r.randrange(30) for _ in range(r.randrange(8))) for _ in range(n)]


def in_sequence(data):
    """Records one after another, as a plain reader finds them."""
    at = 0
    while at < len(data):
        head = data[at:].partition(b"\r\n\r\n")[0]
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        begin = at + len(head) + 4
        yield at, head, data[begin : begin + size]
        assert data[begin + size : begin + size + 4] == b"\r\n\r\n"
        at = begin + size + 4


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


@pytest.mark.parametrize("size", [97, 400, 100_000])
def test_round_trip_of_hostile_payloads(spark, tmp_path, size):
    texts = payloads(size, 12 if size < 100 else 30)
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/archive"
    warc.write_archives(pages, path)
    files = [x for x in Path(path).iterdir() if x.name.startswith("part")]
    plain = [x for f in files for x in in_sequence(f.read_bytes())]
    with pieces_of(spark, size):
        got = warc.read_archives(spark, path).collect()
        assert {x.whole for x in warc.archive_ends(spark, path).collect()} == {True}
    assert sorted((x.offset, x.header.encode()) for x in got) == sorted(x[:2] for x in plain)
    assert len(got) == len(texts)
    by_id = {x.record_id: x for x in got}
    for i, t in enumerate(texts):
        x = by_id[f"<urn:page:{i}>"]
        first = texts.index(t)
        assert x.target_uri == f"http://a/{i}%0D%0AX: y" and x.digest == "sha1:" + b32(t.encode())
        assert (x.record_type, x.refers_to) == (("response", None) if first == i else ("revisit", f"<urn:page:{first}>"))
        assert bytes(x.payload) == (t.encode() if first == i else b"")


def query(spark, tmp_path, rows, parts=3):
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string, file string").repartition(parts).write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op11_warc(spark, str(tmp_path))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted(map(str, map(tuple, out.collect())))


@pytest.mark.parametrize("sent", [True, False])
def test_query_on_ties_nulls_and_copies(spark, tmp_path, monkeypatch, sent):
    """Equal payloads, wholly equal rows, null ids, addresses and payloads; by the broadcast of what is shared and by a join."""
    monkeypatch.setattr(warc, "MOST_SENT", 1000 if sent else 0)
    texts = [*payloads(1), None, "", "é" * 5000]
    rows = [(i, f"u{i}", t, "d", None) for i, t in enumerate(texts)]
    rows += [(100 + i, "v", "the same", "d", "f") for i in range(60)] + [(70, "v", "the same", None, None)] * 3 + [(None, None, "the same", None, None)] * 2 + [(None, None, "alone", None, None), (5, "w", "new", "d", None)]
    rows += [(300, "r", "repeated", "d", None)] * 4

    def judged():
        groups = {}
        for i, u, t, *_ in rows:
            groups.setdefault(t or "", []).append((i is None, i or 0, u is None, u or "", i))
        for t, members in groups.items():
            data = t.encode()
            for k, m in enumerate(sorted(members, key=lambda m: m[:4])):
                first = min(members, key=lambda m: m[:4])[4]
                yield (m[4], len(data), b32(data), "revisit" if k else "response", first if k else None)

    assert query(spark, tmp_path, rows) == sorted(map(str, judged()))


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_least_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "a", "xy"), (3, "a", "xyz"), (4, "a", "xyz")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/w", least_bytes=3)
    assert sorted((x.record_id[10:-1], x.record_type) for x in warc.read_archives(spark, f"{tmp_path}/w").collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_other_archives_and_breaks(spark, tmp_path):
    """Gzipped members, version 1.0, blocks that are no HTTP; a wrong length ends a file's chain, a cut file loses its last record."""
    one = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\ncontent-length: 6\r\n\r\nab\xff\x00\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(one % i) for i in range(3)))
    (tmp_path / "b.warc").write_bytes(one % 3 + (one % 4).replace(b": 6", b": 5") + one % 5)
    (tmp_path / "c.warc").write_bytes((one % 6 + one % 7)[:-7])
    (tmp_path / "d.warc").write_bytes(b"no archive at all")
    (tmp_path / "e.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(x.record_id for x in got) == [f"<urn:x:{i}>" for i in (0, 1, 2, 3, 6)]
    assert {(x.record_type, bytes(x.payload), x.http) for x in got} == {("resource", b"ab\xff\x00\r\n", "")}
    assert {Path(x.file).name[0]: x.whole for x in warc.archive_ends(spark, str(tmp_path)).collect()} == {"a": True, "b": False, "c": False, "d": False}
