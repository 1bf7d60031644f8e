"""WARC archives: pages written as records, and records read back by the chain of their boundaries."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.base import beside, forget, pick, shared_dir, stored, table

#: Fixed values of the format.
VERSION = "WARC/1.1"
MAGIC = "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Every record but a file's first follows a line end. A line that begins like this can't stand in a header, and no end of the mark is its beginning.
MARK = "\n" + MAGIC
#: Digits of the JVM's base 32, and those of the archives'.
DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Payloads that others equal: up to so many, each as 48 bytes, are sent to every task that writes.
MOST_SENT = 200_000


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of some bytes in base 32: eight times 20 bits of the hexadecimal form, as four digits each."""
    pieces = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*pieces), *DIGITS)


def _record(kind: str, block: Column, *fields: Column) -> Column:
    """A record without its end. concat_ws leaves out fields that are null."""
    head = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), *fields, F.concat(F.lit("Content-Length: "), F.octet_length(block))]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(END), block)


def _http(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page.cast("string")), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record for each page, in as many files as pages has partitions. Of pages with equal payloads of at least least_bytes the one with the smallest id (ties by the address; nulls last) is
    a response, the others revisit it: they carry its record's name, the digest, and in their HTTP head the payload's length. Of wholly equal rows one counts as the first.

    A null payload is an empty one; strings go as UTF-8, binary columns as they are. Null ids and addresses are left empty; line ends in addresses are escaped. An empty
    table makes a folder without records. Other columns, whatever their names, are not read.

    Files come from Spark's text writer, whose separator of lines is the end of a record; so tasks can be repeated, and any file system will do. Payloads stay where they are: only
    digests are grouped, and what to do with a payload that others equal is sent to all tasks, or joined where it is too much for that.
    """
    rows = pick(pages, id=id_col, url=url_col, payload=payload_col).select("id", "url", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    sized = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    key = F.sha1(F.to_json(F.struct("id", "url", "digest")).cast("binary"))
    counted = stored(sized.filter(F.col("bytes") >= least_bytes).groupBy("digest", "id", "url", "bytes").agg(F.count(F.lit(1)).alias("copies")), "payloads")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    group = F.struct(F.min(place).alias("first"), F.sum("copies").alias("rows"))
    shared = beside(counted, "digest", group, "group").filter("group.rows > 1").withColumn("is_first", F.col("group.first").eqNullSafe(place))
    extra = stored(shared.select("digest", "id", "url", "bytes", "copies", "is_first", F.col("group.first.id").alias("first_id"), key.alias("key")), "shared-payloads")
    held = extra.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("is_first"), F.col("copies"))), F.lit(0)).alias("most")).first()

    def fields(*more: Column) -> list[Column]:
        address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
        said = [("WARC-Record-ID: ", _urn(F.col("id"))), ("WARC-Date: ", F.lit(date)), ("WARC-Target-URI: ", address), ("WARC-Payload-Digest: sha1:", F.col("digest"))]
        return [F.concat(F.lit(k), v) for k, v in said] + [F.lit("Content-Type: application/http;msgtype=response"), *more]

    alone = sized
    if held.n:
        told = extra.select("key", "is_first", "copies")
        known = sized.withColumn("key", key).join(F.broadcast(told) if held.n <= MOST_SENT else told, "key", "left")
        alone = known.filter(F.col("is_first").isNull() | (F.col("is_first") & (F.col("copies") == 1))).drop("key", "is_first", "copies")
        if held.most > 1:
            again = known.filter(F.col("is_first") & (F.col("copies") > 1)).groupBy("id", "url", "digest", "bytes").agg(F.first("payload").alias("payload"))
            alone = alone.unionByName(again)
    response = _record("response", F.concat(_http(F.col("bytes")), F.col("payload").cast("string")), *fields())
    others = F.col("copies") - F.col("is_first").cast("long")
    revisits = extra.withColumn("n", others).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    pointer = [F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("first_id"))), F.lit(f"WARC-Profile: {PROFILE}")]
    revisit = _record("revisit", _http(F.col("bytes")), *fields(*pointer))
    records = alone.select(response.alias("value"))
    records = records.unionByName(revisits.select(revisit.alias("value"))) if held.n else records
    records.write.text(path, lineSep=END)
    forget(counted)
    forget(extra)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The text between marks, in order within each piece of a file that one task reads; head: bytes of its header, if it is a record; size: the bytes of that record's block."""
    text = spark.read.schema("value string").text(path, lineSep=MARK)
    read = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    header = F.substring_index("value", END, 1)
    begins = F.when((F.col("block") == 0) & F.col("value").startswith(MAGIC), F.substring("value", len(MAGIC) + 1, 3)).otherwise(F.substring("value", 1, 3))
    is_record = begins.rlike("^[01]\r\n") & (F.octet_length(header) < F.octet_length("value"))
    size = F.regexp_extract(header, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1)
    return read.withColumn("head", F.when(is_record, F.octet_length(header))).withColumn("size", F.when(is_record, F.nullif(size, F.lit("")).cast("long")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[pa.RecordBatch]]]:
    """Rows of one file and block, which stand together."""
    now, held = None, []
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if keys[at] != now:
                if held:
                    yield (*now, held)
                now, held = keys[at], []
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield (*now, held)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, by offsets from the piece's first byte that it owns: where its record starts, and where the chain of successors from it leaves the piece (null: it breaks)."""
    for file, block, rows in _pieces(batches):
        length, head, size = (np.concatenate([np.asarray(b.column(c).fill_null(-1), np.int64) for b in rows]) for c in ("length", "head", "size"))
        span = length + len(MARK)
        content = np.cumsum(span) - span
        start = content - len(MAGIC)
        if block == 0:
            start[0] = 0
        after = np.where(size >= 0, content + head + size + 2 * len(END), -1)
        to = np.minimum(np.searchsorted(start, after), len(start) - 1)
        to = np.where(start[to] == after, to, np.arange(len(start)))
        while (to[to] != to).any():
            to = to[to]
        # within the piece a chain can only go on at a mark; its last byte may be the file's
        leaves = after[to]
        broken = leaves < content[-1] + length[-1]
        n = len(start)
        arrays = [pa.array([file] * n), pa.array(np.full(n, block)), pa.array(start), pa.array(leaves, mask=broken), pa.array(span)]
        yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "start", "leaves", "span"])


def _chains(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a task must know of each piece it reads, and how far the chain of each file goes.

    Tasks emit candidate records, each with the place where the chain of successors from it leaves the piece. Of those only the ones matter at which a chain from another piece may
    arrive. Over these, pointer jumping starts at the beginning of each file: each round adds what the places reached so far jump to, and doubles the jumps; a file of n
    pieces takes log n rounds. What is not reached lies within a payload, or after a break.
    """
    small = chunks.select("file", "block", F.octet_length("value").cast("long").alias("length"), F.col("head").cast("long").alias("head"), "size")
    found = stored(small.mapInArrow(_candidates, "file string, block long, start long, leaves long, span long"), "candidates")
    order = Window.partitionBy("file").orderBy("block")
    bytes_of = found.groupBy("file", "block").agg(F.sum("span").alias("bytes"))
    pieces = stored(bytes_of.withColumn("base", F.sum("bytes").over(order) - F.col("bytes")), "pieces")
    # the last chunk has no mark after it
    ends = pieces.groupBy("file").agg((F.max(F.col("base") + F.col("bytes")) - len(MARK)).alias("at"))
    edges = found.join(pieces, ["file", "block"]).selectExpr("file", "block", "start", "base + start as at", "base + leaves as to")
    begins = pieces.select("file", F.lit(0).cast("long").alias("at")).distinct()
    arrivals = edges.filter("to is not null").selectExpr("file", "to as at").unionByName(begins).distinct()
    nodes = stored(edges.join(arrivals, ["file", "at"]), "arrivals")
    jumps, reached, n = stored(nodes.filter("to is not null").select("file", "at", "to"), "jumps"), stored(begins, "reached"), 0
    while n != (now := reached.count()):
        n = now
        more = reached.join(jumps, ["file", "at"]).selectExpr("file", "to as at")
        wider = stored(reached.unionByName(more).distinct(), "reached")
        twice = stored(jumps.join(jumps.selectExpr("file", "at as to", "to as then"), ["file", "to"]).selectExpr("file", "at", "then as to"), "jumps")
        forget(reached)
        forget(jumps)
        reached, jumps = wider, twice
    sound = nodes.select("file", "at").unionByName(ends).join(reached, ["file", "at"]).distinct()
    entry = nodes.join(reached, ["file", "at"]).join(sound.selectExpr("file", "at as to", "true as sound"), ["file", "to"], "left")
    closed = ends.join(reached, ["file", "at"]).selectExpr("file", "at as closing")
    told = pieces.join(entry.selectExpr("file", "block", "start as entry", "at as lead", "sound"), ["file", "block"], "left").join(closed, "file", "left")
    ahead = F.first("lead", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    known = stored(told.select("file", "block", "base", "entry", F.coalesce(ahead, "closing").alias("lead"), F.coalesce("sound", F.lit(False)).alias("sound")), "chains")
    whole = stored(ends.join(closed, "file", "left").selectExpr("file", "at as bytes", "closing is not null as whole"), "ends")
    for df in (found, pieces, nodes, reached, jumps):
        forget(df)
    return known, whole


def _cut(file: str, offset: int, data: bytes, head: int, size: int) -> tuple:
    """A record from the text between its own mark and the next."""
    header = data[:head].decode("utf-8", "replace")
    block = data[head + len(END) : head + len(END) + size]
    ends = block.find(END.encode()) if re.search(r"(?i)\r\nContent-Type:[ \t]*application/http", header) else -1
    return file, offset, header if header.startswith(MAGIC) else MAGIC + header, block, ends + len(END) if ends >= 0 else 0


def _walk(rows: list[pa.RecordBatch], block: int) -> Iterator[tuple]:
    """Follows the chain through one piece. (True, offset, data, head, size) is a record; (False, place where its record ends, offset, data, head, size) a part of one that lies in several pieces; what
    is in it before the chain's entry belongs to such a record too."""
    base, entry, lead, sound = (rows[0].column(c)[0].as_py() for c in ("base", "entry", "lead", "sound"))
    content, held, want, after, stop = 0, [], entry, 0, 0
    for batch in rows:
        for value, head, size in zip(*(batch.column(c) for c in ("value", "head", "size")), strict=True):
            value, start = value.as_py(), 0 if block == 0 and not content else content - len(MAGIC)
            stop = content + len(value)
            if held:
                held.append((content, value))
            elif want is None or start < want:
                if lead is not None:
                    yield False, lead, base + content, value, None, None
            elif start > want or size.as_py() is None:
                return
            else:
                held, (begin, length, inner) = [(content, value)], (start, head.as_py(), size.as_py())
                after = content + length + inner + 2 * len(END)
            if held and after <= stop + 1:
                if after == stop + 1:
                    yield True, base + begin, MARK.encode().join(v for _, v in held), length, inner
                    held, want = [], after
                elif after < stop or not sound:
                    return
            content = stop + len(MARK)
    if held and sound:
        if after == stop:
            yield True, base + begin, MARK.encode().join(v for _, v in held), length, inner
        else:
            for k, (at, value) in enumerate(held):
                yield False, base + after, base + at, value, None if k else length, None if k else inner


RECORD = "file string, offset long, header string, block binary, skip long"
PART = "file string, lead long, at long, value binary, head long, size long"


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(col, kinds[k]) for col, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _records(whole: bool, batch_bytes: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for file, block, rows in _pieces(batches):
            for is_whole, *rest in _walk(rows, block):
                if is_whole == whole:
                    out.append(_cut(file, *rest) if whole else (file, *rest))
                    held += len(out[-1][3])
                if held > batch_bytes:
                    yield _batch(out, RECORD if whole else PART)
                    out, held = [], 0
        if out:
            yield _batch(out, RECORD if whole else PART)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            if x["head"] is not None:
                offset = x["at"] - len(MAGIC) if x["at"] else 0
                yield _batch([_cut(x["file"], offset, x["value"], x["head"], x["size"])], RECORD)


def _field(name: str) -> Column:
    """A field of the header; null where there is none."""
    return F.nullif(F.regexp_extract("header", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1), F.lit(""))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, from any writer, gzipped or plain: file, offset (of the plain bytes), record_type, record_id, target_uri, refers_to, digest (as said in the header), header, http
    (the head of an HTTP message, if the block is one), payload (the block, or what follows that head).

    Files are read in pieces between marks by Spark's text reader, so one archive goes to many tasks. A record counts if the chain of record ends reaches it from its file's start and a mark or the end
    of the file stands where it ends itself: a payload may hold marks, whole records too. After a break (a wrong length, a cut file) nothing of that file
    counts; see archive_ends. Files without records, empty ones among them, and an empty folder give no rows.

    What tasks must know of the pieces is about 50 bytes for each, whatever it holds, and is sent to all. Only records that lie in several pieces are shuffled.
    """
    chunks = _chunks(spark, path)
    chains, _ends = _chains(chunks)
    forget(_ends)
    pieces, seed = chains.count(), 0
    while chains.select(F.xxhash64(F.lit(seed), "file", "block").alias("k")).distinct().count() < pieces:
        seed += 1
    key = F.xxhash64(F.lit(seed), "file", "block").alias("piece")
    told = chunks.withColumn("value", F.col("value").cast("binary")).withColumn("piece", key).join(F.broadcast(chains.select(key, "base", "entry", "lead", "sound")), "piece")
    records = told.mapInArrow(_records(True), RECORD)
    # a record goes on in the next piece where that has chunks before the chain's entry, or no entry
    first = F.when(F.col("block") == 0, 0).otherwise(-len(MAGIC))
    if chains.filter(F.col("lead").isNotNull() & (F.col("entry").isNull() | (F.col("entry") != first))).limit(1).count():
        parts = told.mapInArrow(_records(False), PART).groupBy("file", "lead")
        whole = parts.agg(F.sort_array(F.collect_list(F.struct("at", F.col("value").cast("string").alias("value"), "head", "size"))).alias("parts"))
        text = F.array_join(F.transform("parts", lambda x: x["value"]), MARK).cast("binary")
        one = F.col("parts")[0]
        joined = whole.select("file", one["at"].alias("at"), text.alias("value"), one["head"].alias("head"), one["size"].alias("size"))
        records = records.unionByName(joined.mapInArrow(_joined, RECORD))
    return records.select(
        "file",
        "offset",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("target_uri"),
        _field("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest").alias("digest"),
        "header",
        F.substring("block", F.lit(1), F.col("skip").cast("int")).cast("string").alias("http"),
        F.substring("block", F.col("skip").cast("int") + 1, F.octet_length("block")).alias("payload"),
    )


def archive_ends(spark: SparkSession, path: str) -> DataFrame:
    """For each file below path that is not empty: its plain bytes, and whether the chain of its records reaches its end."""
    chains, ends = _chains(_chunks(spark, path))
    forget(chains)
    return ends


def _page(urn: Column) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit("")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as records and reads them back. Digest and length of a response are those of the payload that was read, of a revisit what its record says of the full one."""
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    is_revisit = F.col("record_type") == "revisit"
    length = F.regexp_extract("http", r"(?i)\r\nContent-Length:[ \t]*([0-9]+)", 1).cast("long")
    return read_archives(spark, path).select(
        _page(F.col("record_id")).cast("long").alias("page_id"),
        F.when(is_revisit, length).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(is_revisit, F.regexp_replace("digest", "^sha1:", "")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type",
        _page(F.col("refers_to")).cast("long").alias("refers_to"),
    )


def _sql() -> str:
    digit = lambda k, shift: f"substr('{DIGITS[1]}', ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    base32 = " || ".join(digit(k, shift) for k in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH told AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
placed AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM told)
SELECT page_id, payload_bytes, {base32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM placed"""


QUERIES = {"op11_warc": op11_warc}
#: Page ids are unique in the given tables; ties are in tests/llm/test_warc.py.
ORACLE_SQL = {"op11_warc": _sql()}
