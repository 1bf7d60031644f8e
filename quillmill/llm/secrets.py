"""Secret scans: Aho-Corasick keywords first, anchored regular expressions near hits, then checksums."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.base import pick, sha256_hex, slabs, table, through

BASE = ("assign", "access", "hex")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{32,}", re.ASCII)


def crc32_ok(token: str) -> bool:
    """The last six base-62 digits are the CRC-32 of what stands between the prefix and them."""
    body = token[token.index("_") + 1 :]
    n = 0
    for c in body[-6:]:
        n = n * 62 + _DIGITS.index(c)
    return n == zlib.crc32(body[:-6].encode())


def jwt_ok(token: str) -> bool:
    """The header decodes to a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def pem_ok(block: str) -> bool:
    """The body is base-64 that decodes to an ASN.1 sequence or an OpenSSH key."""
    body = "".join(re.sub(r"-----[A-Z ]+-----", "", block).split())
    try:
        data = base64.b64decode(body, validate=True)
    except (ValueError, binascii.Error):
        return False
    return data[:1] == b"\x30" or data.startswith(b"openssh-key-v1")


#: Kinds in the order of a tie: keywords in lower case, the expression anchored at a keyword's first character, and a test of the match.
KINDS: list[tuple[str, tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = [
    ("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), ASSIGN, lambda m: len(m[1]) >= 8),
    ("access", ("akia",), ACCESS, lambda m: len(m[0]) >= 16),
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc32_ok(m[0])),
    ("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc32_ok(m[0])),
    ("jwt", ("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), lambda m: jwt_ok(m[0])),
    ("pem", ("-----begin",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"), lambda m: pem_ok(m[0])),
]
ORDER = {k: i for i, k in enumerate([*BASE, *[k for k, *_ in KINDS if k not in BASE]])}
_LOWER = {i: i + 32 for i in range(65, 91)}


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.keywords = ahocorasick.Automaton()
        for i, (_, words, _, _) in enumerate(KINDS):
            for w in words:
                self.keywords.add_word(w, (len(w), i))
        self.keywords.make_automaton()

    def spans(self, text: str | None) -> list[tuple[int, str, int]]:
        """(start, kind, end) of every secret, by start, then kind. Matches of one kind don't overlap; one that fails its test still takes its place."""
        if not text:
            return []
        found, past = [], [0] * len(KINDS)
        hits = sorted((end - size + 1, i) for end, (size, i) in self.keywords.iter(text.translate(_LOWER)))
        for start, i in hits:
            if start < past[i]:
                continue
            kind, _, pattern, good = KINDS[i]
            if m := pattern.match(text, start):
                past[i] = m.end()
                if good(m):
                    found.append((start, kind, m.end()))
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[0], ORDER[s[1]]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join([f"{kind}:{start}:{end}" for start, kind, end in spans])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, secrets (array of kind, start, end in code points, end exclusive).

    Keywords found by one Aho-Corasick pass over the text in lower case (ASCII only) say where an expression is tried; runs of hex digits
    have no keyword and are found by their own expression. Kinds: assign, access, hex as the base; github and npm with a valid CRC-32,
    jwt with a decodable header, pem with a decodable body. Null and empty texts have no secrets. Rows with equal or null ids stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slabs(batches, "text"):
            spans = [[{"kind": k, "start": s, "end": e} for s, k, e in scanner.spans(x)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "secrets"])

    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each secret in the text replaced by [kind]; overlapping secrets become one, named by the first. Null texts stay null; all other columns and rows stay."""

    def start():  # noqa: ANN202
        scanner = Scanner()

        def masked(text: str | None) -> str | None:
            parts, at = [], 0
            for start, kind, end in scanner.spans(text):
                if start >= at:
                    parts += [text[at:start], f"[{kind}]"]
                at = max(at, end)
            return "".join([*parts, text[at:]]) if parts else text

        return lambda texts: (None, list(map(masked, texts)), [])

    return through(docs, text_col, start)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of scan() in the shape of the contract."""
    found = scan(table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["start"], s["kind"], s["end"]) for s in x] for x in batch.column("secrets").to_pylist()]
            base = [[s for s in x if s[1] in BASE] for x in spans]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([sha256_hex(joined(x).encode()) for x in base]), pa.array([joined(x) for x in spans])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return found.mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


QUERIES = {"op4_secrets": op4_secrets}
ORACLE_SQL: dict[str, str] = {}
