"""Feed documents to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.dates import parse_any_date
from quillmill.functions.text import clean_text, let, text

_TEXT = "struct<_VALUE:string>"
RSS = """struct<channel:struct<item:array<struct<title:string,link:array<string>,guid:string,creator:string,`dc:creator`:string,author:string,pubDate:string,published:string,
updated:string,date:string,`dc:date`:string,encoded:string,`content:encoded`:string,description:string,summary:string,content:string,category:array<string>>>>>"""
RDF = """struct<item:array<struct<_about:string,`_rdf:about`:string,title:string,link:string,identifier:string,`dc:identifier`:string,`dc:creator`:string,creator:string,author:string,date:string,`dc:date`:string,pubDate:string,
description:string,summary:string,`content:encoded`:string,category:array<string>,`dc:subject`:array<string>>>>"""
ATOM = """struct<entry:array<struct<title:string,link:array<struct<_href:string,_rel:string,_VALUE:string>>,id:string,author:array<struct<name:string>>,published:string,updated:string,
date:string,summary:string,content:string,category:array<struct<_term:string,_VALUE:string>>>>>"""


def repair_xml(x: Column | str) -> Column:
    """A document from its root on, control characters as spaces, bare ampersands escaped, HTML within elements as plain text."""
    t = F.regexp_replace(text(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    start = F.regexp_instr(t, F.lit("<(rss|feed|rdf:RDF|RDF)[ >]"))
    t = F.when(start > 0, F.substring(t, start, F.length(t))).otherwise(t)
    return F.regexp_replace(t, r"&(?!#\d+;|#x[0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9_.:-]*;)", "&amp;")


def _first(*choices: Column) -> Column:
    return F.coalesce(*[let(c, lambda v: F.when(v != "", v)) for c in choices], F.lit(""))


def explode_feeds(docs: DataFrame, source_col: str = "source_id", xml_col: str = "xml") -> DataFrame:
    """(source_id, pos, title, url, guid, author, published_at, summary, tags) of feed documents in any of the three dialects.

    The root decides the dialect. Documents are repaired first; what can't be read even so gives no entries. Entries without address, guid and title are left out.
    """
    # each document is repaired once and read once, in the dialect of its root
    root = r"<(rss|feed|rdf:RDF|RDF)[ >]"
    staged = docs.select(F.col(source_col).alias("source_id"), let(repair_xml(xml_col), lambda x: F.struct(x.alias("xml"), F.regexp_extract(x, root, 1).alias("root"))).alias("__doc"))
    clean = lambda c: clean_text(c, "feed")
    none = F.array().cast("array<string>")
    tags = lambda c: F.filter(F.transform(F.coalesce(c, none), clean), lambda v: v != "")

    def entry(title: Column, url: Column, guid: Column, author: Column, date: Column, summary: Column, own_tags: Column) -> Column:
        return F.struct(
            _first(title, F.lit("(untitled)")).alias("title"), _first(url, guid).alias("url"), guid.alias("guid"), author.alias("author"),
            parse_any_date(date).cast("date").alias("published_at"), summary.alias("summary"), own_tags.alias("tags"),
        )

    def rss(i: Column) -> Column:
        links = F.filter(F.transform(F.coalesce(i["link"], none), clean), lambda v: v != "")
        return entry(
            clean(i["title"]), F.coalesce(F.get(links, F.lit(0)), F.lit("")), clean(i["guid"]), _first(*[clean(i[c]) for c in ("dc:creator", "creator", "author")]),
            _first(*[text(i[c]) for c in ("pubDate", "published", "updated", "date", "dc:date")]), _first(*[clean(i[c]) for c in ("content:encoded", "encoded", "description", "summary", "content")]), tags(i["category"]),
        )

    def rdf(i: Column) -> Column:
        return entry(
            clean(i["title"]), clean(i["link"]), _first(*[clean(i[c]) for c in ("dc:identifier", "identifier", "_rdf:about", "_about")]), _first(*[clean(i[c]) for c in ("dc:creator", "creator", "author")]),
            _first(*[text(i[c]) for c in ("dc:date", "date", "pubDate")]), _first(*[clean(i[c]) for c in ("description", "summary", "content:encoded")]), tags(i["category"]),
        )

    def atom(i: Column) -> Column:
        links = F.filter(F.coalesce(i["link"], F.array().cast("array<struct<_href:string,_rel:string,_VALUE:string>>")), lambda k: text(k["_href"]) != "")
        best = F.coalesce(F.get(F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(links, F.lit(0)))["_href"]
        terms = F.transform(F.coalesce(i["category"], F.array().cast("array<struct<_term:string,_VALUE:string>>")), lambda k: F.coalesce(k["_term"], k["_VALUE"]))
        return entry(clean(i["title"]), text(best), clean(i["id"]), clean(F.get(i["author"], F.lit(0))["name"]), _first(*[text(i[c]) for c in ("published", "updated", "date")]), _first(clean(i["summary"]), clean(i["content"])), tags(terms))

    options = {"mode": "PERMISSIVE", "ignoreNamespace": "false"}
    dialects = [(("rss",), RSS, lambda d: d["channel"]["item"], rss), (("rdf:RDF", "RDF"), RDF, lambda d: d["item"], rdf), (("feed",), ATOM, lambda d: d["entry"], atom)]
    read = lambda schema, of, make: F.transform(of(F.from_xml(F.col("__doc.xml"), schema, options)), make)
    entries = F.coalesce(*[F.when(F.col("__doc.root").isin(*roots), read(schema, of, make)) for roots, schema, of, make in dialects])
    out = staged.select("source_id", F.posexplode(entries).alias("pos", "e")).select("source_id", "pos", "e.*")
    return out.filter((F.col("url") != "") | (F.col("guid") != "") | (F.col("title") != "(untitled)"))
