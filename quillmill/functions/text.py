"""Text expressions. Each function takes and returns Columns, stays in the JVM, and gives null or empty text an empty result unless it says otherwise."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"一-鿿"
CJK_WIDE = r"㐀-鿿"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(_col(x).cast("string"), F.lit(""))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: The characters of Unicode's White_Space.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end; Spark's plain trim takes only spaces. Only the ends are read."""
    return F.btrim(x, F.lit(WHITE))


def blanks(x: Column, of: str) -> Column:
    """Each run of blanks (of: characters besides the space) as one space. A space alone is no match, so ordinary text stays as it is."""
    return let(x, lambda t: F.when(F.contains(t, F.lit("  ")) | t.rlike(f"[{of}]"), F.regexp_replace(t, f"[{of}][ {of}]*| [ {of}]+", " ")).otherwise(t))


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def fold(x: Column | str) -> Column:
    """Lower case for comparison, with the one common letter that folds to two."""
    return F.replace(F.lower(text(x)), F.lit("ß"), F.lit("ss"))


def clip(x: Column, limit: int | None) -> Column:
    """At most `limit` characters, then three dots."""
    if limit is None:
        return x
    return let(x, lambda t: F.when(F.length(t) > limit, F.concat(rstrip(F.substring(t, 1, limit)), F.lit("..."))).otherwise(t))


def unescape(x: Column | str) -> Column:
    """Character references decoded: the named ones of HTML 4 and all numeric ones. What isn't one stays."""
    # one literal, however often the expression is used
    names = F.from_json(F.lit(json.dumps({"apos": "'", **{k: chr(n) for k, n in name2codepoint.items()}})), "map<string,string>")

    def letter(name: Column) -> Column:
        digits = F.when(name.rlike(r"^#[xX][0-9A-Fa-f]{1,6}$"), F.substring(name, 3, 6)).when(name.rlike(r"^#[0-9]{1,7}$"), F.hex(F.substring(name, 2, 7).try_cast("long")))
        point = F.conv(digits, 16, 10).try_cast("long")
        good = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(F.startswith(name, F.lit("#")), F.when(good, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))).otherwise(F.try_element_at(names, name))

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#?[0-9A-Za-z]{1,31});", 1)
        return F.coalesce(let(name, lambda n: F.concat(letter(n), F.substring(part, F.length(n) + 2, F.length(part)))), F.concat(F.lit("&"), part))

    whole = lambda parts: F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)), "")
    return let(F.split(text(x), r"&(?=#?[0-9A-Za-z]{1,31};)"), whole)


def squeeze(x: Column, limit: int | None = None, returns: bool = True) -> Column:
    """Runs of blanks to one space, at most one empty line, nothing at the ends. returns: carriage returns count as blanks, else as line ends."""
    x = x if returns else F.regexp_replace(x, "\r\n?", "\n")
    x = blanks(x, r"\t\r\f\x0B" if returns else r"\t\f\x0B")
    return clip(strip(F.regexp_replace(x, "\n{3,}", "\n\n")), limit)


def clean_text(x: Column | str, mode: str = "plain", limit: int | None = None) -> Column:
    """Text without markup.

    plain: only white space is put in order. control: control characters become spaces too. feed: references decoded, scripts, styles and tags dropped, line
    breaks kept for <br> and </p>. page: as feed without these line breaks. block: as feed, with breaks after all block ends and without navigation parts.
    document: as plain, with carriage returns as line ends. markdown: references decoded, line ends trimmed, empty lines between blocks kept.
    """
    t = text(x)
    if mode in ("feed", "page", "block", "markdown"):
        t = unescape(t)
    if mode in ("control", "feed"):
        t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    if mode == "markdown":
        t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
        t = F.regexp_replace(blanks(t, r"\t"), " *\n *", "\n")
        return clip(strip(F.regexp_replace(t, "\n{3,}", "\n\n")), limit)
    if mode in ("feed", "page", "block"):
        dropped = "script|style|svg|noscript|iframe|form|nav|footer|header" if mode == "block" else "script|style"

        def untagged(t: Column) -> Column:
            t = F.regexp_replace(t, rf"(?is)<({dropped}).*?</\1>", " ")
            if mode != "page":
                t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
                t = F.regexp_replace(t, r"(?i)</(p|div|li|h[1-6]|blockquote|section|article)>" if mode == "block" else r"(?i)</p>", "\n")
            return F.regexp_replace(t, r"(?s)<[^>]+>", " ")

        # only a text with tags is read for them; runs of blanks and empty lines are gone after the last step, so nothing is left to squeeze
        t = let(t, lambda t: F.when(F.contains(t, F.lit("<")), untagged(t)).otherwise(t))
        return clip(strip(F.regexp_replace(blanks(t, r"\t\r\f\x0B"), r"(?U)\n\s+", "\n")), limit)
    return squeeze(t, limit, returns=mode != "document")


def strip_markdown(x: Column | str, limit: int | None = None) -> Column:
    t = clean_text(x, "document")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s+", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    t = F.regexp_replace(t, r"[*_`~]+", "")
    return clip(strip(F.regexp_replace(t, r"(?U)\s+", " ")), limit)


def slugify(x: Column | str, fallback: str = "page", limit: int = 64) -> Column:
    t = F.regexp_replace(fold(strip_markdown(x)), rf"(?U)[^\w{CJK_WIDE}]+", "-")
    ends = r"^[-_]+|[-_]+$"
    t = F.regexp_replace(F.regexp_replace(t, "-{2,}", "-"), ends, "")
    t = F.regexp_replace(F.substring(t, 1, limit), ends, "")
    return F.when(t == "", F.lit(fallback)).otherwise(t)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """The prefix and 16 hex digits of the SHA-1 of the parts, joined by two bars; a null part counts as empty."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(F.concat_ws("||", *[text(p) for p in parts])), 1, 16))


def split_list(x: Column | str) -> Column:
    """The entries of a list written with newlines or commas of either width."""
    return F.filter(F.transform(F.split(text(x), r"[\n,，]"), strip), lambda v: v != "")


def haystack(title: Column | str, summary: Column | str, source: Column | str, author: Column | str, tags: Column | str, url: Column | str) -> Column:
    return F.concat_ws("\n", text(title), text(summary), text(source), text(author), F.array_join(F.coalesce(_col(tags), F.array().cast("array<string>")), " "), text(url))


def match_terms(hay: Column, terms: Column | list[str]) -> Column:
    """Those terms, distinct and in order, that occur in folded text. Empty terms match nothing. A list is folded once, when the plan is made."""
    if isinstance(terms, Column):
        return F.array_distinct(F.filter(terms, lambda t: (strip(t) != "") & F.contains(hay, fold(strip(t)))))
    pairs = [(t, t.strip().casefold()) for t in dict.fromkeys(terms) if t.strip()]
    if not pairs:
        return F.array().cast("array<string>")
    known = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(f).alias("folded")) for t, f in pairs])
    return F.transform(F.filter(known, lambda p: F.contains(hay, p["folded"])), lambda p: p["term"])


def has_cjk(x: Column | str) -> Column:
    return text(x).rlike(f"[{CJK}]")


def mostly_english(x: Column | str) -> Column:
    letters, cjk = F.regexp_count(text(x), F.lit("[A-Za-z]")), F.regexp_count(text(x), F.lit(f"[{CJK}]"))
    return (letters >= 8) & (letters > cjk * 2)


def infer_language(x: Column | str) -> Column:
    """zh, ja, ko or en by script counts; empty where the text is short or undecided."""

    def judged(t: Column, words: Column) -> Column:
        cjk, kana, hangul = (F.regexp_count(t, F.lit(f"[{r}]")) for r in (CJK, r"぀-ヿ", r"가-힯"))
        latin = F.length(F.array_join(words, ""))
        letters = cjk + kana + hangul + latin
        return (
            F.when((F.length(t) < 80) | (letters == 0), "")
            .when((cjk / F.length(t) >= 0.18) | (cjk >= 80), "zh")
            .when((kana >= 30) & (kana >= cjk), "ja")
            .when(hangul >= 30, "ko")
            .when((F.size(words) >= 35) & (latin / letters >= 0.65), "en")
            .otherwise("")
        )

    return let(clean_text(x, "page"), lambda t: let(F.regexp_extract_all(t, F.lit(r"\b[A-Za-z]{3,}\b"), 0), lambda words: judged(t, words)))


def normalize_language(x: Column | str) -> Column:
    """A language tag in short form: zh-Hant, zh-Hans or the primary tag of the common languages; else the tag itself."""
    t = F.lower(F.replace(strip(text(x)), F.lit("_"), F.lit("-")))
    short = F.regexp_extract(t, "^([a-z]{2,3})(-|$)", 1)
    return (
        F.when(t == "", "")
        .when(t.rlike("^zh(-.*)?-(hant|tw|hk|mo)|^zh-(tw|hk|hant)"), "zh-Hant")
        .when(t.rlike("^zh(-.*)?-(hans|cn|sg)|^zh-(cn|sg|hans)"), "zh-Hans")
        .when(short != "", short)
        .otherwise(t)
    )


def split_sentences(x: Column | str, least: int = 0, limit: int | None = None) -> Column:
    """Sentences after CJK or Latin ends and at line ends, cleaned; those under `least` characters are dropped."""
    t = text(x)
    raw = F.when(has_cjk(t), F.split(t, r"(?<=[。！？!?])\s*|\n+")).otherwise(F.split(t, r"(?<=[.!?])\s+|\n+"))
    return F.filter(F.transform(raw, lambda s: squeeze(s, limit)), lambda s: (s != "") & (F.length(s) >= least))


def title_terms(x: Column | str) -> Column:
    t = text(x)
    cjk = F.filter(F.split(t, r"[，。！？、：:｜|\s／/（）()「」《》_-]+"), lambda s: F.length(s) >= 2)
    return F.when(has_cjk(t), cjk).otherwise(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z0-9-]{3,}"), 0), F.lower))


# What program code among prose is known by, in lower case.
CODE_WORDS = ("function(", "function (", "=>", "var ", "let ", "const ", "window.", "document.", "__next_data__", "webpack", "gtag(", "datalayer")
CODE_LINE = r"[{}();=<>]{2,}|^\s*(var|let|const|function|import|export)\b"


def is_code_like(x: Column | str) -> Column:
    """Whether text looks like program code: typical words with many symbols, many code-like lines, or dense brackets."""

    def judged(t: Column) -> Column:
        n = F.length(t)
        symbols = n - F.length(F.translate(t, "{}[]();=<>", ""))
        low = F.lower(t)
        words = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in CODE_WORDS])
        lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda s: s != "")
        code = F.filter(lines, lambda s: s.rlike(CODE_LINE))
        compact = F.regexp_replace(t, r"(?U)\s+", "")
        brackets = F.length(compact) - F.length(F.translate(compact, "{}[]:,", ""))
        return (n >= 20) & (
            (words & (((n < 120) & (symbols >= 5)) | (symbols >= F.greatest(F.lit(12), F.floor(n / 22)))))
            | ((F.size(lines) >= 3) & (F.size(code) >= 0.45 * F.size(lines)))
            | ((F.length(compact) >= 180) & (brackets >= 0.18 * F.length(compact)))
        )

    return let(clean_text(x, "page", 2400), judged)


# Fixed value: what pages say that only ask for scripts to be switched on.
PROMPT = r"(?is)please enable (?:js|javascript).{0,120}(?:disable|turn off).{0,80}ad blocker|enable javascript and cookies to continue|just a moment.{0,240}enable javascript"


def is_access_prompt(x: Column | str) -> Column:
    """Whether a text of at most 900 characters only asks for scripts to be switched on."""
    return let(clean_text(x, "page"), lambda t: (t != "") & (F.length(t) <= 900) & t.rlike(PROMPT))


def extract_identifiers(x: Column | str) -> Column:
    """urls (https, at most 40), dois and arxiv ids (at most 12 each), and the author named on a line of its own."""
    t = text(x)
    urls = F.transform(F.regexp_extract_all(t, F.lit(r"""(?i)https://[^\s<>{}\[\]"']+"""), 0), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}，。；：！？）】]+$", ""))
    dois = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"), 0), lambda d: F.regexp_replace(d, "[.,;:]+$", ""))
    arxiv = F.regexp_extract_all(t, F.lit(r"(?i)\b(?:arXiv\s*:\s*)?(\d{4}\.\d{4,5}(?:v\d+)?)\b"), 1)
    author = strip_markdown(F.regexp_extract(t, r"(?im)^\s*(?:authors?|作者)\s*[:：]\s*(.+?)\s*$", 1), 240)
    some = lambda a, n: F.slice(F.array_distinct(F.filter(a, lambda v: v != "")), 1, n)
    return F.struct(some(urls, 40).alias("urls"), some(dois, 12).alias("dois"), some(arxiv, 12).alias("arxiv_ids"), author.alias("author"))


def markdown_title(x: Column | str) -> Column:
    """(title, source): the first heading of the first level, else the first line of 4 to 320 characters."""
    lines = F.split(text(x), "\r\n?|\n")
    heading = F.filter(F.transform(lines, lambda s: F.regexp_extract(s, r"^\s{0,3}#\s+(.+?)\s*$", 1)), lambda s: s != "")
    plain = F.filter(F.transform(lines, lambda s: strip_markdown(s, 320)), lambda s: F.length(s).between(4, 320))
    return F.struct(
        F.coalesce(strip_markdown(F.get(heading, F.lit(0)), 320), F.lit("")).alias("heading"), F.coalesce(F.get(plain, F.lit(0)), F.lit("")).alias("line")
    )


def first_paragraph(x: Column | str, title: Column | str) -> Column:
    """The first block of 40 characters or more that is neither the title nor a bare address."""
    blocks = F.transform(F.split(text(x), r"\n\s*\n"), lambda b: strip_markdown(b, 1200))
    good = F.filter(blocks, lambda b: (F.length(b) >= 40) & (b != text(title)) & ~b.rlike(r"""(?i)^https://[^\s<>{}\[\]"']+$"""))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def extract_links(x: Column | str) -> Column:
    """The [title](address) pairs of a Markdown text, as structs."""
    t, pattern = text(x), F.lit(r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)")
    pairs = F.arrays_zip(F.regexp_extract_all(t, pattern, 1).alias("title"), F.regexp_extract_all(t, pattern, 2).alias("url"))
    return F.transform(pairs, lambda m: F.struct(strip(m["title"]).alias("title"), m["url"].alias("url")))


def length_drift_ok(before: Column | str, after: Column | str, most: float = 0.12) -> Column:
    """Whether a rewritten text has about as many letters and digits as before."""
    n, m = (F.regexp_count(text(c), F.lit(rf"[A-Za-z0-9{CJK_WIDE}]")) for c in (before, after))
    return F.abs(m - n) <= F.greatest(n, F.lit(1)) * most


def check_sections(body: Column | str, starts: Column, ends: Column) -> Column:
    """How many (start, end) marks both stand in the text, the end after the start; two or more make a valid division."""
    pairs = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    at = lambda mark: F.instr(text(body), mark)
    return F.size(F.filter(pairs, lambda p: (at(p["s"]) > 0) & (at(p["e"]) >= at(p["s"]))))
