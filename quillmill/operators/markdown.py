"""Paragraphs of Markdown put in order, and candidates among its links."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import extract_links, let, strip, text

# What lines of lists and tables look like, and what opens and closes code.
LIST = r"^([-*+]|\d+[.)])\s"
TABLE = r"^\|.*\|$|^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"
FENCE = r"^(```|~~~)"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _clean(body: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), CONTROLS, " "), r"[ \t]+", " ")


def rewrite(body: str) -> str:
    """One text in plain Python, line by line; `rewritten` says the same in columns and is what records go through."""
    out: list[str] = []
    last, fenced = "", False
    for line in re.sub(r"[ \t]+", " ", re.sub(CONTROLS, " ", re.sub("\r\n?", "\n", body))).split("\n"):
        line = line.strip()
        fence, kind = re.match(FENCE, line) is not None, "list" if re.match(LIST, line) else "quote" if line.startswith(">") else "table" if re.match(TABLE, line) else "text"
        if not line:
            last = ""
            continue
        together = last != "" if fenced else not fence and kind == last and kind != "text"
        out += ["\n" if together else "\n\n", line]
        last = "text" if fence and fenced else "code" if fence or fenced else kind
        fenced = fenced != fence
    return "".join(out).strip()


def rewritten(body: Column) -> Column:
    """A text with one empty line between blocks; lines of one list, quote or table stay together, and so does all between fences of code but for empty lines. All in the JVM.

    The text is cut where lines of fences begin, so pieces in turn lie outside and within code: no state runs along the lines. In a piece, what comes before a line follows from it and the one
    before it alone, so runs need no numbers either; each line is joined with what precedes it.
    """
    # \x01, which no cleaned text has, begins every fence
    cut = lambda t: F.split(F.array_join(F.transform(F.split(t, "\n"), lambda x: let(strip(x), lambda y: F.when(y.rlike(FENCE), F.concat(F.lit("\x01"), y)).otherwise(y))), "\n"), "\x01")

    def kind(line: Column) -> Column:
        return F.when(line.rlike(f"(?U){LIST}"), "list").when(F.startswith(line, F.lit(">")), "quote").when(line.rlike(f"(?U){TABLE}"), "table")

    def told(pieces: Column) -> Column:
        def piece(p: Column, k: Column) -> Column:
            fenced = k % 2 == 1
            # the line end before the next fence ends the piece, so its last line is empty
            lines = let(F.split(p, "\n"), lambda a: F.when(k < F.size(pieces) - 1, F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a))

            def line(x: Column, i: Column, own: Column) -> Column:
                before = F.get(own, i - 1)
                closing = (k > 0) & ~fenced & (i == 0)
                open_end = F.endswith(F.get(pieces, k - 1), F.lit("\n\n"))
                after_fence = (k > 0) & ~fenced & (i == 1)
                outside = F.when(closing, ~open_end).when((i == 0) | after_fence | (before == ""), F.lit(False)).otherwise(F.coalesce(kind(before) == kind(x), F.lit(False)))
                together = F.when(fenced, (i > 0) & (before != "")).otherwise(outside)
                return F.when(x == "", "").otherwise(F.concat(F.when(together, "\n").otherwise("\n\n"), x))

            return let(lines, lambda own: F.array_join(F.transform(own, lambda x, i: line(x, i, own)), ""))

        return F.array_join(F.transform(pieces, piece), "")

    return strip(let(cut(_clean(body)), told))


def needs_rewrite(body: str) -> Column:
    """A text without any empty line and with five line ends or more."""
    t = F.regexp_replace(text(body), "\r\n?", "\n")
    return ~t.rlike(r"\n[ \t]*\n") & (F.regexp_count(t, F.lit(r"\n")) >= 5) & (strip(t) != "")


def normalize_paragraphs(records: DataFrame, body_col: str, chars_col: str | None = None) -> DataFrame:
    """records with body_col rewritten where it needs it, `changed` (whether that made a difference), and the count of characters brought up to date. One pass; null texts stay."""
    new = records.withColumn("__new", F.when(needs_rewrite(body_col), rewritten(F.col(body_col))).otherwise(F.col(body_col)))
    new = new.withColumn("changed", ~F.col("__new").eqNullSafe(F.col(body_col))).withColumn(body_col, F.col("__new")).drop("__new")
    return new.withColumn(chars_col, F.when(F.col("changed"), F.length(body_col)).otherwise(F.col(chars_col))) if chars_col else new


def changed_fields(before: DataFrame, after: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(field, n): in how many records each field changed."""
    b = before.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__b_{f}") for f in fields])
    j = after.join(b, F.col(key) == F.col("__key"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__b_{f}")), F.lit(f)) for f in fields]))
    return j.select(F.explode(changed).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def link_candidates(records: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, title, url, skip_reason) of the links of a text; pages that only list others are skipped with a reason."""
    rows = records.select(F.col(id_col).alias("id"), F.inline(extract_links(body_col)))
    path = F.lower(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)?", 1))
    reason = F.when(path.rlike(r"/(series|collection|category|categories|tag|tags|topics?)(/|$)"), "index page").when(path.rlike(r"/(author|authors|people|profile)(/|$)"), "author page").when(path.rlike("^/?$"), "front page")
    return rows.withColumn("skip_reason", reason)
