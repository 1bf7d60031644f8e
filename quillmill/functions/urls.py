"""Address expressions, by regular expressions only: Spark's own parser refuses addresses with spaces or other scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import fold, strip, text

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Query parameters that don't tell pages apart.
TRACKERS = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref")


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def parameter(query: Column, name: str) -> Column:
    """The first value of a query's parameter, decoded; empty if there is none."""
    found = F.filter(F.split(query, "&"), lambda p: F.startswith(p, F.lit(name + "=")))
    return F.coalesce(_decoded(F.substring(F.get(found, F.lit(0)), len(name) + 2, 1 << 30)), F.lit(""))


def unwrap_redirect(x: Column | str) -> Column:
    """The target of a search engine's redirect address; any other address as it is, trimmed."""
    url = strip(text(x))
    wrapped = F.lower(_part(url, 2)).isin("www.google.com", "google.com") & _part(url, 3).isin("/url", "/search")
    query = _part(url, 4)
    targets = [strip(parameter(query, k)) for k in ("url", "q")]
    return F.coalesce(*[F.when(wrapped & t.rlike("^https?://"), t) for t in targets], url)


def normalize_url(x: Column | str) -> Column:
    """An address for matching: redirects unwrapped, scheme and host in lower case, fragment, trackers and trailing slashes gone, parameters encoded alike.
    What is no address is folded."""
    url = unwrap_redirect(x)
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p.contains("=") | (p != ""))
    named = F.transform(pairs, lambda p: F.struct(_decoded(F.split(p, "=", 2)[0]).alias("k"), F.coalesce(_decoded(F.get(F.split(p, "=", 2), F.lit(1))), F.lit("")).alias("v")))
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).isin(*TRACKERS) & ~F.startswith(F.lower(p["k"]), F.lit("utm_")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    whole = F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), _part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(PARTS) & (_part(url, 2) != ""), F.regexp_replace(whole, "/+$", "")).otherwise(fold(url))


def loose_url_key(x: Column | str) -> Column:
    """An address without scheme, query, fragment and trailing slash, in lower case."""
    t = F.regexp_replace(F.lower(strip(text(x))), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), "/+$", "")


def host(x: Column | str) -> Column:
    return F.lower(_part(text(x), 2))


def path(x: Column | str) -> Column:
    return _part(text(x), 3)


def join_url(base: Column | str, link: Column | str) -> Column:
    """A link seen on a page as a full address: full links, links without scheme, from the root, and relative ones without dots."""
    base, link = text(base), strip(text(link))
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(_part(base, 1), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
