"""URL and name keys in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that only say where a visitor came from.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "fbclid", "gclid", "msclkid", "dclid", "yclid", "twclid", "ttclid", "igshid",
    "wbraid", "gbraid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "ref_src", "referrer",
)
#: Files that stand for their directory.
INDEX_FILES = ("index.html", "index.htm", "index.php", "default.aspx", "default.asp")
#: Last path parts that are seldom an entry's own page.
LOW_VALUE = (
    "faq", "faqs", "about", "about-us", "contact", "contact-us", "apply", "application",
    "register", "registration", "signup", "sign-up", "login", "signin", "sign-in",
    "news", "blog", "privacy", "terms", "sitemap", "search", "donate", "support",
)
#: Second labels that belong to a public suffix.
SECOND_LEVEL = ("edu", "ac", "co", "com", "org", "net", "gov", "govt", "sch")


def weak(url: Column) -> Column:
    """Trimmed, without trailing slashes, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", ""))


def bare(url: Column) -> Column:
    """weak() without scheme and www."""
    return F.regexp_replace(F.regexp_replace(weak(url), "^https?://", ""), r"^www\.", "")


def with_scheme(url: Column) -> Column:
    t = F.trim(F.coalesce(url, F.lit("")))
    return F.when(t == "", "").when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))


def host(url: Column) -> Column:
    """Lower case, without user, port and www."""
    return _host(with_scheme(url))


def _host(whole: Column) -> Column:
    raw = F.lower(F.regexp_extract(whole, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(raw, r"^www\.", "")


def path(url: Column) -> Column:
    """Path in its own case, without empty parts, an index file at its end and trailing slashes; the root is `/`."""
    return _path(with_scheme(url))


def _path(whole: Column) -> Column:
    raw = F.regexp_extract(whole, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(raw, "/"), lambda p: p != "")
    indexed = F.lower(F.get(parts, F.size(parts) - 1)).isin(*INDEX_FILES)
    kept = F.when(F.coalesce(indexed, F.lit(False)), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(whole == "", "").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    """Form encoding in which `~` stands for itself and `*` does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query(url: Column) -> Column:
    """Parameters that do not track, decoded, sorted by name and value, and encoded alike."""
    return _query(with_scheme(url))


def _query(whole: Column) -> Column:
    raw = F.regexp_extract(whole, r"^[^?#]*\?([^#]*)", 1)
    pair = lambda p: F.struct(_decoded(F.regexp_extract(p, "^[^=]*", 0)).alias("name"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value"))
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(*TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")


def match_key(url: Column) -> Column:
    """Host, path and query in lower case; empty without a host."""
    whole = with_scheme(url)
    return _match_key(_host(whole), _path(whole), _query(whole))


def _match_key(host_: Column, path_: Column, query_: Column) -> Column:
    q = F.lower(query_)
    key = F.concat(host_, F.regexp_replace(F.lower(path_), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(host_ == "", "").otherwise(key)


def parsed(rows: DataFrame, url: str) -> DataFrame:
    """rows with host, path, query, match_key and domain of a URL, each part worked out once for all that need it."""
    parts = rows.withColumn("_whole", with_scheme(F.col(url))).withColumns({"host": _host(F.col("_whole")), "path": _path(F.col("_whole")), "query": _query(F.col("_whole"))}).drop("_whole")
    return parts.withColumns({"match_key": _match_key(F.col("host"), F.col("path"), F.col("query")), "domain": registrable(F.col("host"))})


def registrable(host_: Column) -> Column:
    """The last two labels of a host; three where a country code follows a common second level."""
    parts = F.filter(F.split(host_, r"\."), lambda p: p != "")
    n = F.size(parts)
    deep = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    k = F.when(deep, 3).otherwise(2)
    return F.when(n <= k, F.array_join(parts, ".")).otherwise(F.array_join(F.slice(parts, n - k + 1, k), "."))


def low_value(url: Column) -> Column:
    return F.lower(F.element_at(F.split(path(url), "/"), -1)).isin(*LOW_VALUE)


#: Fixed value: the note on such a URL.
LOW_VALUE_NOTE = "submitted URL is a sub-page (faq/about/apply/etc), not the opportunity's main page"


def quality_flags(url: Column) -> Column:
    """Notes for a reviewer; no ground to refuse a row."""
    return F.when(low_value(url), F.array(F.lit(LOW_VALUE_NOTE))).otherwise(F.array().cast("array<string>"))


def is_prefix(a: Column, b: Column) -> Column:
    """One path lies under the other; the root is no prefix."""
    a, b = (F.regexp_replace(F.lower(x), "/+$", "") for x in (a, b))
    return ((a != "") & b.startswith(F.concat(a, F.lit("/")))) | ((b != "") & a.startswith(F.concat(b, F.lit("/"))))


def name_key(name: Column) -> Column:
    """Lower case without years, other characters as single spaces."""
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\b(19|20)\d\d\b", " ")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
