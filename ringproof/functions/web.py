"""Addresses and dates. An address is cut with one pattern, since a stricter parser refuses what a feed may hold."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Parameters that only track a visit.
TRACKING = r"(?i)^(utm_|at_|ocid|cmp|fbclid|gclid|ref$|src$)"
#: Written forms of a date beside ISO and mail dates.
DATE_FORMATS = ("d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-M-d", "MMMM d yyyy", "d MMMM, yyyy")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, ADDRESS, n)


def host_of(url: Column) -> Column:
    """Lower-case host, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(F.btrim(url), 2), "^.*@", ""), r":\d*$", ""))


def encode_query(value: Column) -> Column:
    """As form data, the characters that are left differ from the built-in's in two."""
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def encode_path(value: Column) -> Column:
    return F.replace(F.replace(encode_query(value), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking or blank parameters, the others encoded anew."""
    url = F.btrim(url)
    # A stray % stands for itself: a decoder would refuse the whole parameter.
    asked = F.regexp_replace(part(url, 4), "%(?![0-9A-Fa-f]{2})", "%25")
    pair = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v"))
    pairs = F.filter(F.transform(F.split(asked, "&"), pair), lambda p: (p["v"] != "") & ~p["k"].rlike(TRACKING))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(encode_query(p["k"]), F.lit("="), encode_query(p["v"]))), "&")
    return F.concat(
        F.when(part(url, 1) != "", F.concat(F.lower(part(url, 1)), F.lit(":"))).otherwise(F.lit("")),
        F.when(part(url, 2) != "", F.concat(F.lit("//"), F.lower(part(url, 2)))).otherwise(F.lit("")),
        part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def host_suffixes(host: Column) -> Column:
    """The host without a trailing dot and `www.`, and each of its parents: what a domain table is joined to."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^www\.", "")
    words = F.split(bare, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "."))


def parse_date(value: Column) -> Column:
    """A date in its own offset, or null: ISO, mail form, then the written forms."""
    value = F.btrim(value)
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}){0,2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"), F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"))
    mail = F.regexp_extract(value, r"^(?:[A-Za-z]{3,9},\s*)?(\d{1,2}\s+[A-Za-z]{3})[a-z]*\s+(\d{4})(?:\s+\d{1,2}:\d{2}.*)$", 0)
    day = F.regexp_extract(mail, r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})", 1)
    month, year = (F.regexp_extract(mail, r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})", i) for i in (2, 3))
    written = [F.try_to_date(F.initcap(value), f) for f in DATE_FORMATS]
    return F.coalesce(iso, F.when(mail != "", F.try_to_date(F.concat_ws(" ", day, F.initcap(month), year), "d MMM yyyy")), *written)
