"""URLs, stable identifiers, provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, single slashes, no slash at the end."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+$", "")
    u = F.regexp_replace(u, "#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    path = F.regexp_replace(F.regexp_replace(F.substring_index(rest, "?", 1), "/{2,}", "/"), "/$", "")
    query = F.when(rest.contains("?"), F.regexp_extract(rest, r"\?(.*)$", 1)).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(?:utm_[^=]*|ref|source|output)(?:=|$)"))
    query = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    return F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def domain(url: Column) -> Column:
    """The host with port, lower-cased, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def article_id(url: Column, title: Column) -> Column:
    """Fourteen hexadecimal digits from the canonical URL, or from the title where there is none."""
    key = canonical_url(url)
    return F.substring(F.sha1(F.when(key != "", key).otherwise(F.lower(F.coalesce(title, F.lit(""))))), 1, 14)


def event_id(seed: Column) -> Column:
    """A stable event identifier from cleaned text."""
    low = F.lower(seed)
    return F.concat(F.lit("evt-"), F.substring(F.sha1(F.when(low == "", F.lit("unknown-event")).otherwise(low)), 1, 12))


def wire_family(host: Column, source: Column, description: Column) -> Column:
    """The wire service that a row comes from, or empty."""
    host, source, text = F.lower(F.coalesce(host, F.lit(""))), F.lower(F.coalesce(source, F.lit(""))), F.substring(F.coalesce(description, F.lit("")), 1, 500)
    return (
        F.when(host.rlike(r"^(?:.*\.)?reuters\.com$") | (source == "reuters"), "wire:reuters")
        .when(host.rlike(r"^(?:.*\.)?apnews\.com$") | source.isin("ap", "associated press"), "wire:ap")
        .when(text.rlike(r"(?i)(?:^|[\s(—-])reuters(?:[\s),.:;—-]|$)"), "wire:reuters")
        .when(text.rlike(r"(?i)\bassociated press\b") | text.rlike(r"(?:^|[\s(—-])AP(?:[\s),.:;—-]|$)"), "wire:ap")
        .otherwise("")
    )


def source_group(host: Column, source: Column, url: Column, description: Column) -> Column:
    """Who stands behind a row: its wire service, else its outlet."""
    family = wire_family(host, source, description)
    some = lambda c: F.when(F.regexp_replace(c, r"(?U)^\s+|\s+$", "") != "", F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    outlet = F.lower(F.coalesce(some(host), some(source), canonical_url(url)))
    return F.when(family != "", family).otherwise(F.concat(F.lit("outlet:"), outlet))
