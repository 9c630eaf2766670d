"""Address functions as Column expressions.

An address is split by the generic form of RFC 3986, whatever signs its path and query hold. With control characters, a
damaged escape in its path, or signs that no host has in its host, it cannot be parsed and gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Scheme, host with its user and port, path, query; each with what sets it apart.
GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"
PARTS = {"PROTOCOL": 1, "AUTHORITY": 2, "PATH": 3, "QUERY": 4}
DAMAGED = r"[\x00-\x1f\x7f]|^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*[\x20\\^`{|}%]|(?://[^/?#]*)?[^?#]*%(?![0-9A-Fa-f]{2}))"


def _part(url: Column, name: str) -> Column:
    """Null where there is none."""
    found = F.regexp_extract(url, GENERIC, PARTS[name])
    bare = {"AUTHORITY": F.substring(found, 3, 1 << 30), "QUERY": F.substring(found, 2, 1 << 30)}.get(name, found)
    return F.when(~url.rlike(DAMAGED) & (found != ""), bare)


def scheme(url: Column) -> Column:
    return _part(url, "PROTOCOL")


def host_port(url: Column) -> Column:
    """The host as written, with its port, without user information."""
    return F.regexp_replace(_part(url, "AUTHORITY"), "^.*@", "")


def host_name(url: Column) -> Column:
    return F.regexp_replace(host_port(url), ":[0-9]*$", "")


def path(url: Column) -> Column:
    return F.coalesce(_part(url, "PATH"), F.lit(""))


def request_uri(url: Column) -> Column:
    """What a robots rule is matched with: path and query."""
    query = _part(url, "QUERY")
    return F.concat(F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")), F.when(query.isNull(), "").otherwise(F.concat(F.lit("?"), query)))


def query_shape(url: Column) -> Column:
    """Host, path and the distinct parameter names in order: equal for one page with other values. Null without a query."""
    query = F.nullif(_part(url, "QUERY"), F.lit(""))
    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, "=.*$", "")), F.lit("")))
    return F.concat(host_port(url), path(url), F.lit("?"), F.array_join(F.array_sort(F.array_distinct(names)), "&"))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def site_of(url: Column) -> Column:
    """The site an http address belongs to."""
    return F.when(F.lower(url).rlike("^https?://"), without_www(F.lower(host_name(url))))


def normal_form(url: Column) -> Column:
    """For comparing addresses: no fragment, scheme, www. or closing slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^https?://(www\.)?", ""), "/$", "")


def same_site(host: Column, of: Column) -> Column:
    """Whether `host` belongs to the crawl of `of`: equal but for www., or below it."""
    base = without_www(of)
    return (host == of) | (host == F.concat(F.lit("www."), of)) | (F.concat(F.lit("www."), host) == of) | (host == base) | F.endswith(host, F.concat(F.lit("."), base))


def in_site(host: Column, site: str) -> Column:
    """The site filter of a query; an empty site takes all."""
    if not site:
        return F.lit(True)
    bare = without_www(host)
    return (bare == site) | F.endswith(bare, F.lit("." + site))


def wiki_address(article_path: Column, title: Column) -> Column:
    """Page address from a wiki's path template with $1; signs that wikis leave bare stay bare."""
    name = F.regexp_replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), r"\+", "%20")
    for sign in (":", "/", "(", ")", ",", "!", "'", ";", "@", "$", "*", "~"):
        name = F.replace(name, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.replace(article_path, F.lit("$1"), name)


def count_label(n: Column, most: int = 100) -> Column:
    return F.when(n >= most, f"{most}+").otherwise(n.cast("string"))
