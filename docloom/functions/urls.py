"""Address rules and names: which hosts may be fetched, document ids and titles from names."""

from __future__ import annotations

import ipaddress
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: IPv6 is open only inside this network; closed networks; openings inside the closed ones.
GLOBAL_V6 = "2000::/3"
CLOSED = (
    "0.0.0.0/8", "2001::/23", "3fff::/20", "100.64.0.0/10", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "2001:db8::/32", "2002::/16", "2001::/32",
)
OPEN = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
#: Private, loopback, link-local and multicast ranges, written out.
LOCAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "::1/128", "fe80::/10", "fc00::/7", "ff00::/8", "::/128")
LOCAL_SUFFIXES = (".local", ".internal", ".localhost", ".home.arpa")

_closed, _open, _local = ([ipaddress.ip_network(n) for n in group] for group in (CLOSED, OPEN, LOCAL))
_global = ipaddress.ip_network(GLOBAL_V6)


def address_allowed(address: str | None) -> bool:
    """Whether an address is public; an IPv4 address inside IPv6 is judged as IPv4, anything unreadable is not."""
    try:
        ip = ipaddress.ip_address(address or "")
    except ValueError:
        return False
    if ip.version == 6 and ip.scope_id:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    inside = lambda networks: any(ip.version == n.version and ip in n for n in networks)
    if inside(_local) or (ip.version == 6 and ip not in _global):
        return False
    return inside(_open) or not inside(_closed)


@F.pandas_udf(BooleanType())
def addresses_allowed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(address_allowed).astype(bool)


def host_allowed(host: Column) -> Column:
    """A plain ASCII name that is not a local one; trailing dots do not count."""
    bare = F.lower(F.regexp_replace(host, r"\.+$", ""))
    local = bare == "localhost"
    for suffix in LOCAL_SUFFIXES:
        local = local | F.endswith(bare, F.lit(suffix))
    return F.coalesce(bare.rlike(r"^[\x21-\x7E]+$") & ~local, F.lit(False))


def url_allowed(url: Column) -> Column:
    """http or https, no user in it, a host that is allowed. Addresses that a name resolves to are judged apart."""
    authority = F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)
    return F.coalesce((authority != "") & ~F.contains(authority, F.lit("@")) & host_allowed(F.regexp_replace(authority, r":[0-9]*$", "")), F.lit(False))


def slug(title: str | None) -> str:
    plain = unicodedata.normalize("NFKD", title or "").lower()
    letters = "".join(c if c.isascii() and c.isalnum() else " " for c in plain if not unicodedata.combining(c) and (c.isascii() or c.isspace()))
    return "-".join(letters.split()) or "document"


@F.pandas_udf(StringType())
def slugs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(slug)


def document_ids(titles: DataFrame) -> DataFrame:
    """Adds doc_id: the slug of the title, numbered -2, -3, .. among rows of one slug in the order of ``place``.

    A number that another title's own slug already has is not skipped here; a taken id shows up as a repeat of doc_id.
    """
    from pyspark.sql import Window

    named = titles.withColumn("_slug", slugs("title"))
    n = F.row_number().over(Window.partitionBy("_slug").orderBy("place"))
    return named.withColumn("_n", n).withColumn("doc_id", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), "_n"))).drop("_slug", "_n")


def slug_title(path: Column) -> Column:
    """The last segment of a path as a title: suffix dropped, dashes to spaces, words capitalised."""
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(html?|md)$", ""), "[-_]+", " ")))


def manifest_directories(url: Column) -> Column:
    """The directories from a page's own up to its host's root, nearest first."""
    origin = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)
    parts = F.filter(F.split(F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), "[^/]*$", ""), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat(origin, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n > 0, "/").otherwise("")))
