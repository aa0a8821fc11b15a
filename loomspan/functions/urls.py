"""Column functions on urls. Native expressions where Spark can express them, Arrow batches for joining and re-encoding."""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Defaults: query parameters that only follow a visitor, by name and by beginning.
TRACKING = ("fbclid", "gclid")
TRACKING_PREFIXES = ("utm_",)
_DEFAULT_PORT = {"http": 80, "https": 443}
_BAD = re.compile(r"[\x00-\x20\x7f]")


def _web(url: str | None):
    """The parts of a plain web address without user or control characters, else None."""
    if not url or _BAD.search(url):
        return None
    try:
        parts = urlsplit(url)
        parts.port  # noqa: B018  raises for a port that is no number
    except ValueError:
        return None
    if parts.scheme not in _DEFAULT_PORT or not parts.hostname or "@" in parts.netloc:
        return None
    return parts


def canonical(url: str | None, tracking=TRACKING, prefixes=TRACKING_PREFIXES) -> str | None:
    parts = _web(url)
    if parts is None:
        return None
    place = parts.hostname if parts.port in (None, _DEFAULT_PORT[parts.scheme]) else f"{parts.hostname}:{parts.port}"

    def follows(name: str) -> bool:
        low = name.lower()
        return low in tracking or low.startswith(tuple(prefixes))

    query = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not follows(k)]
    return urlunsplit((parts.scheme, place, parts.path or "/", urlencode(query), ""))


def canonical_url(tracking=TRACKING, prefixes=TRACKING_PREFIXES):
    """Column function: host in lower case, no default port, fragment or tracking parameters, at least the root path; null for what is no plain web address."""

    @F.pandas_udf(T.StringType())
    def f(url: pd.Series) -> pd.Series:
        return url.map(lambda u: canonical(u, tracking, prefixes))

    return f


def joined(base: str | None, link: str | None) -> str | None:
    if base is None or link is None:
        return None
    try:
        out = urldefrag(urljoin(base, link)).url
    except ValueError:
        return None
    return out if _web(out) else None


@F.pandas_udf(T.StringType())
def public_link(base: pd.Series, link: pd.Series) -> pd.Series:
    """The link against its base, without fragment; null unless it is a plain web address."""
    return pd.Series([joined(b, v) for b, v in zip(base, link)], dtype=object)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host in lower case; empty if there is none. User part and port are no part of it."""
    return F.lower(F.regexp_extract(F.regexp_replace(authority(url), "^[^@]*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """The port, or the scheme's own; null if it is no number up to 65535."""
    text = F.regexp_extract(authority(url), r":([^:\]@]*)$", 1)
    given = F.when(text.rlike("^[0-9]{1,5}$"), text.cast("int"))
    own = F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)
    number = F.when(text == "", own).otherwise(given)
    return F.when(number.between(0, 65535), number)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def plain_web(url: Column) -> Column:
    """Whether url is http or https with a host, no user part, no control character or blank."""
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != "") & ~F.contains(authority(url), F.lit("@")) & ~url.rlike(r"[\x00-\x20\x7F]"), F.lit(False))


def scope_permits(url: Column, hosts, ports=(80, 443)) -> Column:
    return plain_web(url) & host(url).isin(*hosts) & F.coalesce(port(url).isin(*ports), F.lit(False))


def reference_url(url: Column) -> Column:
    """url if it may be followed as a reference: a plain web address whose port, if it has one, is 1 to 65535."""
    return F.when(plain_web(url) & (F.coalesce(port(url), F.lit(0)) >= 1), F.regexp_replace(url, "#.*$", ""))


def image_url(base: Column, link: Column) -> Column:
    """The address of an image against its base; null if it is empty or no plain web address."""
    trimmed = F.trim(link)
    return F.when(trimmed != "", public_link(base, trimmed))


def origin(url: Column) -> Column:
    """scheme://host, and the port unless it is the scheme's own."""
    own = ((scheme(url) == "https") & (port(url) == 443)) | ((scheme(url) == "http") & (port(url) == 80))
    return F.when(plain_web(url) & port(url).isNotNull(), F.concat(scheme(url), F.lit("://"), host(url), F.when(own, "").otherwise(F.concat(F.lit(":"), port(url).cast("string")))))


def under_path(value: Column, prefix: Column) -> Column:
    """Whether a path is the prefix or lies below it, on the border of a segment."""
    base = F.regexp_replace(prefix, "/+$", "")
    return (value == prefix) | (value == base) | F.startswith(value, F.concat(base, F.lit("/")))


def safe_path(value: Column) -> Column:
    """Whether a path has no encoded slash or backslash, no encoded percent sign and no dot segment, encoded or not."""
    plain = F.try_url_decode(value)
    bad = value.rlike("(?i)%2f|%5c|%25") | F.contains(value, F.lit("\\")) | plain.rlike(r"(^|/)\.{1,2}(/|$)") | plain.isNull()
    return F.coalesce(~bad, F.lit(False))


def onion_name(name: str | None) -> bool:
    """Whether a host ends in a valid version 3 onion name: base 32 of key, checksum and version."""
    label = (name or "").lower().removesuffix(".onion").rpartition(".")[2]
    if not (name or "").lower().endswith(".onion") or not re.fullmatch("[a-z2-7]{56}", label):
        return False
    raw = base64.b32decode(label.upper())
    return raw[34] == 3 and hashlib.sha3_256(b".onion checksum" + raw[:32] + b"\x03").digest()[:2] == raw[32:34]


@F.pandas_udf(T.BooleanType())
def onion_host(name: pd.Series) -> pd.Series:
    return name.map(onion_name)


def route(name: Column, rules: dict[str, str], default: str) -> Column:
    """tor for onion hosts, else the route of the host's exact rule, else the default."""
    out = F.when(F.endswith(name, F.lit(".onion")), "tor")
    for h, r in rules.items():
        out = out.when(name == h, r)
    return out.otherwise(default)


def domain_kind(name: Column) -> Column:
    return F.when(F.endswith(F.lower(name), F.lit(".onion")), "onion").otherwise("open_web")


def redirect_target(base: Column, headers: Column) -> Column:
    """Where a response leads by its one Location header (headers: array of name, value), without fragment; null unless there is exactly one."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == "location")
    return F.when(F.size(found) == 1, public_link(base, F.get(found, F.lit(0))["value"]))


def cacheable(headers: Column) -> Column:
    """No no-store among all Cache-Control headers, and no Vary of *."""
    words = lambda name: F.flatten(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: F.split(F.lower(h["value"]), r"\s*,\s*")))
    return ~F.exists(words("cache-control"), lambda w: F.trim(w) == "no-store") & ~F.exists(words("vary"), lambda w: F.trim(w) == "*")


def kept_headers(headers: Column, names) -> Column:
    return F.filter(headers, lambda h: F.lower(h["name"]).isin(*names))
