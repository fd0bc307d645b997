"""URL expressions: parts, policies and canonical forms, all inside the JVM but for percent escapes."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that do not tell pages apart (fixed values).
NOISE_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_src", "ref_url", "page"]
#: Query parameters that carry sessions (fixed values).
SESSION_PARAMETERS = ["state", "session", "token", "sid", "phpsessid"]
#: Hosts that are never fetched, besides private addresses (fixed values).
INTERNAL_HOSTS = ["localhost", "metadata.google.internal", "169.254.169.254", "metadata"]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    """Everything between // and the path, query or fragment, as it stands."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def home(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def is_http(url: Column) -> Column:
    return url.rlike("(?i)^https?:")


def host(name: Column) -> Column:
    """A host without blanks around it, port, a leading www., and case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r":.*$", ""), r"^www\.", "")


def domain(url: Column) -> Column:
    return host(netloc(url))


def in_domains(name: Column, domains: list[str], subdomains: bool) -> Column:
    """Whether a host is one of a few configured domains, or below one."""
    found = name.isin(domains)
    for d in domains if subdomains else []:
        found = found | name.endswith(f".{d}")
    return found


def matches_any(url: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | url.rlike(p)
    return found


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | value.startswith(p)
    return found


def looks_like_session(url: Column, longest: int = 2000) -> Column:
    """Too long, or with a parameter that carries a session."""
    return (F.length(url) > longest) | url.rlike(rf"(?i)[?&]({'|'.join(SESSION_PARAMETERS)})=")


def skip_by_rules(url: Column, pattern: str = "", longest: int = 200) -> Column:
    """Too long once normalised, with a state parameter, or matching the skip pattern in URL or path."""
    skip = (F.length(without_fragment(url)) > longest) | query(url).rlike(r"(^|&)state(=|&|$)")
    return skip | url.rlike(pattern) | path(url).rlike(pattern) if pattern else skip


def _pairs(text: Column) -> Column:
    return F.filter(F.split(text, "&"), lambda p: p != "")


def _name(pair: Column) -> Column:
    return F.lower(F.element_at(F.split(pair, "=", 2), 1))


def canonical(url: Column) -> Column:
    """The key by which pages are the same: no noise parameters, the rest sorted; scheme and host in lower case; no slash at the
    end; no fragment and no path parameters. URLs with percent escapes or plus signs are re-encoded by canonical_escaped()."""
    kept = F.array_sort(F.transform(F.filter(_pairs(query(url)), lambda p: ~_name(p).isin(NOISE_PARAMETERS)), lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    bare = F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "/+$", "")
    s = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    q = F.array_join(kept, "&")
    return F.concat(s, F.lit("://"), F.lower(netloc(url)), F.when(bare == "", "/").otherwise(bare), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


@F.pandas_udf(T.StringType())
def canonical_escaped(urls: pd.Series) -> pd.Series:
    """canonical() for URLs with escapes in their query: decoded, sorted by decoded name and value, and encoded again."""

    def one(url: str | None) -> str | None:
        if url is None:
            return None
        try:
            parts = urlsplit(url)
        except ValueError:
            return url
        kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in NOISE_PARAMETERS)
        bare = re.sub(";[^/]*$", "", parts.path).rstrip("/") or "/"
        encoded = urlencode(kept)
        return f"{(parts.scheme or 'https').lower()}://{parts.netloc.lower()}{bare}{'?' + encoded if encoded else ''}"

    return urls.map(one)


def page_key(url: Column) -> Column:
    """canonical() inside the JVM for most URLs; Python gets only those that need their escapes undone, and nulls for the rest."""
    escaped = query(url).rlike(r"[%+]|[^\x21-\x7E]")
    return F.when(escaped, canonical_escaped(F.when(escaped, url))).otherwise(canonical(url))


def request_key(url: Column, tracking_prefixes: list[str] = ["utm_"], tracking: list[str] = ["fbclid", "gclid", "ref"]) -> Column:  # noqa: B006
    """The key by which a crawler knows a URL: host without port and www., parameters sorted, tracking ones gone, no fragment."""
    kept = F.array_sort(F.filter(_pairs(query(url)), lambda p: ~(_name(p).isin(tracking) | starts_with_any(_name(p), tracking_prefixes))))
    q = F.array_join(kept, "&")
    return F.concat(scheme(url), F.lit("://"), domain(url), F.when(path(url) == "", "/").otherwise(path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
#: Beginnings of IPv4 addresses that are not of the public internet (fixed values): 0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.0.0/24,
#: 192.0.2/24, 192.168/16, 198.18/15, 198.51.100/24, 203.0.113/24, 224/4 and 240/4.
PRIVATE_IPV4 = r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.0\.[02]|192\.168|198\.(18|19|51\.100)|203\.0\.113)\."
#: IPv6 addresses that may be public: 2000::/3, but for 2001::/23, 2001:db8::/32, 2002::/16 and 3fff::/20.
PUBLIC_IPV6 = r"^\[(2[0-9a-f]{3}|3[0-9a-f]{3}):"
PRIVATE_IPV6 = r"^\[(2001:(0?1?[0-9a-f]{0,2}|db8):|2002:|3fff:0?[0-9a-f]{0,3}:)"


def is_internal(url: Column) -> Column:
    """Whether a URL leads to this machine, a private network or a metadata service, or is no http URL at all.

    Names are judged as they stand, and are not resolved; addresses only in their usual forms.
    """
    given = F.coalesce(url, F.lit(""))
    name = F.lower(F.regexp_replace(F.regexp_replace(netloc(given), r"^.*@", ""), r":[0-9]*$", ""))
    six = ~name.rlike(PUBLIC_IPV6) | name.rlike(PRIVATE_IPV6)
    four = name.rlike(IPV4) & name.rlike(PRIVATE_IPV4)
    return ~scheme(given).isin("http", "https") | (name == "") | name.isin(INTERNAL_HOSTS) | F.when(name.startswith("["), six).otherwise(four)
