"""URL hygiene: canonical form, parts, scope, tiers and refresh times."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import DEFAULT, SKIP_PATTERNS, TRACKING_PREFIXES

_DEFAULT_PORT = {"http": 80, "https": 443, "ftp": 21}


def _parsed(raw: str | None, base: str | None = None):
    """(scheme, host with a port that is not the scheme's, path, query) or None if ``raw`` is no absolute URL."""
    if raw is None:
        return None
    try:
        cleaned = re.sub(r"[\t\n\r]", "", raw.strip()).replace("\\", "/")
        parts = urlsplit(urljoin(base, cleaned) if base else cleaned)
        scheme = parts.scheme.lower()
        if scheme not in _DEFAULT_PORT or not parts.hostname:
            return None
        host = parts.hostname.lower().encode("idna").decode() if not parts.hostname.isascii() else parts.hostname.lower()
        port = parts.port
    except (ValueError, UnicodeError):
        return None
    if re.search(r"[\s<>^|%#]", host):
        return None
    if port is not None and port != _DEFAULT_PORT[scheme]:
        host = f"{host}:{port}"
    kept: list[str] = []
    names = (parts.path or "/").split("/")[1:]
    for n, name in enumerate(names):
        last = n == len(names) - 1
        if name.lower() in ("..", ".%2e", "%2e.", "%2e%2e"):
            kept = kept[:-1] + ([""] if last else [])
        elif name.lower() in (".", "%2e"):
            kept += [""] if last else []
        else:
            kept.append(name)
    path = quote("/" + "/".join(kept), safe="/%!$&'()*+,;=:@~[]^|")
    return scheme, host, path, parts.query


def canonical(raw: str | None, base: str | None = None) -> str | None:
    """The canonical form of a URL: no fragment or tracking parameters, parameters sorted by name, host in lower case.

    A string that is no absolute URL comes back as it is, null as null. The case of paths is kept.
    """
    parts = _parsed(raw, base)
    if parts is None:
        return raw
    scheme, host, path, query = parts
    pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if not k.lower().startswith(TRACKING_PREFIXES)]
    pairs.sort(key=lambda p: p[0])
    return f"{scheme}://{host}{path}" + (f"?{urlencode(pairs, safe='*')}" if pairs else "")


@F.pandas_udf(T.StringType())
def normalize(url: pd.Series) -> pd.Series:
    return url.map(lambda u: canonical(u) if isinstance(u, str) else None)


@F.pandas_udf(T.StringType())
def normalize_against(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([canonical(u, b) if isinstance(u, str) else None for u, b in zip(url, base, strict=True)])


def host_of(url: Column) -> Column:
    """The host in lower case, '' where there is none; built in, for URLs already canonical."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def path_of(url: Column) -> Column:
    """Path and query, '' where there is none."""
    path = F.try_parse_url(url, F.lit("PATH"))
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.coalesce(F.concat(F.when(path == "", "/").otherwise(path), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise("")), F.lit(""))


def in_scope(url: Column, hosts: Iterable[str] | Column) -> Column:
    """Whether a URL is of http(s), on one of ``hosts`` and matches none of the skip patterns; null is not.

    ``hosts`` may be a column instead, whether the host is one of them, where they are joined as a table.
    """
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    skip = url.rlike("(?i)" + "|".join(SKIP_PATTERNS))
    return F.coalesce(scheme.isin("http", "https") & (hosts if isinstance(hosts, Column) else host_of(url).isin(*hosts)) & ~skip, F.lit(False))


def priority(url: Column) -> Column:
    """The tier of a URL found in a link: 3 library documents, 2 agenda files, 1 others."""
    return F.when(url.rlike("(?i)/DocumentCenter/View/"), 3).when(url.rlike("(?i)/AgendaCenter/ViewFile/"), 2).otherwise(1)


def ttl_days(tier: Column, days: dict[int, int] = DEFAULT.ttl_days) -> Column:
    """How long a resource of a tier stays fresh; an unknown tier counts as 1."""
    out = F.lit(days[1])
    for known, value in days.items():
        out = F.when(tier == known, value).otherwise(out)
    return out


def source_label(url: Column) -> Column:
    """Host and path without the slash at the end."""
    return F.regexp_replace(F.concat(host_of(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), "/$", "")
