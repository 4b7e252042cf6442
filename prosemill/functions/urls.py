"""Which addresses may be fetched: web addresses of public hosts."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_NUMBER = re.compile(r"0[xX][0-9a-fA-F]*|0[0-7]*|[1-9][0-9]*")


def _address(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a host spells: IPv6 with or without a zone, or one to four decimal, octal or hexadecimal numbers, of which the last fills the remaining bytes."""
    try:
        return ipaddress.ip_address(host.split("%")[0])
    except ValueError:
        pass
    parts = host.split(".")
    if len(parts) > 4 or not all(_NUMBER.fullmatch(p) for p in parts):
        return None
    values = [int(p, 16 if p[:2].lower() == "0x" else 8 if p[0] == "0" else 10) if p.lower() != "0x" else 0 for p in parts]
    room = 256 ** (5 - len(parts))
    if any(v > 255 for v in values[:-1]) or values[-1] >= room:
        return None
    return ipaddress.IPv4Address(sum(v << (24 - 8 * i) for i, v in enumerate(values[:-1])) + values[-1])


def _public(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    inner = getattr(ip, "ipv4_mapped", None) or getattr(ip, "sixtofour", None)
    if inner is not None:
        return _public(inner)
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)


def verdict(url: str | None) -> str:
    """ok, or why not: scheme, userinfo, host (none, malformed or local by name) or address (not public). Names are not resolved."""
    try:
        parts = urlsplit((url or "").strip())
        if parts.scheme.lower() not in ("http", "https"):
            return "scheme"
        if "@" in parts.netloc:
            return "userinfo"
        host = (parts.hostname or "").strip().lower().rstrip(".")
        parts.port  # noqa: B018  raises if malformed
    except ValueError:
        return "host"
    if not host or re.search(r"[\s\\]", host) or host == "localhost" or host == "localhost.localdomain" or re.search(r"\.(localhost|local|internal)$", host):
        return "host"
    ip = _address(host)
    if ip is None:
        return "host" if ":" in host else "ok"
    return "ok" if _public(ip) else "address"


def redirect(url: str | None, location: str | None) -> tuple[str | None, str]:
    """Where a redirect leads and the verdict on it: every hop is judged anew. No location or start: host."""
    if not (url or "").strip() or not (location or "").strip():
        return None, "host"
    try:
        target = urljoin(url.strip(), location.strip())
    except ValueError:
        return None, "host"
    return target, verdict(target)


@F.pandas_udf(StringType())
def verdicts(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: verdict(None if pd.isna(u) else u))


@F.pandas_udf(StructType([StructField("target", StringType()), StructField("verdict", StringType())]))
def redirects(urls: pd.Series, locations: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([redirect(u, x) for u, x in zip(urls, locations, strict=True)], columns=["target", "verdict"])
