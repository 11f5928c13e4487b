"""Identity and hashing of records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(*parts: Column, length: int = 32) -> Column:
    """The first ``length`` hex digits of the SHA-256 of the parts joined by U+001F; a null part counts as ``None``."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.substring(sha256(joined), 1, length)


def normalize_url(url: Column, base: str = "") -> Column:
    """Scheme and host in small letters, no trailing slashes, query or fragment; a path alone is read relative to ``base``."""
    u = F.regexp_replace(url, r"^\s+|\s+$", "")
    whole = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).when(u.startswith("//"), F.concat(F.lit((base.split("://")[0] or "https") + ":"), u)).when(u.startswith("/"), F.concat(F.lit(base.rstrip("/")), u)).otherwise(F.concat(F.lit(base.rstrip("/") + "/" if base else ""), u))
    origin = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path))


def domain_allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host of an http(s) URL is one of ``domains`` or below one of them."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    ok = host.isin(domains)
    for d in domains:
        ok = ok | host.endswith("." + d)
    return F.coalesce(ok, F.lit(False))
