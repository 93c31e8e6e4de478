"""URL predicates for web evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENCYCLOPEDIA_HOST = "en.wikipedia.org"  # fixed value


def _parts(url: Column) -> tuple[Column, Column, Column]:
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    user = F.try_parse_url(url, F.lit("USERINFO"))
    return scheme, host, user


def is_safe_https(url: Column) -> Column:
    """Parses, https, a host, and neither user name nor password."""
    scheme, host, user = _parts(url)
    clean_user = user.isNull() | user.isin("", ":")
    return F.coalesce((scheme == "https") & (host != "") & clean_user, F.lit(False))


def is_trusted_host(url: Column, host: str = ENCYCLOPEDIA_HOST) -> Column:
    """Safe https pinned to exactly one host; look-alike hosts fail."""
    return is_safe_https(url) & F.coalesce(_parts(url)[1] == host, F.lit(False))
