"""URL expressions built on regular expressions.

``parse_url`` raises on malformed input under ANSI mode and returns NULL for
international host names, so the parts are cut out by pattern instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import falsy, to_col

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"

# A URL is acceptable when it is printable ASCII with a scheme and a host whose
# labels are alphanumeric with inner hyphens (or a bracketed IPv6 literal).
VALID_URL = (
    r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[!-.0-9:-?A-~]*@)?"
    r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*+\.?"
    r"|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?(?:[/?#][!-~]*)?\z"
)

# Schemes that need no host, and the longest host name.
HOSTLESS_URL = r"^(?:mailto|news|file):[!-~]+\z"
MAX_HOST = 253

# Link prefixes that never lead to a page.
SKIPPED_LINK_PREFIXES = ("#", "mailto:", "tel:")


def url_host(url: Column | str) -> Column:
    """Host without port and user info; empty when there is none."""
    return F.regexp_extract(to_col(url), HOST, 1)


def url_scheme(url: Column | str) -> Column:
    return F.regexp_extract(to_col(url), SCHEME, 1)


def is_valid_url(url: Column | str) -> Column:
    url = to_col(url)
    with_host = url.rlike(VALID_URL) & (F.length(url_host(url)) <= MAX_HOST)
    return F.coalesce(with_host | url.rlike(HOSTLESS_URL), F.lit(False))


def strip_trailing_slashes(url: Column | str) -> Column:
    return F.rtrim(to_col(url), F.lit("/"))


def site_base(site: Column | str) -> Column:
    """``scheme://host`` of a site address (port dropped, https by default)."""
    site = to_col(site)
    scheme = F.coalesce(F.nullif(url_scheme(site), F.lit("")), F.lit("https"))
    return F.concat(scheme, F.lit("://"), url_host(site))


def is_followable(href: Column | str) -> Column:
    href = to_col(href)
    skipped = falsy(href)
    for prefix in SKIPPED_LINK_PREFIXES:
        skipped = skipped | href.startswith(prefix)
    return ~skipped


def resolve_link(href: Column | str, page_url: Column | str, base: Column | str) -> Column:
    """Absolute form of a link; relative links hang below the page address."""
    href, page_url, base = to_col(href), to_col(page_url), to_col(base)
    return (
        F.when(href.startswith("/"), F.concat(base, href))
        .when(
            ~href.startswith("http"),
            F.concat(strip_trailing_slashes(page_url), F.lit("/"), href),
        )
        .otherwise(href)
    )


def canonical_url(url: Column | str) -> Column:
    """Scheme, host and path only, no trailing slash; NULL without a host."""
    url = to_col(url)
    path = F.coalesce(F.nullif(F.regexp_extract(url, PATH, 1), F.lit("")), F.lit("/"))
    clean = F.concat(url_scheme(url), F.lit("://"), url_host(url), path)
    return F.when(url_host(url) != "", strip_trailing_slashes(clean))
