"""URL and host helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# scheme, authority, path, query with "?", fragment with "#": any other character may stand
# in any of them, as on the web
PARTS = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*):[/\\]{2}([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(url: Column, group: int) -> Column:
    """One part of an absolute URL; '' where it has none."""
    return F.regexp_extract(url, PARTS, group)


def _host(url: Column) -> Column:
    """Lower-case host without user name and port; null when the URL has none."""
    bare = F.regexp_replace(url_part(url, 2), r"^.*@|:[0-9]*$", "")
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host, ``unknown`` when the URL has none."""
    return F.coalesce(_host(url), F.lit("unknown"))


def host_label(url: Column) -> Column:
    """Host without a leading ``www.`` (used to label ad-hoc sources)."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def normalise_domain(value: Column) -> Column:
    """Host in lower case without one leading www/m/amp/mobile label; '' for null."""
    low = F.trim(F.lower(value))
    host = F.when(
        low.contains("://"), F.coalesce(_host(low), low)
    ).otherwise(low)
    return F.coalesce(F.regexp_replace(host, r"^(www|m|amp|mobile)\.", ""), F.lit(""))


def unwrap_redirect(href: Column, base: str = "https://duckduckgo.com") -> Column:
    """Target of a ``/l/?uddg=<encoded>`` link, else the absolute URL itself."""
    absolute = resolve_url(href, F.lit(base))
    raw = F.nullif(F.regexp_extract(url_part(absolute, 4), r"[?&]uddg=([^&]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), absolute, href)


def fold_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments; ``..`` at the root stays there."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    # a path that ends in a dot segment names a folder
    folder = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), folder)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` against ``base`` with the fragment kept.

    Covers absolute, scheme-relative, root-relative, query-only, fragment-only and
    path-relative links; dot segments are folded, however many there are.
    """
    scheme = F.nullif(url_part(base, 1), F.lit(""))
    root = F.concat(scheme, F.lit("://"), url_part(base, 2))
    path = url_part(base, 3)
    no_fragment = F.regexp_replace(base, "#.*$", "")
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", "")
    link = F.trim(href)
    joined = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when(link.startswith("#") | (link == ""), F.concat(no_fragment, link))
        .otherwise(F.concat(root, folder, link))
    )
    dotted = url_part(joined, 3)
    folded = F.concat(
        url_part(joined, 1),
        F.lit("://"),
        url_part(joined, 2),
        fold_dots(dotted),
        url_part(joined, 4),
        url_part(joined, 5),
    )
    dotless = F.when(dotted.rlike(r"/\.{1,2}(/|$)"), folded).otherwise(joined)
    # a bare authority gets the root path, as URL parsers print it
    return F.regexp_replace(dotless, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(?=$|[?#])", "$1/")


# URL fragments that lead to order placement or payment.
FORBIDDEN_URL = (
    r"(?i)/checkout|/check_?out|/payment|/pay(?:ment)?(?![A-Za-z0-9_])"
    r"|/order/(?:submit|create|place|confirm)|place_?order|/purchase"
    r"|razorpay|payu|billdesk|cashfree|stripe\.com|paypal\.com"
)


def is_safe_url(url: Column) -> Column:
    """False for checkout and payment URLs, which must never be opened."""
    return ~url.rlike(FORBIDDEN_URL)
