"""URL expressions.

Exact for ASCII URLs.  Not covered: punycode of international hosts, dot segments and percent re-encoding of the
path; both sides of every join pass the same expression, so identities stay consistent.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"(?:[^/?#@:\s\[\]<>^|%\\]+|\[[0-9a-f:.]+\])"
_PORT = r"(?::0*(?:[0-5]?\d{1,4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5])?)?"
HTTP_URL = rf"(?i)^\s*https?://(?:[^/?#@\s]*@)?{_HOST}{_PORT}(?:[/?#].*)?$"
PUBLIC_URL = rf"(?i)^\s*https?://(?::?@)?{_HOST}{_PORT}(?:[/?#].*)?$"
# Groups: scheme, host, port, path, query.
PLAIN_PAIR = "^[A-Za-z0-9*._-]*=[A-Za-z0-9*._-]*$"  # form encoding leaves it as it is
PARTS = rf"(?i)^\s*(https?)://(?:[^/?#@\s]*@)?({_HOST})(?::(\d*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def host_of(url: Column) -> Column:
    """Lower-case host without a trailing dot; NULL when the text is no http(s) URL."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, PARTS, 2)), r"\.$", ""), F.lit(""))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(HTTP_URL), F.lit(False))


def is_public_url(url: Column) -> Column:
    """An http(s) URL without credentials (a lone ``@`` or ``:@`` carries none)."""
    return F.coalesce(url.rlike(PUBLIC_URL), F.lit(False))


def has_credentials(url: Column) -> Column:
    return is_http_url(url) & ~is_public_url(url)


def _form_text(text: Column) -> Column:
    return F.url_encode(F.coalesce(F.try_url_decode(text), text))


def _sorted_query(query: Column) -> Column:
    """Parameters in form encoding, sorted by name, stable."""
    name = lambda pair: F.substring_index(pair, "=", 1)
    keyed = F.transform(
        F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda pair: pair != ""),
        lambda pair, pos: F.struct(
            F.when(pair.rlike(PLAIN_PAIR), name(pair)).otherwise(F.coalesce(F.try_url_decode(name(pair)), name(pair))).alias("name"),
            pos.alias("pos"),
            F.when(pair.rlike(PLAIN_PAIR), pair).otherwise(
                F.concat(_form_text(name(pair)), F.lit("="), _form_text(F.regexp_replace(pair, "^[^=]*=?", "")))).alias("text"),
        ),
    )
    text = F.array_join(F.transform(F.array_sort(keyed), lambda pair: pair["text"]), "&")
    return F.regexp_replace(text, "^(?=.)", "?")


def normalise_url(url: Column) -> Column:
    """One spelling per address, NULL if it is not a public http(s) URL.

    Lower-case host without trailing dot, no default port, no fragment, no trailing slashes, sorted query.
    """
    # No part holds a ``#``, so one pass of the pattern gives all of them.
    parts = F.split(F.regexp_replace(F.when(is_public_url(url), url), PARTS, "$1://$2:$3#$4#$5"), "#")
    origin = F.lower(F.get(parts, F.lit(0)))
    origin = F.regexp_replace(origin, r"\.?:0*(\d*)$", ":$1")
    origin = F.regexp_replace(origin, r"^(http://.*):80$|^(https://.*):443$|^(.*):$", "$1$2$3")
    path = F.rtrim(F.get(parts, F.lit(1)), F.lit("/"))
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(origin, path, _sorted_query(F.get(parts, F.lit(2))))


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains, so that a sub-domain test becomes an equi-join."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda start: F.array_join(F.slice(labels, start, F.size(labels)), "."),
    )


def is_denied_host(url: Column, denied: tuple[str, ...]) -> Column:
    """Host equals, or lies below, one of a short literal list of hosts; large lists join on ``host_suffixes``."""
    names = "|".join(re.escape(name) for name in denied)
    pattern = rf"(?i)^\s*https?://(?:[^/?#@\s]*@)?(?:[^/?#@:\s]*\.)?(?:{names})\.?(?::\d*)?(?:[/?#].*)?$"
    return F.coalesce(url.rlike(pattern), F.lit(False))
