"""Path of a sitemap URL in the form a request log shows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"
_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)"

# Web schemes take any number of slashes of either kind before the host, and
# back slashes as slashes in the path. User, host, port and path, in this order.
_WEB = r"(?i)^(https?|ftp|wss?):"
_WEB_PATH = (
    _WEB
    + r"[/\\]*(?:[^/\\?#]*@)?"
    + r"(?:\[[0-9a-f:.]+\]|[^\x00-\x20/\\?#@:<>^|\[\]\x7F]+)"
    + r"(?::[0-9]{0,5})?((?:[/\\][^?#]*)?)(?:[?#]|\z)"
)
_BLANK_ENDS = r"^[\x00-\x20]+|[\x00-\x20]+\z"
_DROPPED = r"[\t\n\r]"

# Characters a URL path writes as %XX (fixed by the URL standard).
_ENCODED = '[^!-~]|["<>`{}]'

_DOT = "(?i)^([.]|%2e)$"
_DOT_DOT = "(?i)^([.]|%2e){2}$"
_HAS_DOTS = "(?i)/([.]|%2e){1,2}(/|$)"


def _percent_encode(path: Column) -> Column:
    def encode(char: Column) -> Column:
        return F.when(
            char.rlike(_ENCODED), F.replace(F.url_encode(char), F.lit("+"), F.lit("%20"))
        ).otherwise(char)

    return F.array_join(F.transform(F.split(path, ""), encode), "")


def _fold_dots(path: Column) -> Column:
    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment.rlike(_DOT), kept)
            .when(
                segment.rlike(_DOT_DOT),
                F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))),
            )
            .otherwise(F.concat(kept, F.array(segment)))
        )

    segments = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    ends_in_dots = last.rlike(_DOT) | last.rlike(_DOT_DOT)
    kept = F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def url_path(url: Column) -> Column:
    """Path of an absolute URL, ``/`` if it has none; other text comes back as is.

    As a browser reads it: blanks and control characters around the URL, tabs
    and line ends in it are dropped; a web URL may have back slashes, or another
    number of slashes before its host. Non-ASCII and unsafe characters are
    percent-encoded and ``.``/``..`` segments folded. Plain paths skip both
    steps.
    """
    clean = F.regexp_replace(F.regexp_replace(url, _BLANK_ENDS, ""), _DROPPED, "")
    web = clean.rlike(_WEB)
    web_path = F.translate(F.regexp_extract(clean, _WEB_PATH, 2), "\\", "/")
    path = F.when(web, web_path).otherwise(F.regexp_extract(clean, _PATH, 1))
    encoded = F.when(path.rlike(_ENCODED), _percent_encode(path)).otherwise(path)
    folded = F.when(encoded.rlike(_HAS_DOTS), _fold_dots(encoded)).otherwise(encoded)
    absolute = (web & clean.rlike(_WEB_PATH)) | (~web & clean.rlike(_ABSOLUTE))
    return F.when(~absolute, url).when(path == "", F.lit("/")).otherwise(folded)
