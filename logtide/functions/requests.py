"""Classification of one request, as Column expressions."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.schema import (
    ASSET_EXTENSIONS,
    CRAWLER_TOKEN,
    HIT_METHOD,
    HIT_STATUSES,
    PAGE_CATEGORY,
)

BotMap = Sequence[tuple[str, str]]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` also folds letters such as the Kelvin sign."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def bot_name(user_agent: Column, bots: BotMap) -> Column:
    """Name of the first ``(pattern, name)`` whose pattern is in the user agent.

    The order of ``bots`` is the priority. A missing or empty user agent is
    never a bot.
    """
    name = F.lit(None).cast("string")
    for pattern, label in reversed(list(bots)):
        name = F.when(user_agent.contains(pattern), F.lit(label)).otherwise(name)
    return F.when(user_agent != "", name)


def grams(text: Column, size: Column) -> Column:
    """All substrings of ``size`` characters; ``''`` is the one of size 0."""
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return F.when(
        F.char_length(text) >= size,
        F.array_distinct(F.transform(starts, lambda at: F.substr(text, at, size))),
    ).otherwise(F.array().cast("array<string>"))


def is_hit(method: Column, status: Column) -> Column:
    """Page view test. Null-safe, and simple enough to reach the Parquet scan."""
    wanted = F.lit(False)
    for code in HIT_STATUSES:
        wanted = wanted | status.eqNullSafe(code)
    return method.eqNullSafe(HIT_METHOD) & wanted


def is_crawler(user_agent: Column) -> Column:
    return user_agent.contains(CRAWLER_TOKEN)


def path_category(path: Column) -> Column:
    """Asset category by the text after the last dot of the whole path.

    A lookup in a literal map, so the extension is worked out once per row even
    where the planner moves a test on the category into a scan's filter.
    """
    by_extension = F.create_map(
        *[F.lit(v) for name, exts in ASSET_EXTENSIONS.items() for e in exts for v in (e, name)]
    )
    extension = F.lower(F.substring_index(path, ".", -1))
    category = F.when(path.contains("."), F.try_element_at(by_extension, extension))
    return F.coalesce(category, F.lit(PAGE_CATEGORY))


def request_hour(time: Column) -> Column:
    """Hour from the first two characters; 0 when they are not a number.

    The result can exceed 23, which the hourly report leaves out and the data
    quality report counts.
    """
    head = F.substring(time, 1, 2)
    return F.when(
        head.rlike("^([0-9][0-9]|[+][0-9])$"), head.try_cast("int")
    ).otherwise(F.lit(0))


def referer_host(referer: Column) -> Column:
    """Text between an http(s) scheme and the first slash, null without one.

    A port or a query stays in the result.
    """
    host = F.lit(None).cast("string")
    for scheme in ("http://", "https://"):
        rest = F.substr(referer, F.lit(len(scheme) + 1))
        host = F.when(
            referer.startswith(scheme), F.substring_index(rest, "/", 1)
        ).otherwise(host)
    return host


def is_external_referer(referer: Column, domain: Column) -> Column:
    """True for an http(s) referer whose host is not the site itself."""
    foreign = ascii_lower(referer_host(referer)) != ascii_lower(domain)
    return F.coalesce(foreign, F.lit(False))
