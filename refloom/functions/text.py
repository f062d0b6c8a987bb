"""Scalar expressions over paths, names and symbol strings."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(base: Column) -> Column:
    """Before the first dot."""
    return F.substring_index(base, ".", 1)


def package_base(path: Column) -> Column:
    """Prefix of a package's files."""
    return F.when(path.isin(".", ""), F.lit("")).otherwise(F.concat(path, F.lit("/")))


def after(text: Column, prefix: Column) -> Column:
    """What follows a prefix of known length."""
    return text.substr(F.length(prefix) + 1, F.length(text))


def bare_package(specifier: Column) -> Column:
    """The package of an import specifier: two segments for scoped names, else one."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def descriptor_key(symbol: Column) -> Column:
    """The last path segment of a symbol string without quoting and accessor marks."""
    return F.replace(F.replace(F.replace(basename(symbol), F.lit("`"), F.lit("")), F.lit("<get>"), F.lit("")), F.lit("<set>"), F.lit(""))


def package_id(manager: Column, repo: Column, name: Column) -> Column:
    return F.concat_ws(":", manager, repo, name)


def uri_path(path: Column) -> Column:
    """Percent-encoded per segment."""
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def minor_text(text: Column) -> Column:
    """The part of a version before its first dot."""
    return F.substring_index(text, ".", 1)


def normalized_path(path: Column) -> Column:
    """Without empty and ``.`` segments, ``..`` taken back where something stands before it; back-slashes are slashes."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")

    def put(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(back, F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(parts, none, put), "/")


def minimum_pushed(text: str, now: int) -> int:
    """Epoch seconds of a cutoff given as days back (``90d``) or as an ISO date or time (UTC unless it says otherwise)."""
    days = re.fullmatch(r"(\d+)d", text.strip())
    if days:
        return now - int(days[1]) * 86400
    at = datetime.fromisoformat(text.strip())
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())
