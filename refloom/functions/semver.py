"""Version ranges of the two package managers: does a version satisfy a constraint?

A version is a point on a line, a range a stretch between two cuts of that line; a cut lies
just before or just after a version. Every operator is a choice of two cuts. The answer is
true, false, or None where the constraint is no version range (paths, URLs, workspace links,
tags), so that callers can fail closed.
"""

from __future__ import annotations

import string
from functools import lru_cache
from math import inf

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The operators, longer ones first; wildcards; characters of pre-release and build labels.
OPERATORS = ("~>", ">=", "<=", "^", "~", ">", "<", "=")
WILDCARDS = ("x", "X", "*")
_LABEL = frozenset(string.ascii_letters + string.digits + ".-")

#: (version key, side): a version itself is on side 1, cuts before and after it on 0 and 2.
Cut = tuple[tuple, int]
Stretch = tuple[Cut, Cut]
_LEFT, _RIGHT = ((-1,), 0), ((inf,), 0)


def _key(numbers: list[int], label: str = "") -> tuple:
    """Sorts versions: a labelled one before its release, numeric parts of labels before words."""
    if not label:
        return (*numbers, 1)
    parts = [(0, int(x), "") if x.isascii() and x.isdigit() and (x == "0" or x[0] != "0") else (1, 0, x) for x in label.split(".")]
    return (*numbers, 0, *parts)


def _read(word: str) -> tuple[list[int], int, str] | None:
    """Numbers before the first wildcard, how many places are written, and the label; None for no version."""
    core, plus, build = word.lstrip("=v").partition("+")
    core, dash, label = core.partition("-")
    if (plus and not build) or (dash and not label) or not _LABEL.issuperset(build + label):
        return None
    if not core:
        return None if plus or dash else ([], 0, "")
    places = core.split(".")
    digits = [p.isascii() and p.isdigit() for p in places]
    if len(places) > 3 or not all(d or p in WILDCARDS for d, p in zip(digits, places)):
        return None
    known = digits.index(False) if False in digits else len(places)
    return [int(p) for p in places[:known]], len(places), label if known == 3 else ""


def _point(text: str | None) -> tuple | None:
    """The key of a complete version."""
    found = _read(text.strip()) if text else None
    return _key(found[0], found[2]) if found and len(found[0]) == 3 else None


def _before_next(numbers: list[int], place: int) -> Cut:
    """The cut before the first release that differs from ``numbers`` at ``place`` or left of it."""
    kept = (numbers + [0, 0, 0])[: place + 1]
    return _key([*kept[:-1], kept[-1] + 1, 0, 0, 0][:3]), 0


def _fixed_place(numbers: list[int], manager: str) -> int:
    """Which number a caret keeps: the first that is not zero, in pub never the third."""
    if manager == "pub":
        return 0 if len(numbers) == 1 or numbers[0] else 1
    return next((k for k, n in enumerate(numbers) if n), len(numbers) - 1)


def _stretch(word: str, manager: str) -> Stretch | None:
    """The stretch of one operator and version."""
    op = next((o for o in OPERATORS if word.startswith(o)), "")
    found = _read(word[len(op) :])
    if found is None:
        return None
    numbers, _, label = found
    if not numbers:
        start, end = _LEFT, _RIGHT
    else:
        key = _key((numbers + [0, 0])[:3], label)
        start = key, 0
        end = (key, 2) if len(numbers) == 3 else _before_next(numbers, len(numbers) - 1)
    match op:
        case ">=":
            return start, _RIGHT
        case "<=":
            return _LEFT, end
        case ">":
            return end, _RIGHT
        case "<":
            return _LEFT, start
        case "^" | "~" | "~>" if numbers:
            place = _fixed_place(numbers, manager) if op == "^" else min(len(numbers), 2) - 1
            return start, _before_next(numbers, place)
    return start, end


def _all_of(text: str, manager: str) -> tuple[Stretch, ...] | None:
    """Stretches that must all hold. An operator may stand apart from its version; npm also has ``low - high``."""
    words = text.split()
    if manager != "pub" and len(words) == 3 and words[1] == "-":
        if words[0].startswith(OPERATORS[:-1]) or words[2].startswith(OPERATORS[:-1]):
            return None
        words = [">=" + words[0], "<=" + words[2]]
    joined: list[str] = []
    for word in words:
        if joined and joined[-1] in OPERATORS:
            joined[-1] += word
        else:
            joined.append(word)
    found = tuple(_stretch(word, manager) for word in joined)
    return None if None in found else found


@lru_cache(maxsize=4096)
def ranges(constraint: str, manager: str) -> tuple[tuple[Stretch, ...], ...] | None:
    """Alternatives, each of stretches that must all hold; None for no version range."""
    text = constraint.strip()
    if manager == "pub":
        if text == "any":
            return ((),)
        parts = [text]
    else:
        if text.startswith("npm:"):  # another package's name, then its range
            name, at, text = text[len("npm:") :].rpartition("@")
            if not (name and at):
                return None
        parts = text.split("||")
    if ":" in text or "/" in text:
        return None
    found = tuple(_all_of(part, manager) for part in parts)
    return None if None in found else found


def satisfies(version: str | None, constraint: str | None, manager: str) -> bool | None:
    point = _point(version)
    found = None if point is None or constraint is None else ranges(constraint, manager)
    if found is None:
        return None
    return any(all(low < (point, 1) < high for low, high in stretches) for stretches in found)


@F.pandas_udf(T.BooleanType())
def satisfies_udf(version: pd.Series, constraint: pd.Series, manager: pd.Series) -> pd.Series:
    """Three-valued ``satisfies`` over batches (parsed constraints are remembered)."""
    return pd.Series([satisfies(v, c, m) for v, c, m in zip(version, constraint, manager)], dtype="object")
