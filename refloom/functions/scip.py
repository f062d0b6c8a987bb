"""Symbol strings of code indexes: scheme, package and descriptors."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Descriptor suffixes of the public symbol grammar, by the name of their kind.
_NAME = r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_+\-$]+)"
_DESCRIPTOR = re.compile(rf"(?P<name>{_NAME})(?:(?P<mark>[/#.:!])|\((?P<overload>[A-Za-z0-9_+\-$]*)\)\.)|\[(?P<type_parameter>{_NAME})\]|\((?P<parameter>{_NAME})\)")
_MARKS = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}
SYMBOL_TYPE = T.StructType([T.StructField("local", T.BooleanType()), *[T.StructField(n, T.StringType()) for n in ("scheme", "manager", "name", "version", "descriptors")]])
DESCRIPTOR_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "suffix", "text")]))


def split_header(symbol: str) -> list[str] | None:
    """Scheme, manager, name, version and the rest; two spaces stand for one within a part."""
    parts, at = [], 0
    for _ in range(4):
        text = ""
        while True:
            end = symbol.find(" ", at)
            if end < 0:
                return None
            text += symbol[at:end]
            if symbol.startswith("  ", end):
                text, at = text + " ", end + 2
                continue
            at = end + 1
            break
        parts.append("" if text == "." else text)
    return [*parts, symbol[at:]]


def parse_symbol(symbol: str | None) -> dict | None:
    """The parts of a symbol; None where it does not follow the grammar."""
    if symbol is None:
        return None
    if symbol.startswith("local "):
        return {"local": True, "scheme": "local", "manager": "", "name": "", "version": "", "descriptors": symbol[6:]}
    parts = split_header(symbol)
    if parts is None or not parts[0] or parse_descriptors(parts[4]) is None:
        return None
    return {"local": False} | dict(zip(("scheme", "manager", "name", "version", "descriptors"), parts))


def parse_descriptors(text: str | None) -> list[dict] | None:
    """name (unquoted), suffix kind and text of each descriptor; None where the text does not parse."""
    out, at = [], 0
    while text is not None and at < len(text):
        m = _DESCRIPTOR.match(text, at)
        if m is None:
            return None
        # the group that ended last tells the kind: one pass over a name, whatever follows it
        last = m.lastgroup
        kind = _MARKS[m["mark"]] if last == "mark" else "method" if last == "overload" else last
        name = m[kind] if last == kind else m["name"]
        out.append({"name": name[1:-1].replace("``", "`") if name.startswith("`") else name, "suffix": kind, "text": m[0]})
        at = m.end()
    return out or None


def normalize_version(symbol: str | None) -> str | None:
    """The symbol with its version replaced by a dot, so that indexes of two versions meet."""
    parts = None if symbol is None or symbol.startswith("local ") else split_header(symbol)
    if parts is None:
        return symbol
    shown = [p.replace(" ", "  ") or "." for p in parts[:3]]
    return " ".join([*shown, ".", parts[4]])


@F.pandas_udf(SYMBOL_TYPE)
def parse_symbol_udf(symbols: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(("local", "scheme", "manager", "name", "version", "descriptors"))
    return pd.DataFrame([parse_symbol(s) or empty for s in symbols], columns=list(empty))


@F.pandas_udf(DESCRIPTOR_TYPE)
def parse_descriptors_udf(texts: pd.Series) -> pd.Series:
    return texts.map(parse_descriptors)


@F.pandas_udf(T.StringType())
def normalize_version_udf(symbols: pd.Series) -> pd.Series:
    return symbols.map(normalize_version)


# Names of the kinds of the public symbol grammar, from number 1 on (83 is not given out).
KIND_NAMES = (
    "array assertion associatedtype attribute axiom boolean class constant constructor datafamily enum enummember event fact field file function getter grammar instance interface key lang lemma macro method "
    "methodreceiver message module namespace null number object operator package packageobject parameter parameterlabel pattern predicate property protocol quasiquoter selfparameter setter signature subscript "
    "string struct tactic theorem thisparameter trait type typealias typeclass typefamily typeparameter union value variable contract error library modifier abstractmethod methodspecification protocolmethod "
    "purevirtualmethod traitmethod typeclassmethod accessor delegate methodalias singletonclass singletonmethod staticdatamember staticevent staticfield staticmethod staticproperty staticvariable - extension mixin concept"
).split()
NAMESPACE_KIND = KIND_NAMES.index("namespace") + 1
_TEXTS, _FLAGS = T.ArrayType(T.StringType()), T.ArrayType(T.BooleanType())
PARTS_TYPE = T.StructType(
    [T.StructField("valid", T.BooleanType()), *[T.StructField(n, T.StringType()) for n in ("scheme", "manager", "name", "tail")], T.StructField("names", _TEXTS), T.StructField("suffixes", _TEXTS), T.StructField("texts", _TEXTS), T.StructField("literal", _FLAGS)]
)


@lru_cache(maxsize=200_000)
def symbol_parts(symbol: str) -> tuple:
    """valid, scheme, manager and name, the descriptors' text, and of each descriptor name, suffix, text and whether a counter ends an anonymous literal's name.

    Of what does not parse, scheme to name as far as they can be read; of locals and the empty symbol nothing.
    """
    if symbol == "" or symbol.startswith("local "):
        return (True, None, None, None, None, None, None, None, None)
    head = split_header(symbol)
    found = parse_descriptors(head[4]) if head and head[0] else None
    if found is None:
        return (False, *(head[:3] if head else (None, None, None)), None, None, None, None, None)
    literal = [d["suffix"] == "meta" and d["name"][-1:].isdigit() for d in found]
    return (True, *head[:3], head[4], [d["name"] for d in found], [d["suffix"] for d in found], [d["text"] for d in found], literal)


@F.pandas_udf(PARTS_TYPE)
def symbol_parts_udf(symbols: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([symbol_parts(s or "") for s in symbols], columns=PARTS_TYPE.names)
