"""Source text with comments or string contents blanked: lengths and line ends stay, so offsets hold."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPENERS = {False: re.compile(r"//|/\*|['\"`]"), True: re.compile(r"//|/\*|'''|\"\"\"|['\"]")}
#: What a literal's end is looked for among: its quote, escapes, and the end of line (short ones) or an interpolation (templates).
_STOPS = {q: re.compile(rf"\\.|{q}" + (r"|\$\{" if q == "`" else "" if len(q) == 3 else r"|\n"), re.DOTALL) for q in ("'", '"', "`", "'''", '"""')}
#: Code inside a literal, and the escapes that hide its marks.
_HOLES = {False: re.compile(r"\\.|\$\{", re.DOTALL), True: re.compile(r"\\.|\$\{|\$[A-Za-z_]\w*", re.DOTALL)}
_NOT_LINE_END = re.compile(r"[^\n]")
_BRACE = re.compile(r"[{}]")
_RAW = re.compile(r"(?:^|[^\w$])[rR]$")
#: Characters before a literal that tell what it is.
_BEFORE = 40
# Words right before a literal that make it a module specifier, and the annotation whose literal names foreign code.
_SPECIFIER = re.compile(r"(?:\bfrom|\bimport|\bexport|\bpart(?:\s+of)?|\brequire\s*\(|\bimport\s*\(|\bmodule)\s*$")
_IMPORT = T.StructType([T.StructField("specifier", T.StringType()), T.StructField("line", T.IntegerType())])
_SEARCHED = T.StructType([T.StructField("text", T.StringType()), T.StructField("code", T.StringType()), T.StructField("defaults", T.ArrayType(_IMPORT))])
# Imports that bind the default export (the specifier is group 1).
_DEFAULTS = tuple(re.compile(p, re.DOTALL | re.ASCII) for p in (
    r"""\bimport\s+(?:type\s+)?[A-Za-z_$][\w$]*\s*(?:,[^;]*?)?\bfrom\s*['"]([^'"]+)['"]""",
    r"""\b(?:import|export)\s*(?:type\s*)?\{[^}]*\bdefault\b[^}]*\}\s*from\s*['"]([^'"]+)['"]""",
    r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)""",
))
_FOREIGN_NAME = re.compile(r"@JS\s*\(\s*$")


def _interpolation_end(text: str, at: int) -> int:
    """Past the brace that closes the one after the dollar at ``at``."""
    depth, end = 0, at + 1
    for m in _BRACE.finditer(text, at + 1):
        depth, end = depth + (1 if m[0] == "{" else -1), m.end()
        if depth == 0:
            return end
    return len(text)


def _literal_end(text: str, start: int, quote: str) -> int:
    """Past the literal's closing quote, or where it breaks off (line end, or text end for long ones)."""
    at = start + len(quote)
    while m := _STOPS[quote].search(text, at):
        if m[0] == quote:
            return m.end()
        if m[0] == "\n":
            return m.start()
        at = _interpolation_end(text, m.start()) if m[0] == "${" else m.end()
    return len(text)


def _holes(text: str, start: int, end: int, dart: bool) -> list[tuple[int, int]]:
    """Interpolations within a literal."""
    out, at = [], start
    while m := _HOLES[dart].search(text, at, end):
        at = min(end, _interpolation_end(text, m.start())) if m[0] == "${" else m.end()
        if m[0][0] == "$":
            out.append((m.start(), at))
    return out


def regions(text: str, dart: bool = False):
    """Yields (kind, start, end) of what is no plain code, in order; what begins first is taken whole.

    ``comment``; ``named``, a literal that names a module or foreign code; ``text``, characters
    of any other literal, which its interpolations (code) divide.
    """
    at = 0
    while m := _OPENERS[dart].search(text, at):
        start, before = m.start(), text[max(0, m.start() - _BEFORE) : m.start()]
        if m[0][0] == "/":
            closing = "\n" if m[0] == "//" else "*/"
            at = text.find(closing, m.end())
            at = len(text) if at < 0 else at + (2 if closing == "*/" else 0)
            yield "comment", start, at
            continue
        at = _literal_end(text, start, m[0])
        if _SPECIFIER.search(before) or (dart and _FOREIGN_NAME.search(before)):
            yield "named", start, at
            continue
        interpolated = dart and not _RAW.search(before) or m[0] == "`"
        for hole, after in _holes(text, start, at, dart) if interpolated else ():
            yield "text", start, hole
            start = after
        yield "text", start, at


def _without(text: str | None, dart: bool, kind: str) -> str | None:
    """``text`` with regions of a kind as spaces; line ends stay."""
    if text is None:
        return None
    out, at = [], 0
    for found, start, end in regions(text, dart):
        if found == kind:
            out += [text[at:start], _NOT_LINE_END.sub(" ", text[start:end])]
            at = end
    return "".join([*out, text[at:]])


def blank_comments(text: str | None, dart: bool = False) -> str | None:
    """Comments as spaces; what looks like one inside a string stays."""
    return _without(text, dart, "comment")


def blank_strings(text: str | None, dart: bool = False) -> str | None:
    """Strings as spaces; module specifiers, names of foreign code and interpolations stay."""
    return _without(text, dart, "text")


def default_imports(text: str) -> list[dict]:
    """specifier and line (from 1) of imports that bind a default export."""
    found = {(m[1], text.count("\n", 0, m.start()) + 1) for p in _DEFAULTS for m in p.finditer(text)}
    return [{"specifier": s, "line": n} for s, n in sorted(found)]


@F.pandas_udf(_SEARCHED)
def searched_text_udf(texts: pd.Series, files: pd.Series, indexed: pd.Series, code: pd.Series) -> pd.DataFrame:
    """The text that a search reads (of code: without comments, and without strings where ``indexed``), the same without any strings, and the default imports."""

    def one(text, file, strict, is_code):
        bare = text
        if is_code:
            dart = file.endswith(".dart")
            text = blank_comments(text, dart)
            bare = blank_strings(text, dart)
            text = bare if strict else text
        return text, bare, default_imports(text)

    return pd.DataFrame([one(*x) for x in zip(texts, files, indexed, code)], columns=["text", "code", "defaults"])
