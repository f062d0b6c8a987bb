"""Declaration heads in source text: where a signature ends, and what a class extends."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a scan steps over whole (comments, literals) or looks at (operators, brackets, any other character).
_STEP = re.compile(r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quote>[\"'`])(?:\\.|(?!(?P=quote)).)*(?:(?P=quote)|\Z)|=>|[=!]=+|\S", re.DOTALL)
_OPENING = {")": "(", "]": "[", "}": "{"}
# How far a head reaches, what before a name makes it no API, what makes a class an error.
LINES = 200
_PRIVATE = re.compile(r"\bprivate\s+(?:(?:static|readonly|async|override|get|set)\s+)*\*?\s*$")
_ERROR = re.compile(r"\b(?:extends|implements|with)\s[^{]*?\b[\w$]*(?:Error|Exception)\b")
_MAYBE_ERROR = re.compile(r"Error|Exception")
_LINE_COMMENT = re.compile(r"//.*$", re.MULTILINE)


def head_end(text: str, start: int, stop: int, dart: bool = False, annotation: bool = False) -> int | None:
    """Offset of what ends the declaration head at ``start``: its body, arrow, initializer or semicolon outside all brackets.

    A brace after ``:``, ``|``, ``&`` or ``,`` opens a type; in Dart a colon after the parameters
    begins initializers. With ``annotation`` (a variable's type) only an initializer or a
    semicolon ends it. None where a bracket closes what none opened, or nothing ends before ``stop``.
    """
    open_, before, parameters_over = [], "", False
    for m in _STEP.finditer(text, start, stop):
        step = m[0]
        if m["skip"]:
            continue
        outside = not open_
        if step in _OPENING:
            while open_ and open_[-1] == "<":  # a comparison, or generics that broke off
                open_.pop()
            if not open_ or open_.pop() != _OPENING[step]:
                return None
            parameters_over |= step == ")" and not open_
        elif step == ">":
            if open_ and open_[-1] == "<":
                open_.pop()
        elif outside and (step in ("=", ";") or (step == "=>" and not annotation) or (step == ":" and dart and parameters_over)):
            return m.start()
        elif outside and step == "{" and not annotation and before not in (":", "|", "&", ","):
            return m.start()
        elif step in ("(", "[", "<", "{"):
            open_.append(step)
        before = m["quote"] or step[-1]
    return None


def variable_head_end(text: str, start: int, stop: int) -> int | None:
    """The same of a variable that holds a function: over its annotation, then over the function's own head."""
    begins = head_end(text, start, stop, annotation=True)
    if begins is None or text[begins] != "=":
        return None
    inner = head_end(text, begins + 1, stop)
    return begins if inner is None else inner


class Lines:
    """Offsets of a text by line and column, and back."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def offset(self, line: int, col: int) -> int | None:
        return self.starts[line] + col if 0 <= line < len(self.starts) else None

    def end_of(self, line: int) -> int:
        """Past the last of the lines before ``line``."""
        return self.starts[line] if line < len(self.starts) else len(self.text)

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]


def head_of(lines: Lines, line: int, col: int, kind: str, dart: bool) -> tuple[int | None, int | None, bool]:
    """Line and column where the signature of what is named at (line, col) ends, and whether it is an error class.

    ``kind``: method, term (a variable) or type. A private member's signature is no API, so it has none.
    """
    text, start = lines.text, lines.offset(line, col)
    if start is None:
        return None, None, False
    stop = lines.end_of(line + LINES)
    if kind == "type":
        if not _MAYBE_ERROR.search(text, lines.starts[line], lines.end_of(line + 5)):
            return None, None, False
        end = head_end(text, start, stop, dart)
        return None, None, end is not None and bool(_ERROR.search(_LINE_COMMENT.sub("", text[start:end])))
    if _PRIVATE.search(text[lines.starts[line] : start]):
        return None, None, False
    end = variable_head_end(text, start, stop) if kind == "term" else head_end(text, start, stop, dart)
    return (None, None, False) if end is None else (*lines.place(end), False)


_INT = T.IntegerType()
HEADS = T.ArrayType(T.StructType([T.StructField("line", _INT), T.StructField("col", _INT), T.StructField("end_line", _INT), T.StructField("end_col", _INT), T.StructField("is_error", T.BooleanType())]))


@F.pandas_udf(HEADS)
def heads_udf(texts: pd.Series, files: pd.Series, named: pd.Series) -> pd.Series:
    """Of every (line, col, kind) of a file: where its signature ends, whether it is an error class. One scan of a file's lines for all."""

    def one(text, file, places):
        lines, dart = Lines(text), file.endswith(".dart")
        return [(p["line"], p["col"], *head_of(lines, p["line"], p["col"], p["kind"], dart)) for p in places]

    return pd.Series([one(*x) for x in zip(texts, files, named)])
