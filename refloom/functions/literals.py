"""An index of the string literals of source text: what they quote, and whether they are code to be generated or messages."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.functions.source_text import regions

# Import code in a literal, calls that build such code, how far before a literal one counts; words of messages to people.
GENERATED = tuple(re.compile(p) for p in (
    r"""\b(?:import|export)\s*(?:type\s+)?[{*\w$][\s\S]*?\bfrom\s*(?:['"`]|\$\{|JSON\.stringify|[A-Za-z_$])""",
    r"""\b(?:import|export)\s+['"][^'"\n]+['"]""",
    r"""\brequire\s*\(\s*['"]""",
    r"""\bimport\s*\(\s*['"]""",
))
BUILDER, BUILDER_REACH = re.compile(r"\w*(?:Import|Export|import|export)\w*Declaration\s*\("), 300
CALLEES, OBJECTS = ("deprecated", "deprecate", "warn", "warning"), ("console", "logger")
PREFIX = re.compile(r"^\s*(?:\[(?:deprecated|deprecation|warn|warning)\]|(?:deprecated|deprecation|warning)\s*:)", re.IGNORECASE)
REACH = 2000
_CALLEE, _BLOCK = re.compile(r"([\w$.]+)\s*$"), re.compile(r"(?:\)|=>)\s*$")
_MARK = re.compile(r"[()\[\]{};]")
_WORD = re.compile(r"[\w$]+")
_NOT_LINE_END = re.compile(r"[^\n]")


class Frames:
    """Open brackets of a text's plain code before each of some places, found in one pass."""

    def __init__(self, code: str):
        self.code, self.marks = code, [(m.start(), m[0]) for m in _MARK.finditer(code)]
        self.at, self.open = 0, [[-1, "", -1]]  # position, bracket, last semicolon inside

    def before(self, place: int) -> list[list]:
        """Frames around ``place``, the innermost last; places must not go back."""
        while self.at < len(self.marks) and self.marks[self.at][0] < place:
            position, mark = self.marks[self.at]
            if mark in "([{":
                self.open.append([position, mark, -1])
            elif mark == ";":
                self.open[-1][2] = position
            elif len(self.open) > 1:
                self.open.pop()
            self.at += 1
        return self.open

    def is_message(self, place: int) -> bool:
        """Whether a literal at ``place`` is an argument (perhaps within an object or a list) of a call that tells people something."""
        for position, mark, semicolon in reversed(self.before(place)):
            if position < max(0, place - REACH) or semicolon > position:
                return False
            around = self.code[max(0, position - 200) : position]
            if mark == "{" and _BLOCK.search(around):
                return False
            if mark == "(":
                callee = _CALLEE.search(around)
                names = callee[1].split(".") if callee else [""]
                return names[-1] in CALLEES or any(n in OBJECTS for n in names[:-1])
        return False


def _beside(text: str, at: int, step: int) -> str:
    """The next character from ``at`` on that is no white space, forwards or backwards."""
    while 0 <= at < len(text):
        if not text[at].isspace():
            return text[at]
        at += step
    return ""


def _words(text: str, base: int, line_at) -> dict[str, tuple[int | None, int]]:
    """Of each word the line where it first stands in an import clause (or None) and where it first stands at all."""
    out: dict[str, tuple[int | None, int]] = {}
    words = list(_WORD.finditer(text))
    for k, m in enumerate(words):
        before, after = _beside(text, m.start() - 1, -1), _beside(text, m.end(), 1)
        beside = lambda j: 0 <= j < len(words) and words[j][0] == "as" and not text[min(words[j].end(), m.end()) : max(words[j].start(), m.start())].strip()
        clause = before == "{" or after == "}" or beside(k - 1) or beside(k + 1) or before == after == ","
        line = line_at(base + m.start())
        first, any_ = out.get(m[0], (None, line))
        out[m[0]] = (line if clause and first is None else first, any_)
    return out


def literals(text: str, dart: bool = False) -> list[dict]:
    """Every literal that is no module specifier: raw text, whether it is generated code, whether a message, words of the generated region, words of its content."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_at = lambda offset: bisect_right(starts, offset)
    spans, code, at = [], [], 0
    for kind, a, b in regions(text, dart):
        code += [text[at:a], _NOT_LINE_END.sub(" ", text[a:b])]
        at = b
        # parts of one literal follow each other with only an interpolation between
        if kind == "text" and spans and spans[-1][0] == "text" and spans[-1][2] < a and text[spans[-1][2]] == "$" and text[a - 1] in "}" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
            spans[-1][2], spans[-1][3] = b, [*spans[-1][3], (a, b)]
        else:
            spans.append([kind, a, b, [(a, b)]])
    frames, out = Frames("".join([*code, text[at:]])), []
    for kind, a, b, parts in spans:
        if kind != "text":
            continue
        raw = text[a:b]
        content = "".join(text[x:y] + _NOT_LINE_END.sub(" ", text[y:z]) for (x, y), z in zip(parts, [*(p[0] for p in parts[1:]), b], strict=True))
        message = bool(PREFIX.search(raw.strip("\"'`"))) or frames.is_message(a)
        region = None
        if not message and any(p.search(raw) for p in GENERATED):
            region = (content, a)
        elif not message:
            builders = list(BUILDER.finditer(text, max(0, a - BUILDER_REACH), a))
            region = (text[builders[-1].start() : b], builders[-1].start()) if builders else None
        made = [] if region is None else [(w, line_at(region[1] + m.start())) for m in _WORD.finditer(region[0]) for w in dict.fromkeys((m[0], m[0].lstrip("$"))) if w]
        quoted = [(w, clause, first) for w, (clause, first) in _words(content, a, line_at).items()]
        out.append({"text": raw, "generated": region is not None, "message": message, "made": made, "quoted": quoted})
    return out


_INT, _STR = T.IntegerType(), T.StringType()
LITERALS = T.ArrayType(T.StructType([
    T.StructField("text", _STR), T.StructField("generated", T.BooleanType()), T.StructField("message", T.BooleanType()),
    T.StructField("made", T.ArrayType(T.StructType([T.StructField("token", _STR), T.StructField("line", _INT)]))),
    T.StructField("quoted", T.ArrayType(T.StructType([T.StructField("token", _STR), T.StructField("clause_line", _INT), T.StructField("line", _INT)]))),
]))


@F.pandas_udf(LITERALS)
def literals_udf(texts: pd.Series, files: pd.Series) -> pd.Series:
    return pd.Series([literals(t, f.endswith(".dart")) for t, f in zip(texts, files, strict=True)])
