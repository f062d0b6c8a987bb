"""Paths that configuration, pages and command lines name for a runtime or bundler to load.

One table of rules: which files, what is read from them, and the folder that a path starts from.
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Programs that run the file named after them, their options that take a value, and those after which code stands.
RUNNERS = frozenset("node nodejs tsx ts-node ts-node-esm ts-node-script ts-node-transpile-only bun deno nodemon vite-node esno esr esrun jiti babel-node node-dev ts-node-dev tsnd tsm tsimp sucrase-node swc-node".split())
VALUED = frozenset("-r --require --import --loader --experimental-loader --env-file -C --conditions --watch-path --tsconfig -P --project --config --ext --ignore --signal --delay".split())
VALUED_NODEMON = frozenset("-w --watch -e --ext -i --ignore -d --delay -s --signal --config".split())
INLINE = frozenset("-e --eval -p --print".split())
CODE = re.compile(r"\.[cm]?[jt]sx?$")
URL = re.compile(r"^(?:[a-z][\w+.-]*:|//)", re.IGNORECASE)
# What is looked for in texts.
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>|<script\b([^>]*)>", re.IGNORECASE | re.DOTALL)
_SRC = re.compile(r"""\bsrc\s*=\s*["']([^"']+)["']""", re.IGNORECASE)
_LOADED = re.compile(r"""\b(?:require|import)\s*\(\s*(['"`])([^'"`$\n]+)\1\s*\)|\bimport\s+(?:[\w$*{}\s,]+\s+from\s+)?(['"])([^'"\n]+)\3""")
_LITERAL = re.compile(r"""(['"`])([^'"`\n]+)\1""")
_RELATIVE = re.compile(r"""(['"`])(\.{1,2}/[^'"`$\n]*)\1""")
_TOML_MAIN = re.compile(r"""^\s*main\s*=\s*["']([^"']+)["']""", re.MULTILINE)
_TOML_TABLE = re.compile(r"^\s*\[", re.MULTILINE)
_JSON_MAIN = re.compile(r'"main"\s*:\s*"([^"]+)"')
_DOCKER = re.compile(r"^\s*(CMD|ENTRYPOINT|WORKDIR)\s+(.*)$", re.IGNORECASE | re.MULTILINE)
_WORKER = re.compile(r"\bwrangler\s+(?:dev|deploy|publish)\b([^&|;]*)")
_KEY = re.compile(r"""(?:(['"])([^'"\n]+)\1|([A-Za-z_$][\w$-]*))\s*:\s*""")
_CLOSES = {"{": "}", "[": "]", "(": ")"}


def _tokens(command: str) -> list[str]:
    try:
        return shlex.split(command, posix=True)
    except ValueError:  # an open quote
        return command.split()


def run_files(command: str) -> Iterator[str]:
    """Code files that a command line starts a runner on: the first that looks like code after each runner's options."""
    for segment in re.split(r"&&|\|\||;|\|", command):
        runner, skip = None, False
        for token in _tokens(segment):
            base = token.rsplit("/", 1)[-1]
            if base in RUNNERS:
                runner, skip = base, False
            elif runner is None or skip:
                skip = False
            elif token.startswith("-"):
                inner = runner == "nodemon"
                skip = token in (VALUED_NODEMON if inner else VALUED)
                runner = None if not inner and token in INLINE else runner
            elif CODE.search(token) and not URL.match(token):
                yield token
                runner = None


def worker_files(command: str) -> Iterator[str]:
    """The entry module on a worker's command line: the first argument that is no option."""
    for m in _WORKER.finditer(command):
        first = next((t.strip("\"'") for t in m[1].split() if not t.startswith("-")), "")
        if CODE.search(first):
            yield first


def docker_files(text: str) -> Iterator[str]:
    """Files that the image's commands start, within its working folder."""
    folder, said = None, {"CMD": [], "ENTRYPOINT": []}
    for m in _DOCKER.finditer(re.sub(r"\\\r?\n", " ", text)):
        what, given = m[1].upper(), m[2].strip()
        if what == "WORKDIR":
            folder = given.rstrip("/")
        else:
            said[what].append(" ".join(x[2] for x in _LITERAL.finditer(given)) if given.startswith("[") else given)
    both = [f"{said['ENTRYPOINT'][-1]} {said['CMD'][-1]}"] if all(said.values()) else []
    for command in [*said["ENTRYPOINT"], *said["CMD"], *both]:
        for f in run_files(command):
            if not f.startswith("/"):
                yield f
            elif folder and f.startswith(f"{folder}/"):
                yield f[len(folder) + 1 :]


def _value_end(text: str, at: int) -> int:
    """Past the value at ``at``: its closing bracket, or what ends a plain one (outside parentheses)."""
    stack, i = [], at
    bracketed = text[at : at + 1] in ("{", "[")
    while i < len(text):
        c = text[i]
        if c in _CLOSES and (bracketed or c == "("):
            stack.append(_CLOSES[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if bracketed and not stack:
                return i + 1
        elif not bracketed and not stack and c in ",\n}":
            return i
        i += 1
    return i


def _named_values(text: str, key: str) -> Iterator[tuple[str | None, str]]:
    """(name, literal) of every value of ``key``: the members of an object by their names, other values without one."""
    for m in re.finditer(rf"\b{key}\s*:\s*", text):
        end = _value_end(text, m.end())
        if text[m.end() : m.end() + 1] != "{":
            yield from ((None, x[2]) for x in _LITERAL.finditer(text, m.end(), end))
            continue
        at = m.end() + 1
        while k := _KEY.search(text, at, end):
            at = _value_end(text, k.end())
            yield from ((k[2] or k[3], x[2]) for x in _LITERAL.finditer(text, k.end(), min(at, end)))


def _looks_local(path: str) -> bool:
    return path.startswith(("./", "../")) or ("/" in path and bool(CODE.search(path)) and not path.startswith("@"))


def page_scripts(text: str) -> Iterator[tuple[None, str]]:
    """Scripts of a page: those it names, and modules that bodies within it load by path."""
    for m in _SCRIPT.finditer(text):
        tag = m[1] if m[1] is not None else m[3]
        src = _SRC.search(tag)
        if src:
            yield None, src[1]
        for x in _LOADED.finditer(m[2] or "") if not src else ():
            path = x[2] or x[4]
            if path.startswith(("./", "../")) or (path.startswith("/") and not path.startswith("//")):
                yield None, path


def _toml(text: str) -> Iterator[tuple[None, str]]:
    table = _TOML_TABLE.search(text)
    yield from ((None, m[1]) for m in _TOML_MAIN.finditer(text, 0, table.start() if table else len(text)))


#: (kind, pattern of the package's files, paths start at the file's own folder, reader)
RULES: tuple[tuple[str, re.Pattern, bool, Callable], ...] = (
    ("page", re.compile(r"^[^/]+\.html$"), True, page_scripts),
    ("bundler", re.compile(r"^(?:vite|rollup)\.config\.[cm]?[jt]s$"), False, lambda t: ((None, p) for _, p in _named_values(t, "input"))),
    ("webpack", re.compile(r"^webpack(?:\.[\w-]+)*\.config\.[cm]?[jt]s$"), False, lambda t: ((n or "main", p) for n, p in _named_values(t, "entry") if _looks_local(p))),
    ("worker", re.compile(r"^wrangler\.toml$"), False, _toml),
    ("worker", re.compile(r"^wrangler\.jsonc?$"), False, lambda t: ((None, m[1]) for m in _JSON_MAIN.finditer(t))),
    ("image", re.compile(r"^(?:Dockerfile(?:\.[\w.-]+)?|[\w.-]+\.[Dd]ockerfile)$"), False, lambda t: ((None, p) for p in docker_files(t))),
    ("framework", re.compile(r"^(?:docusaurus|astro|nuxt)\.config\.[^/]*$|^(?:.*/)?\.vitepress/config\.[^/]*$"), True, lambda t: ((None, m[2]) for m in _RELATIVE.finditer(t))),
)
#: Paths of which some rule reads the text, to leave all others unread.
READ = "|".join(f"(?:{p.pattern})" for _, p, _, _ in RULES)
LAUNCHES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "target")]))


def launches(path: str, text: str | None) -> list[tuple[str, str | None, str]]:
    """(kind, name, target within the package) of what the file ``path`` of a package names; URLs and what leaves its folder by a URL's marks are cut."""
    out = []
    for kind, pattern, beside, read in RULES:
        if text and pattern.search(path):
            folder = path.rpartition("/")[0] if beside else ""
            for name, target in read(text):
                plain = re.split(r"[?#]", target, maxsplit=1)[0]
                if plain and not URL.match(plain):
                    out.append((kind, name, plain.lstrip("/") if plain.startswith("/") else f"{folder}/{plain}" if folder else plain))
    return list(dict.fromkeys(out))


@F.pandas_udf(LAUNCHES)
def launches_udf(paths: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([launches(p, t) for p, t in zip(paths, texts, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def commands_udf(commands: pd.Series, worker: pd.Series) -> pd.Series:
    """Files that a script's command line starts; a worker's entry only if no configuration names one (``worker``)."""
    return pd.Series([list(dict.fromkeys([*run_files(c), *(worker_files(c) if w else ())])) for c, w in zip(commands, worker, strict=True)])
