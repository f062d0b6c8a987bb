import re

import pytest

from refloom.functions import globs
from refloom.functions.scip import normalize_version, parse_descriptors, parse_symbol
from refloom.functions.semver import satisfies


@pytest.mark.parametrize(
    "path, expected",
    [("src/a.test.ts", True), ("a_test.dart", True), ("test/a.ts", True), ("src/test/x/y.ts", True), ("src/testa/y.ts", False), ("src/setupTests.ts", True), ("src/contest.ts", False), ("test", False)],
)
def test_test_globs(path, expected):
    assert bool(re.match(globs.path_regex(globs.TEST_GLOBS), path)) is expected


def test_glob_lists_are_folders_or_base_names():
    for wanted, n in ((globs.TEST_GLOBS, 38), (globs.DOCS_GLOBS, 6), (globs.GENERATED_GLOBS, 13), (globs.VENDORED_GLOBS, 3), (globs.SCRIPT_GLOBS, 12)):
        assert len(wanted) == len(set(wanted)) == n
        assert all(g.startswith("**/") for g in wanted)
    assert len(globs.TEST_SUPPORT_NAMES) == 24


@pytest.mark.parametrize("glob, path, expected", [("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/b/a.ts", False), ("**/a?.ts", "x/y/ab.ts", True), ("**/a?.ts", "ab.ts", True), ("x/**", "x/y/z", True)])
def test_segment_globs(glob, path, expected):
    assert bool(re.match(globs.segment_glob_regex(glob), path)) is expected


@pytest.mark.parametrize(
    "version, constraint, manager, expected",
    [
        ("1.2.3", "^1.0.0", "npm", True), ("2.0.0", "^1.0.0", "npm", False), ("0.2.5", "^0.2.3", "npm", True), ("0.3.0", "^0.2.3", "npm", False),
        ("0.0.4", "^0.0.3", "npm", False), ("1.2.9", "~1.2.3", "npm", True), ("1.3.0", "~1.2.3", "npm", False), ("1.5.0", "1.x", "npm", True),
        ("1.5.0", "1.2.3 - 1.6", "npm", True), ("1.7.0", "1.2.3 - 1.6", "npm", False), ("1.0.0", "<1.0.0 || >=1.0.0", "npm", True), ("1.0.0", "*", "npm", True),
        ("1.0.0-beta.2", ">=1.0.0-beta.1 <1.0.0", "npm", True), ("1.0.0", "workspace:*", "npm", None), ("1.0.0", "latest", "npm", None), ("1.0.0", "npm:other@^1.0.0", "npm", True),
        ("1.0.0", "file:../x", "npm", None), (None, "^1.0.0", "npm", None), ("x", "^1.0.0", "npm", None), ("0.3.0", "^0.2.3", "pub", False),
        ("0.2.9", "^0.2.3", "pub", True), ("0.0.9", "^0.0.3", "pub", True), ("1.0.0", "any", "pub", True), ("1.5.0", ">=1.0.0 <2.0.0", "pub", True), ("1.0.0", ">1", "npm", False), ("2.0.0", ">1", "npm", True), ("1.9.9", "<=1", "npm", True),
    ],
)
def test_semver(version, constraint, manager, expected):
    assert satisfies(version, constraint, manager) is expected


def test_symbols():
    s = parse_symbol("scip npm my  pkg 1.0.0 src/`a.ts`/Foo#bar().")
    assert (s["manager"], s["name"], s["version"]) == ("npm", "my pkg", "1.0.0")
    found = parse_descriptors(s["descriptors"])
    assert [(d["name"], d["suffix"]) for d in found] == [("src", "namespace"), ("a.ts", "namespace"), ("Foo", "type"), ("bar", "method")]
    assert parse_symbol("local 3")["local"] and parse_symbol("nonsense") is None and parse_symbol(None) is None
    assert normalize_version("scip npm pkg 1.0.0 a/") == "scip npm pkg . a/"
    assert parse_descriptors("a#[T]b.(p)") is not None and parse_descriptors("") is None


def test_blanking_keeps_offsets():
    from refloom.functions.source_text import blank_comments, blank_strings

    text = "a('http://x') // note\n/* b\n c */ d(`e // f`)\nimport x from 'pkg'; g(\"h\")"
    bare = blank_comments(text)
    assert len(bare) == len(text) and bare.count("\n") == text.count("\n")
    assert "http://x" in bare and "note" not in bare and " c " not in bare and "e // f" in bare
    quiet = blank_strings(text)
    assert len(quiet) == len(text) and "'pkg'" in quiet and "http" not in quiet and '"h"' not in quiet
    assert blank_comments(None) is None and blank_strings("'open") == "     "
    assert blank_strings("`a ${b} c` + d") == "   ${b}    + d"
    dart = "var s = '''a $name ${f(1)}\n''' r'$x'; @JS('keep')"
    shown = blank_strings(dart, True)
    assert len(shown) == len(dart) and "$name" in shown and "${f(1)}" in shown and "$x" not in shown and "'keep'" in shown


def test_pubspec():
    from refloom.sources.manifests import parse_pubspec

    p = parse_pubspec("name: a # x\nversion: '1.0.0'\npublish_to: none\ndependencies:\n  b: ^1.2.0\n  c:\n    path: ../c\n  d:\n    version: 2.0.0\ndev_dependencies:\n  e: any\nflutter:\n  f: 1\n")
    assert (p["name"], p["version"], p["publish_to"]) == ("a", "1.0.0", "none")
    assert p["dependencies"] == {"b": "^1.2.0", "c": None, "d": "2.0.0"} and p["dev_dependencies"] == {"e": "any"}
    assert parse_pubspec(None)["dependencies"] == {}


def test_npm_manifests(spark):
    from pyspark.sql import functions as F

    from refloom.sources.manifests import npm_dependencies, npm_visibility, pub_visibility

    rows = [("r", "a", '{"private":true,"dependencies":{"x":"^1"},"devDependencies":{"x":"2","y":"3"}}'), ("r", "b", '{"publishConfig":{"registry":"https://npm.corp.test/"}}'), ("r", "c", '{"publishConfig":{"registry":"https://registry.npmjs.org"}}'), ("r", "d", "{")]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    assert {tuple(r) for r in npm_dependencies(df).collect()} == {("r", "a", "x", "^1", False), ("r", "a", "y", "3", True)}
    got = {r[0]: r[1] for r in df.select("path", npm_visibility(F.col("text"))).collect()}
    assert got == {"a": "private", "b": "published-private", "c": "published-public", "d": "published-public"}
    pub = spark.createDataFrame([("none",), (None,), ("https://pub.dev",), ("https://x.test",)], "p string").select(pub_visibility(F.col("p"))).collect()
    assert [r[0] for r in pub] == ["private", "published-public", "published-public", "published-private"]
