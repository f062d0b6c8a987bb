"""Entry points from manifests' text and lists of files."""

import json

import pytest

from refloom.operators.entries import Entries, exports_map, manifest_leaves

#: name -> (manifest, files, entries as file or (file, mark), leaves that lead nowhere); marks: r is run, f is a fallback.
CASES = {
    "built_main": ({"main": "dist/index.js", "types": "./dist/index.d.ts"}, ["src/index.ts"], ["src/index.ts"], []),
    "source_beside": ({"main": "main.js", "module": "./lib.mjs"}, ["main.ts", "lib.mts"], ["main.ts", "lib.mts"], []),
    "probed": ({"main": "lib/a", "module": "./b", "browser": "c.js"}, ["lib/a.tsx", "b/index.js", "b.txt", "c.js"], ["lib/a.tsx", "b/index.js", "c.js"], []),
    "nested": (
        {"exports": {".": {"import": {"types": "./dist/x.d.mts", "default": "./dist/x.mjs"}, "require": None}, "./y": ["./gone.js", {"node": {"browser": "./dist/y/index.js"}}], "./package.json": "./package.json", "./n": 3}},
        ["src/x.ts", "src/y.tsx", "package.json"], ["src/x.ts", "src/y.tsx"], [],
    ),
    "conditions": ({"exports": {"import": "./m.js", "default": "./none.js"}}, ["m.js"], ["m.js"], []),
    "text_and_list": ({"exports": ["./none.js", "./k.js"]}, ["k.js"], ["k.js"], []),
    "pattern": ({"exports": {"./*": "./dist/sub/*.js", "./deep/*": "./src/*/*.ts"}}, ["src/sub/a.ts", "src/sub/b/c.tsx", "src/sub/.d.ts", "src/q/q.ts", "src/q/r.ts", "src/sub/e.md"], ["src/sub/a.ts", "src/sub/b/c.tsx", "src/q/q.ts"], []),
    "pattern_published": ({"exports": {"./*": "./*"}, "files": ["lib", "!lib/no", "*.mts"]}, ["lib/a.js", "lib/sub/b.js", "library.js", "x/e.mts", "test.js", "dist/o.js", "LICENSE"], ["lib/a.js", "lib/sub/b.js", "x/e.mts"], []),
    "pattern_committed": ({"exports": {"./*": "./dist/*.js"}}, ["dist/a.js", "src/a.ts"], ["dist/a.js"], []),
    "pattern_gone": ({"exports": {"./*": "./dist/none/*.js"}}, ["src/a.ts"], [("src/index.ts", "f")] * 0, ["./dist/none/*.js"]),
    "missing": ({"main": "./nope.js", "types": "types/x.d.ts", "exports": {"./a": "./a.js", "./b": {"x": "./b.css", "y": "./b.js"}, "./c": {"x": "./c1.js", "y": "./ok.js"}}}, ["ok.js"], ["ok.js"], ["./nope.js", "types/x.d.ts", "./a.js", "./b.js"]),
    "away": ({"main": "../other.js", "module": "/abs.js", "types": "a/../../b.ts"}, ["other.js", "index.tsx"], [("index.tsx", "f")], []),
    "runs": ({"bin": {"x": "./cli.js", "y": "bin/run", "z": "bin/data.json"}, "main": "m.js"}, ["cli.ts", "bin/run", "m.js", "bin/data.json"], ["m.js", ("cli.ts", "r"), ("bin/run", "r")], []),
    "run_and_imported": ({"bin": "./m.js", "main": "m.js"}, ["m.js"], ["m.js"], []),
    "runs_only": ({"bin": "./c.js"}, ["c.js", "index.ts"], [("c.js", "r")], []),
    "imports": ({"main": "m.js", "imports": {"#c": {"node": "./lib/n.mjs", "default": "./lib/d.mjs"}, "#p": "pkg", "x": "./m2.js", "#s/*": "./s/*.js"}}, ["m.js", "lib/n.mjs", "lib/d.mjs", "m2.js", "s/a.js", "s/b/c.js"], ["m.js", ("lib/n.mjs", "r"), ("lib/d.mjs", "r"), ("s/a.js", "r"), ("s/b/c.js", "r")], []),
    "fallback": ({"name": "x"}, ["src/index.ts", "index.mjs"], [("index.mjs", "f")], []),
    "nothing": ({}, ["a.ts"], [], []),
    "formats": ({"main": "lib/commonjs/index.js", "types": "lib/typescript/commonjs/index.d.ts", "exports": {"./server": "./dist/default-entry/esm/server.js"}}, ["src/index.ts", "src/default-entry/server.ts"], ["src/index.ts", "src/default-entry/server.ts"], []),
    "source_field": ({"main": "lib/x/y/z/index.js", "source": "src/index.tsx"}, ["src/index.tsx"], ["src/index.tsx"], []),
    "source_condition": ({"main": "lib/x/y/z/index.js", "exports": {".": {"source": "./src/a.ts", "default": "./gone.js"}}}, ["src/a.ts"], ["src/a.ts"], []),
    "cut": ({"main": "dist/web/foo.js", "module": "dist/a/b/bar.js"}, ["src/foo.ts", "src/b/bar.mts"], ["src/foo.ts", "src/b/bar.mts"], []),
    "cut_taken": ({"main": "dist/web/foo.js", "module": "dist/gone/x/index.js"}, ["src/foo.ts", "src/web/other.ts", "src/index.ts"], [("src/index.ts", "f")], ["dist/web/foo.js", "dist/gone/x/index.js"]),
    "inner_source": ({"types": "dist/esm/src/index.d.ts"}, ["src/index.mjs"], ["src/index.mjs"], []),
    "hand_written": ({"types": "dist/t.d.mts"}, ["src/t.d.ts"], ["src/t.d.ts"], []),
    "layout": ({"main": "./index.cjs", "types": "./index.d.ts"}, ["src/index.ts", "src/pg/index.ts", "src/pg/deep/index.js", "src/pg/x.ts"], ["src/index.ts", "src/pg/index.ts", "src/pg/deep/index.js"], []),
    "layout_mapped": ({"main": "./index.cjs", "exports": {"./pg": "./pg"}}, ["src/index.ts", "src/pg/index.ts", "src/mysql/index.ts"], ["src/index.ts", "src/pg/index.ts"], []),
    "named_folder": ({"main": "dist-electron/main.js", "module": "preload-dist/p.js", "types": "build-x/q.js"}, ["src/electron/main.ts", "preload/p.js", "src/q.mts"], ["src/electron/main.ts", "preload/p.js", "src/q.mts"], []),
    "nested_build": ({"main": "plugin/build/index.js", "module": "a/node_modules/b/build/x.js"}, ["plugin/src/index.ts", "a/node_modules/b/src/x.ts"], ["plugin/src/index.ts"], ["a/node_modules/b/build/x.js"]),
    "configured": ({"main": "out/main/a.js", "types": "out/types/deep/b.d.ts", "module": "out/c.js"}, ["code/a.mts", "code/deep/b/index.ts", "lib2/c.js"], ["code/a.mts", "code/deep/b/index.ts", "lib2/c.js"], []),
    "named_input": ({"main": "dist/node/internal.js", "module": "dist/a/b/internal.js"}, ["in/n.ts"], ["in/n.ts"], ["dist/a/b/internal.js"]),
    "no_text": (None, ["index.js"], [("index.js", "f")], []),
    "no_object": ([1], ["index.js"], [("index.js", "f")], []),
}


@pytest.fixture(scope="module")
def entries(spark):
    """All cases at once, each in a repository of its own: every third in its root, the others in a folder."""
    place = lambda k: ("", "pkgs/a.b", "x")[k % 3]
    join = lambda d, f: f"{d}/{f}" if d else f
    manifests = [(name, place(k), None if m is None else json.dumps(m)) for k, (name, (m, *_)) in enumerate(CASES.items())]
    files = [(name, join(place(k), f)) for k, (name, (_, fs, *_)) in enumerate(CASES.items()) for f in fs] + [("nothing", "elsewhere/index.ts"), ("built_main", None)]
    where = dict((n, d) for n, d, _ in manifests)
    out_dirs = [("configured", where["configured"], o, r) for o, r in (("out/main", "code"), ("out/types", "code"), ("out", "lib2"))]
    named = [("named_input", where["named_input"], "internal", "in/n.ts")]
    return Entries(
        spark.createDataFrame(manifests, "repo string, dir string, text string"), spark.createDataFrame(files, "repo string, path string"),
        spark.createDataFrame(out_dirs, "repo string, dir string, out_dir string, root_dir string"), spark.createDataFrame(named, "repo string, dir string, name string, source string"),
    )


def test_entry_points(entries):
    got = {}
    for r in entries.found.collect():
        rel = r["file"][len(r["dir"]) + 1 :] if r["dir"] else r["file"]
        got.setdefault(r["repo"], set()).add((rel, "r" if r["runtime"] else "f" if r["fallback"] else ""))
    want = {name: {e if isinstance(e, tuple) else (e, "") for e in found} for name, (_, _, found, _) in CASES.items() if found}
    assert {n: got.get(n, set()) for n in CASES if got.get(n, set()) != want.get(n, set())} == {}


def test_leaves_that_lead_nowhere(entries):
    got = {}
    for r in entries.unresolved.collect():
        got.setdefault(r["repo"], set()).add(r["target"])
    assert got == {name: set(missing) for name, (*_, missing) in CASES.items() if missing}


def test_leaves_and_the_witness_table(spark):
    text = json.dumps({"main": "m.js", "exports": {".": {"a": {"b": ["./x.js", {"c": "./y.js"}]}}, "./s/*": "./s/*.js", "#no": "./z.js"}})
    manifests = spark.createDataFrame([("r", "", text), ("r", "p", '{"exports": "./o.js"}'), ("r", "q", "{}"), ("r", "bad", "{"), ("r", "none", None)], "repo string, dir string, text string")
    leaves = manifest_leaves(manifests)
    assert {(r["dir"], r["field"], r["key"], r["target"]) for r in leaves.collect()} == {("", "main", None, "m.js"), ("", "exports", ".", "./x.js"), ("", "exports", ".", "./y.js"), ("", "exports", "./s/*", "./s/*.js"), ("p", "exports", ".", "./o.js")}
    packages = spark.createDataFrame([("A", "r", "."), ("P", "r", "p"), ("Q", "r", "q"), ("B", "r", "bad"), ("N", "r", "none")], "package_id string, repo string, path string")
    got = {(r["package_id"], r["key"], r["target"]) for r in exports_map(leaves, manifests, packages).collect()}
    assert got == {("A", ".", "m.js"), ("A", ".", "./x.js"), ("A", ".", "./y.js"), ("A", "./s/*", "./s/*.js"), ("A", ".", None), ("P", ".", "./o.js"), ("P", ".", None), ("Q", ".", None)}
