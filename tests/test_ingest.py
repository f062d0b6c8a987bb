"""Ingest, checkouts and the text witness over hand-built rows."""

import pytest

from refloom.functions.text import minimum_pushed, normalized_path
from refloom.operators.ingest import Ingest, status_reason
from refloom.schema import TABLES
from refloom.sources.readers import INDEX, SIDECAR, source_files


def test_paths_and_cutoffs(spark):
    df = spark.createDataFrame([("./a//b/../c.ts", "a/c.ts"), ("../x", "../x"), ("a\\b", "a/b"), ("a/../../b", "../b"), (".", ""), ("", "")], "p string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", normalized_path(df["p"])).collect())
    assert minimum_pushed("2d", 200_000) == 200_000 - 172_800 and minimum_pushed("1970-01-02", 0) == 86_400 == minimum_pushed("1970-01-02T01:00:00+01:00", 5)


def test_status_reasons(spark):
    rows = [(["info: a", "cause: x", "warn: w", "cause: y\nmore"], "y"), (["info: a", "warn: w", "error: e\n2"], "error: e"), (["info: a", "warn: w"], "warn: w"), (["info: a"], "info: a"), ([], None), (None, None), ([""], None)]
    df = spark.createDataFrame(rows, "d array<string>, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", status_reason(df["d"])).collect())


def test_sources_of_checkouts(spark):
    paths = ["src/a.ts", "build/out.js", "dist/package.json", "dist/x.js", "dist/sub/y.js", "node_modules/m/a.js", "vendor/v.ts", "a/.cache/z.js", "lib/build/q.js", "builder/ok.ts"]
    files = spark.createDataFrame([(r, p) for r in ("plain", "git") for p in paths], "repo string, path string")
    listed = spark.createDataFrame([("git", p) for p in ("src/a.ts", "build/out.js", "vendor/v.ts", "node_modules/m/a.js", "gone.ts")], "repo string, path string")
    got = {(r["repo"], r["path"]) for r in source_files(files, listed).collect()}
    assert {p for r, p in got if r == "plain"} == {"src/a.ts", "dist/package.json", "dist/x.js", "dist/sub/y.js", "builder/ok.ts"}
    assert {p for r, p in got if r == "git"} == {"src/a.ts", "build/out.js", "vendor/v.ts"}


def occurrence(symbol, role=0, at=(1, 0, 3), body=None):
    return (symbol, role, list(at), list(body) if body else None)


def build(spark, docs, packages, deps=(), exports=(), status="ok"):
    """``docs``: (package_id, relative path, kinds, occurrences)."""
    by = {}
    for pid, path, kinds, occs in docs:
        by.setdefault(pid, []).append((path, kinds, occs))
    index = spark.createDataFrame([(pid, k, d) for k, (pid, d) in enumerate(by.items())], INDEX)
    empty = spark.createDataFrame([], SIDECAR)
    rows = [tuple(dict(x).get(c) for c in empty.columns) for x in exports]
    sidecars = spark.createDataFrame(rows, SIDECAR)
    manifest = spark.createDataFrame([(p[0], status, None) for p in packages], "package_id string, status string, diagnostics array<string>")
    pk = spark.createDataFrame([(pid, repo, path, m, name, entries) for pid, repo, path, m, name, entries in packages], "package_id string, repo string, path string, manager string, name string, entry_points array<string>")
    return Ingest(pk, spark.createDataFrame(list(deps), TABLES["package_deps"]), index, sidecars, manifest)


def named(i):
    return {r["symbol_id"]: r["symbol_str"] for r in i.symbols.collect()}


def test_ingest_of_shared_and_missing_names(spark):
    """Two repositories share a package name; a nameless package keeps its symbols to itself; a third repository depends on one of the two."""
    a, b, c, d = "npm:r1:lib", "npm:r2:lib", "npm:r3:app", "npm:r3:_unnamed/x"
    packages = [(a, "r1", ".", "npm", "lib", ["src/a.ts"]), (b, "r2", ".", "npm", "lib", []), (c, "r3", "app", "npm", "app", []), (d, "r3", "x", "npm", "_unnamed/x", [])]
    lib, nameless = "scip-typescript npm lib 1.0.0 src/`a.ts`/", "scip-typescript npm . . "
    docs = [
        (a, "src/a.ts", [(lib + "F#", 7)], [occurrence(lib, 1, (0, 0, 0)), occurrence(lib + "F#", 1, (2, 0, 1), (2, 0, 9, 0)), occurrence(lib + "F#m().", 1, (3, 2, 4), (3, 0, 4, 0)), occurrence(lib + "F#m().(x)", 1, (3, 5, 6)), occurrence(lib + "F#", 0, (3, 8, 9))]),
        (b, "src/a.ts", [], [occurrence(lib + "F#", 1, (2, 0, 1))]),
        (c, "../app/./m.ts", [], [occurrence(lib + "F#", 0, (1, 0, 1)), occurrence(lib + "F#gone().", 0, (2, 0, 1)), occurrence(lib + "F#`<constructor>`().", 0, (3, 0, 1)), occurrence(lib + "F#typeLiteral0:a.b.", 0, (4, 0, 1)), occurrence("local 1", 1), occurrence(lib + "", 0, (5, 0, 1))]),
        (c, "node_modules/z.ts", [], [occurrence(lib + "F#", 0)]),
        (d, "m.ts", [], [occurrence(nameless + "`m.ts`/", 1, (0, 0, 0)), occurrence(nameless + "`m.ts`/cn().", 1, (1, 0, 2)), occurrence(lib + "F#", 0, (1, 0, 1))]),
    ]
    deps = [(c, "npm", "lib", "*", b, False, "published", False)]
    i = build(spark, docs, packages, deps)
    names = named(i)
    ours, theirs = lib.replace("1.0.0", a), lib.replace("1.0.0", b)
    assert set(names.values()) == {ours, ours + "F#", ours + "F#m().", theirs + "F#", f"file {b} src/a.ts", f"file {c} app/m.ts", f"scip-typescript npm _unnamed/x {d} `m.ts`/", f"scip-typescript npm _unnamed/x {d} `m.ts`/cn()."}
    s = {r["symbol_str"]: r for r in i.symbols.collect()}
    assert s[ours + "F#"]["kind"] == "class" and names[s[ours + "F#m()."]["parent_symbol_id"]] == ours + "F#" and s[ours + "F#"]["parent_symbol_id"] is None
    assert s[ours]["name"] == "src/a.ts" and s[ours + "F#m()."]["name"] == "m"
    occ = {(names[r["symbol_id"]], r["package_id"], r["line"], r["role"], names[r["enclosing_symbol_id"]], r["is_external"]) for r in i.occurrences.collect()}
    assert (ours + "F#", a, 3, 0, ours + "F#m().", False) in occ and (ours + "F#", a, 2, 1, ours, False) in occ
    assert {x[:3] for x in occ if x[1] == c} == {(theirs + "F#", c, 1), (theirs + "F#", c, 3), (theirs + "F#", c, 4)}  # the constructor and the literal are the class's
    assert [(r["target_package_id"], r["symbol_str"]) for r in i.unresolved_refs.collect()] == [(b, lib.replace("1.0.0", ".") + "F#gone().")]
    flags = {(r["package_id"], r["flag"], r["target_package_id"]) for r in i.package_flags.collect()}
    assert {(d, "ambiguous_dep", a), (d, "ambiguous_dep", b)} <= flags and (c, "ambiguous_dep", a) not in flags
    assert {(r["package_id"], r["file"], r["is_entry"]) for r in i.documents.collect()} == {(a, "src/a.ts", True), (b, "src/a.ts", False), (c, "app/m.ts", False), (d, "x/m.ts", False)}


def test_ingest_prefers_the_owner_and_keeps_anonymous_defaults(spark):
    root, inner = "npm:r:root", "npm:r:inner"
    packages = [(root, "r", ".", "npm", "root", []), (inner, "r", "pkgs/in", "npm", "inner", [])]
    mine = "scip-typescript npm inner 1.0.0 src/`d.ts`/"
    docs = [
        (root, "pkgs/in/src/d.ts", [], [occurrence(mine + "old().", 1)]),
        (root, "u.ts", [], [occurrence(mine, 0, (7, 0, 1))]),
        (inner, "src/d.ts", [], [occurrence(mine, 1, (0, 0, 0)), occurrence(mine + "f().", 1, (1, 0, 1))]),
    ]
    export = ("pkgs/in/src/d.ts", "default", "default", "pkgs/in/src/d.ts", 4, 7, [], "default-keyword")
    named_ = ("pkgs/in/src/d.ts", "f", "f", "pkgs/in/src/d.ts", 1, 0, [("u.ts", 7, 0)], None)
    i = build(spark, docs, packages, exports=[{"packageId": inner, "exports": [export]}, {"packageId": root, "exports": []}])
    names = named(i)
    made = f"default {inner} pkgs/in/src/d.ts"
    module = mine.replace("1.0.0", ".")
    assert set(names.values()) == {module, module + "f().", "file npm:r:root u.ts", made}
    assert {r["symbol_str"] for r in i.symbols.where("is_exported").collect()} == {made}
    assert {(names[r["symbol_id"]], r["line"], r["is_external"]) for r in i.occurrences.where("role = 0").collect()} == {(module, 7, True), (made, 7, True)}
    edges = {(names[r["from_symbol_id"]], names[r["to_symbol_id"]]) for r in i.edges.collect()}
    assert edges == {("file npm:r:root u.ts", module), ("file npm:r:root u.ts", made), (made, module)}
    i = build(spark, docs, packages, exports=[{"packageId": inner, "exports": [named_]}, {"packageId": root, "exports": []}])
    assert i.edges.count() == 0 and [r["exported_as"] for r in i.symbol_exports.collect()] == ["f"]  # an export clause is no use


def test_invalid_symbols_fail_their_package_only(spark):
    a, b = "npm:r:a", "npm:r:b"
    packages = [(a, "r", "a", "npm", "a", []), (b, "r", "b", "npm", "b", [])]
    docs = [(a, "x.ts", [], [occurrence("scip-typescript npm a 1 Foo#==().", 0), occurrence("scip-typescript npm a 1 `x.ts`/f().", 1)]), (b, "y.ts", [], [occurrence("scip-typescript npm far 1 a b", 0), occurrence("scip-typescript npm b 1 `y.ts`/g().", 1)])]
    i = build(spark, docs, packages, exports=[{"packageId": b}])
    assert {r["package_id"] for r in i.symbols.collect()} == {b}
    assert [(r["package_id"], r["flag"], r["reason"]) for r in i.package_flags.collect()] == [(a, "index_failed", 'invalid symbol "scip-typescript npm a 1 Foo#==()."')]


# --- witness ------------------------------------------------------------------------------


@pytest.mark.parametrize("text, token, member", [("x.foo", "foo", True), ("x.foobar(foo)", "foo", False), ("...foo", "foo", False), ("x?.\n  foo", "foo", True), ("a..foo()", "foo", True), ("foo; x.foo", "foo", False), ("'$foo'", "foo", False), ("a$foo", "foo", False), ("$foo", "$foo", False)])
def test_identifiers_know_what_stands_before(spark, text, token, member):
    from refloom.operators.witness import identifiers

    df = spark.createDataFrame([("p", "f", text)], "package_id string, file string, text string")
    found = {r["token"]: r["member"] for r in identifiers(df).collect()}
    assert found[token] is member and "foob" not in found


def test_indexed_files_follow_the_index(spark):
    """In a file that the index saw: an access, a name of another symbol, a string and a comment are no use; what the index does not know is."""
    from test_analysis import Org

    from refloom.operators.witness import witness_hits

    o = Org(spark)
    a, c = o.pkg("a"), o.pkg("c")
    o.doc(c, "src/in.ts")
    foo = o.sym(a, "foo")
    other = o.sym(c, "foo", "src/in.ts")
    o.ref(other, c, c, "src/in.ts", line=3)  # 0-based: the fourth line names another foo
    o.rows["package_deps"].append((c, "npm", "a", "*", a, False, "name", False))
    o.rows["symbol_exports"].append((foo, "src/a.ts", "foo"))
    text = "import { foo } from 'a'\nx.foo()\n'foo' /* foo */ // foo\nfoo()\n`${foo}`\n"
    files = spark.createDataFrame([(c, "src/in.ts", text), (c, "src/out.ts", text), (c, "src/none.ts", "import z from 'b'\nfoo"), (c, "notes.md", text)], "package_id string, file string, text string")
    pending = spark.createDataFrame([(foo,)], "symbol_id long")
    got = {(r["file"], r["line"]) for r in witness_hits(o.run(), pending, files).collect()}
    assert {n for f, n in got if f == "src/in.ts"} == {1, 5}
    assert {n for f, n in got if f == "src/out.ts"} == {1, 2, 3, 4, 5} and {f for f, _ in got} == {"src/in.ts", "src/out.ts"}


def test_specifiers_must_reach_an_entry(spark):
    from test_analysis import Org

    from refloom.operators.witness import witness_hits

    o = Org(spark)
    a, c = o.pkg("a", path="pkgs/a"), o.pkg("c")
    foo, main = o.sym(a, "foo", "pkgs/a/src/deep/foo.ts"), o.sym(a, "Main", "pkgs/a/src/index.ts")
    o.rows["package_deps"].append((c, "npm", "a", "*", a, False, "name", False))
    o.rows["symbol_exports"] += [(foo, "pkgs/a/src/deep/foo.ts", "foo"), (main, "pkgs/a/src/index.ts", "default")]
    texts = {"bare.ts": "import { foo } from 'a'", "seg.ts": "import { foo } from 'a/x/foo.js'", "path.ts": "import { foo } from 'a/deep/foo'", "other.ts": "import { foo } from 'a/other'", "star.ts": "import { foo } from 'a/things/foo'", "default.ts": "import Anything from 'a'", "named.ts": "import { Thing } from 'a'"}
    files = spark.createDataFrame([(c, f, t) for f, t in texts.items()], "package_id string, file string, text string")
    pending = spark.createDataFrame([(foo,), (main,)], "symbol_id long")
    an = o.run()
    manifests = spark.createDataFrame([(a, ".", "./dist/index.js"), (a, "./things/*", "./dist/deep/*.js")], "package_id string, key string, target string")
    got = {(r["symbol_id"], r["file"]) for r in witness_hits(an, pending, files, manifests).collect()}
    assert {f for s, f in got if s == foo} == {"seg.ts", "path.ts", "star.ts"} and {f for s, f in got if s == main} == {"default.ts"}
    got = {(r["symbol_id"], r["file"]) for r in witness_hits(an, pending, files).collect()}  # no manifest to read: the bare name reaches all
    assert {f for s, f in got if s == foo} == {"bare.ts", "seg.ts", "path.ts", "star.ts"}


def test_own_files_outside_the_index(spark):
    from test_analysis import Org

    from refloom.operators.witness import witness_hits

    o = Org(spark)
    a = o.pkg("a")
    o.doc(a, "src/seen.ts")
    foo = o.sym(a, "foo", "scripts/run.ts")
    o.rows["symbol_exports"].append((foo, "scripts/run.ts", "foo"))
    files = spark.createDataFrame([(a, "scripts/run.ts", "import * as own from 'a'\nexport const foo = 1\nfoo"), (a, "scripts/re.ts", "export { foo } from 'a'\nfoo()\n'foo'"), (a, "src/seen.ts", "import { foo } from 'a'\nfoo")], "package_id string, file string, text string")
    got = {(r["package_id"], r["file"], r["line"]) for r in witness_hits(o.run(), spark.createDataFrame([(foo,)], "symbol_id long"), files).collect()}
    assert got == {("self", "scripts/run.ts", 3), ("self", "scripts/re.ts", 2)}


def test_stages_follow_each_other(spark, tmp_path):
    from refloom.operators import stages
    from refloom.operators.analysis import Policy

    path, policy = str(tmp_path / "org"), Policy(min_age_days=0, now=100)
    lib, app = "npm:r:lib", "npm:r:app"
    packages = [(lib, "r", "lib", "npm", "lib", ["lib/a.ts"]), (app, "r", "app", "npm", "app", [])]
    head = "scip-typescript npm lib 1 `a.ts`/"
    docs = [(lib, "a.ts", [], [occurrence(head, 1, (0, 0, 0)), occurrence(head + "used().", 1, (1, 0, 1)), occurrence(head + "free().", 1, (2, 0, 1)), occurrence(head + "named().", 1, (3, 0, 1))]), (app, "m.ts", [], [occurrence(head + "used().", 0, (5, 0, 1))])]
    exports = [("lib/a.ts", n, n, "lib/a.ts", k, 0, [], None) for k, n in ((1, "used"), (2, "free"), (3, "named"))]
    deps = [(app, "npm", "lib", "*", lib, False, "name", False)]
    i = build(spark, docs, packages, deps, [{"packageId": lib, "exports": exports}, {"packageId": app}])
    with pytest.raises(stages.StageOrder):
        stages.ingest(spark, build(spark, [], packages), {}, path)
        stages.analyze(spark, path, policy)
    others = {
        "packages": i.packages.selectExpr("*", "'private' AS visibility", "true AS is_library", "'1.0.0' AS version"),
        "package_deps": i.deps, "repos": spark.createDataFrame([("r", "main", None, None, "ok")], TABLES["repos"]), "repo_history": spark.createDataFrame([("r", "none")], TABLES["repo_history"]),
    }
    stages.ingest(spark, i, others, path)
    files = spark.createDataFrame([(app, "scripts/x.js", "import { named } from 'lib'")], "package_id string, file string, text string")
    with pytest.raises(stages.StageOrder):
        stages.check_by_text(spark, path, policy, files)
    assert {tuple(r) for r in stages.analyze(spark, path, policy).collect()} == {("needs_review", 2)}
    assert {tuple(r) for r in stages.check_by_text(spark, path, policy, files).collect()} == {("needs_review", 1), ("deletion_candidate", 1)}
    stages.write_report(spark, path, policy, str(tmp_path / "report"))
    assert [r["symbol"] for r in spark.read.parquet(str(tmp_path / "report/findings")).where("view = 'delete'").collect()] == ["free"]
    assert {r["kind"] for r in spark.read.json(str(tmp_path / "report/warnings")).collect()} == {"age"}
