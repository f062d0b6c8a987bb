"""Uses that sidecars tell, and signatures read from texts, over hand-built indexes."""

import pytest
from test_ingest import named, occurrence

from refloom.functions.heads import Lines, head_end, head_of
from refloom.operators.ingest import Ingest
from refloom.plans import testunseen
from refloom.schema import TABLES
from refloom.sources.readers import INDEX, SIDECAR

SIGNATURE, ERROR_CLASS = 1 << 20, 1 << 21


def build(spark, docs, packages, sidecars, files=None, deps=(), edges=None):
    """``docs``: (package_id, path, occurrences); ``packages``: (package_id, repo, path, manager, name, entries); ``sidecars``: dicts."""
    by = {}
    for pid, path, occs in docs:
        by.setdefault(pid, []).append((path, [], occs))
    index = spark.createDataFrame([(pid, k, d) for k, (pid, d) in enumerate(by.items())], INDEX)
    fields = spark.createDataFrame([], SIDECAR).schema
    rows = [tuple(dict(x).get(f.name) for f in fields) for x in sidecars]
    manifest = spark.createDataFrame([(p[0], "ok", None) for p in packages], "package_id string, status string, diagnostics array<string>")
    pk = spark.createDataFrame(list(packages), "package_id string, repo string, path string, manager string, name string, entry_points array<string>")
    text = None if files is None else spark.createDataFrame(files, "repo string, path string, text string")
    extra = None if edges is None else spark.createDataFrame(edges, "repo string, from string, to string")
    return Ingest(pk, spark.createDataFrame(list(deps), TABLES["package_deps"]), index, spark.createDataFrame(rows, SIDECAR), manifest, text, extra)


# --- heads of declarations ----------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want, dart",
    [
        ("f(a: A): R {\n}", (0, 7), True),
        ("f(a: A): R {\n}", (0, 11), False),
        ("f(a: { b: B }): { c: C } {", (0, 25), False),
        ("f<T extends Map<K, V>>(\n  a: A,\n): Promise<R> {", (2, 14), False),
        ("f(cb: (x: X) => void) => cb", (0, 22), False),
        ("f(a: A): R;", (0, 10), False),
        ("f(a = `}`, /* ) */ b = \"{\"): R {", (0, 31), False),
        ("f(a = 'it\\'s {', b // {\n) {", (1, 2), False),
        ("f(a == b, c !== d) {", (0, 19), False),
        ("Foo(this.x, {int y = 1}) : assert(x > 0) {", (0, 25), True),
        ("f(a: A) : B | { c: C } {", (0, 23), False),
        ("x) {", None, False),
        ("f(a: A,", None, False),
        ("", None, False),
    ],
)
def test_where_heads_end(text, want, dart):
    end = head_end(text, 0, len(text), dart)
    assert (None if end is None else Lines(text).place(end)) == want


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("const f = async (\n a: A): R => {", "term", (1, 10, False)),
        ("const g: Handler = async function (x: X) {", "term", (0, 41, False)),
        ("const h: T = 1;", "term", (0, 14, False)),
        ("const i: T;", "term", (None, None, False)),
        ("class E extends Error {", "type", (None, None, True)),
        ("class E<T>\n  implements Tagged, HttpException {", "type", (None, None, True)),
        ("class E extends Base { // Error", "type", (None, None, False)),
        ("class E /* extends Error */ extends Base {", "type", (None, None, True)),
        ("private static f(a: A) {", "method", (None, None, False)),
        ("protected f(a: A) {", "method", (0, 18, False)),
    ],
)
def test_heads_of_variables_classes_and_private_members(text, kind, want):
    lines = Lines(text)
    col = min(text.index(x) for x in ("f", "g", "h", "i", "E") if x in text and text[text.index(x) - 1] == " ")
    assert head_of(lines, 0, col, kind, False) == want
    assert head_of(lines, 99, 0, kind, False) == (None, None, False)


def test_heads_reach_two_hundred_lines():
    body = "\n".join(["f("] + ["  // {"] * 210 + [") {"])
    assert head_of(Lines(body), 0, 0, "method", False) == (None, None, False)
    body = "\n".join(["f("] + ["  // {"] * 190 + [") {"])
    assert head_of(Lines(body), 0, 0, "method", False) == (191, 2, False)


def test_signature_and_error_bits(spark):
    a, m = "npm:r:a", "scip-typescript npm a 1.0.0 src/`a.ts`/"
    text = "\n".join(["export function route<T extends Opts>(", "  handlers: Handlers, // {", "): Result {", "  const x: Body = 1;", "}", "class Failed extends Error {", "  private apply(x: Hidden) {}", "}"])
    occs = [
        occurrence(m, 1, (0, 0, 0)), occurrence(m + "route().", 1, (0, 16, 21), (0, 0, 4, 1)), occurrence(m + "Opts#", 0, (0, 32, 36)), occurrence(m + "Handlers#", 0, (1, 12, 20)), occurrence(m + "Result#", 0, (2, 3, 9)),
        occurrence(m + "Body#", 0, (3, 11, 15)), occurrence(m + "Failed#", 1, (5, 6, 12), (5, 0, 7, 1)), occurrence(m + "Failed#apply().", 1, (6, 10, 15), (6, 2, 6, 30)), occurrence(m + "Hidden#", 0, (6, 19, 25)),
        *[occurrence(m + f"{n}#", 1, (20 + k, 6, 9)) for k, n in enumerate(("Opts", "Handlers", "Result", "Body", "Hidden"))],
    ]
    packages, docs = [(a, "r", ".", "npm", "a", [])], [(a, "src/a.ts", occs)]
    seen = []
    for files in (None, [("r", "src/a.ts", text)], [("r", "src/a.ts", None), ("r", "other.ts", text)], [("r", "src/a.ts", text.replace("\n", "\r\n"))]):
        i = build(spark, docs, packages, [{"packageId": a}], files)
        names = named(i)
        seen.append({(names[r["symbol_id"]].split("/")[-1], r["role"] & 1) for r in i.occurrences.where(f"role >= {SIGNATURE}").collect()})
    plain, marked, missing, carriage = seen
    assert plain == missing == set()
    assert marked == carriage == {("Opts#", 0), ("Handlers#", 0), ("Result#", 0), ("Failed#", 1)}


def test_a_document_of_very_many_symbols(spark):
    """Rows do not carry their document's arrays: work grows with symbols, not with their square."""
    a, m = "npm:r:a", "scip-typescript npm a 1.0.0 src/`a.ts`/"
    n = 20_000
    occs = [occurrence(f"{m}f{k}().", 1, (k, 0, 3)) for k in range(n)]
    index = spark.createDataFrame([(a, 0, [("src/a.ts", [(f"{m}f{k}().", 17) for k in range(n)] + [(f"{m}f0().", 7)], occs)])], INDEX)
    pk = spark.createDataFrame([(a, "r", ".", "npm", "a", [])], "package_id string, repo string, path string, manager string, name string, entry_points array<string>")
    i = Ingest(pk, spark.createDataFrame([], TABLES["package_deps"]), index, spark.createDataFrame([], SIDECAR), spark.createDataFrame([(a, "ok", None)], "package_id string, status string, diagnostics array<string>"))
    kinds = {r["kind"]: r["n"] for r in i.interned.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds == {"function": n - 1, "class": 1}  # of a symbol listed twice the later kind counts


# --- conditional imports ------------------------------------------------------------------

FA = "pub:r:fa"


def module(file):
    parts = file.split("/")
    return "scip-dart pub fa 1.0.0 " + "".join(f"{d}/" for d in parts[:-1]) + f"`{parts[-1]}`/"


def dart_docs():
    """fa.dart uses storage.dart, which uses the default's createPlatform; two alternatives have one of their own."""
    at = {f: module(f"lib/{f}") for f in ("fa.dart", "src/storage.dart", "src/none.dart", "src/desktop.dart", "src/web.dart", "src/ext.dart")}
    own = lambda f: occurrence(at[f], 1, (0, 0, 0))
    return at, [
        (FA, "lib/fa.dart", [own("fa.dart"), occurrence(at["fa.dart"] + "start().", 1, (1, 5, 10), (1, 0, 3, 1)), occurrence(at["src/storage.dart"] + "create().", 0, (2, 2, 8))]),
        (FA, "lib/src/storage.dart", [own("src/storage.dart"), occurrence(at["src/storage.dart"] + "create().", 1, (1, 8, 14), (1, 0, 3, 1)), occurrence(at["src/none.dart"] + "createPlatform().", 0, (2, 4, 18))]),
        (FA, "lib/src/none.dart", [own("src/none.dart"), occurrence(at["src/none.dart"] + "createPlatform().", 1, (0, 5, 19), (0, 0, 0, 40))]),
        (FA, "lib/src/desktop.dart", [own("src/desktop.dart"), occurrence(at["src/desktop.dart"] + "createPlatform().", 1, (0, 5, 19), (0, 0, 2, 1)), occurrence(at["src/desktop.dart"] + "_dead().", 1, (5, 5, 19), (5, 0, 6, 1))]),
        (FA, "lib/src/web.dart", [own("src/web.dart"), occurrence(at["src/web.dart"] + "createPlatform.", 1, (0, 8, 22), (0, 0, 2, 1))]),
        (FA, "lib/src/ext.dart", [own("src/ext.dart"), occurrence(at["src/ext.dart"] + "thing().", 1, (0, 5, 13), (0, 0, 1, 1)), occurrence(at["src/ext.dart"] + "_private().", 1, (2, 5, 16), (2, 0, 3, 1))]),
    ]


def conditional(spark, told, exports=()):
    at, docs = dart_docs()
    i = build(spark, docs, [(FA, "r", ".", "pub", "fa", ["lib/fa.dart"])], [{"packageId": FA, "exports": list(exports), "conditionalImports": told}])
    plain = {v.replace("1.0.0", "."): k for k, v in at.items()}
    short = {s: next((f"{plain[m]}:{v[len(m):]}" for m in sorted(plain, key=len, reverse=True) if v.startswith(m)), v) for s, v in named(i).items()}
    return i, short


@pytest.mark.parametrize("target", ["lib/src/none.dart", "lib/src/../src/none.dart"])
def test_alternatives_take_the_uses_of_their_twins(spark, target):
    i, short = conditional(spark, [("lib/src/storage.dart", 0, 0, target, ["lib/src/desktop.dart", "lib/src/web.dart", "package:other/o.dart", "lib/src/missing.dart"], None), ("lib/gone.dart", 0, 0, target, ["lib/src/ext.dart"], None)])
    uses = {(short[r["symbol_id"]], r["file"], r["line"], r["col"], short[r["enclosing_symbol_id"]]) for r in i.conditional_uses.collect()}
    assert uses == {(f"src/{f}", "lib/src/storage.dart", 2, 4, "src/storage.dart:create().") for f in ("desktop.dart:createPlatform().", "web.dart:createPlatform.")}
    edges = {(short[r["from_symbol_id"]], short[r["to_symbol_id"]]) for r in i.edges.collect()}
    assert ("src/storage.dart:create().", "src/web.dart:createPlatform.") in edges and not any(t.endswith("_dead().") for _, t in edges)
    assert i.symbol_exports.count() == i.entry_symbols.count() == 0


@pytest.mark.parametrize("alternatives, uses", [(("desktop", "web"), 3), ((), 1)])
def test_marks_are_read_without_the_other_uses(spark, alternatives, uses):
    at, docs = dart_docs()
    docs[1][2].append(occurrence(at["src/none.dart"] + "createPlatform().", 0, (1, 15, 29)))
    docs = [d for d in docs if not d[1].endswith(("desktop.dart", "web.dart")) or alternatives]
    told = ("lib/src/storage.dart", 0, 0, "lib/src/none.dart", ["lib/src/desktop.dart", "lib/src/web.dart"], None)
    text = "\nHandler create(createPlatform x) {\n    createPlatform();\n}"
    i = build(spark, docs, [(FA, "r", ".", "pub", "fa", ["lib/fa.dart"])], [{"packageId": FA, "conditionalImports": [told]}], [("r", "lib/src/storage.dart", text)])
    got = sorted(tuple(r) for r in testunseen.BUILDS["i9_signature_bits"](i).collect())
    # uses are lent only where a declaration of the repository has the name of a marked one
    assert bool({"_used", "_conditional"} & set(vars(i))) == bool(alternatives)
    names = named(i)
    want = i.occurrences.where(f"role >= {SIGNATURE}").collect()
    assert got == sorted((names[r["symbol_id"]], r["package_id"], r["file"], r["line"], r["col"], r["role"]) for r in want) and len(got) == uses
    assert {x[2:] for x in got} == {("lib/src/storage.dart", 1, 15, SIGNATURE)}


def test_alternatives_without_a_default_are_kept_whole(spark):
    i, short = conditional(spark, [("lib/fa.dart", 7, 3, "dart:io", ["lib/src/ext.dart"], None)])
    edges = {(short[r["from_symbol_id"]], short[r["to_symbol_id"]]) for r in i.conditional_edges.collect()}
    assert edges == {(f, f"src/ext.dart:{t}") for f in ("fa.dart:", "fa.dart:start().") for t in ("thing().", "_private().")}
    assert i.conditional_uses.count() == 0 and i.entry_symbols.count() == 0
    i, short = conditional(spark, [("lib/fa.dart", 7, 3, "dart:io", ["lib/src/ext.dart"], "export")])
    assert [(short[r["symbol_id"]], r["kind"]) for r in i.entry_symbols.collect()] == [("src/ext.dart:thing().", "runtime")]


@pytest.mark.parametrize("directive, more", [("export", {"desktop", "web"}), ("import", set()), (None, set())])
def test_alternatives_of_an_export_are_exported(spark, directive, more):
    surface = [("lib/fa.dart", "createPlatform", "createPlatform", "lib/src/none.dart", 0, 5, [], None)]
    i, short = conditional(spark, [("lib/fa.dart", 0, 0, "lib/src/none.dart", ["lib/src/desktop.dart", "lib/src/web.dart"], directive)], surface)
    files = {r["file"] for r in i.symbols.where("is_exported").collect()}
    assert files == {"lib/src/none.dart"} | {f"lib/src/{m}.dart" for m in more}
    assert {(r["entry_file"], r["exported_as"]) for r in i.symbol_exports.collect()} == {("lib/fa.dart", "createPlatform")}


# --- checkers, spreads, imports -----------------------------------------------------------


def two_packages():
    a, b = "npm:r:a", "npm:r:b"
    lib, app = "scip-typescript npm a 1.0.0 src/`a.ts`/", "scip-typescript npm b 1.0.0 `m.ts`/"
    docs = [
        (a, "src/a.ts", [occurrence(lib, 1, (0, 0, 0)), occurrence(lib + "F#", 1, (2, 6, 7), (2, 0, 5, 1)), occurrence(lib + "F#m().", 1, (3, 2, 3)), occurrence(lib + "g().", 1, (8, 9, 10))]),
        (b, "m.ts", [occurrence(app, 1, (0, 0, 0)), occurrence(app + "run().", 1, (1, 9, 12), (1, 0, 9, 1)), occurrence(lib + "F#", 0, (4, 8, 9))]),
    ]
    return a, b, lib.replace("1.0.0", "."), app.replace("1.0.0", "."), docs, [(a, "r", "pa", "npm", "a", ["pa/src/a.ts"]), (b, "r", "pb", "npm", "b", [])]


def test_checker_refs_only_where_the_index_has_none(spark):
    a, b, lib, app, docs, packages = two_packages()
    ref = lambda line, col, to, at, file="pb/m.ts": (file, line, col, "x", to, "src/a.ts", *at)
    told = {"packageId": b, "namespaceMemberRefs": [ref(4, 8, "a", (2, 6)), ref(6, 1, "a", (2, 6)), ref(6, 1, "a", (2, 6)), ref(7, 1, "a", (99, 0)), ref(7, 2, "elsewhere", (2, 6)), ref(7, 3, "a", (2, 6), "pb/none.ts")], "shorthandRefs": [ref(0, 0, "a", (8, 9))]}
    i = build(spark, docs, packages, [{"packageId": a}, told])
    names = named(i)
    got = sorted((names[r["symbol_id"]], r["line"], r["col"], names[r["enclosing_symbol_id"]], r["is_external"]) for r in i.checker_refs.collect())
    assert got == [(lib + "F#", 6, 1, app + "run().", True), (lib + "g().", 0, 0, app, True)]
    assert i.occurrences.where("package_id = 'npm:r:b' and role = 0").count() == 3


def test_spreads_hand_out_a_module(spark):
    a, b, lib, app, docs, packages = two_packages()
    surface = [("pa/src/a.ts", n, n, "pa/src/a.ts", *at, [], None) for n, at in (("F", (2, 6)), ("g", (8, 9)))]
    spread = [("pb/m.ts", 4, 8, "a", "src/a.ts"), ("pb/m.ts", 5, 1, "a", "./src/../src/a.ts"), ("pb/m.ts", 5, 2, "a", "src/none.ts")]
    for flags, uses in (([], {("F#", 5), ("g().", 5), ("g().", 4)}), ([("namespace_dynamic", "spread", None, "a")], set())):
        i = build(spark, docs, packages, [{"packageId": a, "exports": surface}, {"packageId": b, "namespaceSpreadRefs": spread, "flags": flags}])
        names = named(i)
        assert {(names[r["symbol_id"]].removeprefix(lib), r["line"]) for r in i.spread_uses.collect()} == uses  # F# at line 4 is indexed
        edges = {(names[r["from_symbol_id"]], names[r["to_symbol_id"]].removeprefix(lib)) for r in i.spread_edges.collect()}
        assert edges == {(app + "run().", t) for t in ("F#", "F#m().", "g().")}


def test_imports_that_a_checker_lost(spark):
    a, b, lib, app, docs, packages = two_packages()
    surface = [("pa/src/a.ts", "alias", "g", "pa/src/a.ts", 8, 9, [], None)]
    lost = [("a", "alias", "pb/m.ts", 1, 1), ("a/deep", "g", "pb/m.ts", None, None), ("a", "F", "pb/m.ts", 2, 2), ("a", "g", "pb/none.ts", 3, 3), ("b", "g", "pb/m.ts", 4, 4), ("zod", "g", "pb/m.ts", 5, 5)]
    i = build(spark, docs, packages, [{"packageId": a, "exports": surface}, {"packageId": b, "unresolvedImports": lost}])
    names = named(i)
    assert {(names[r["symbol_id"]], r["line"], names[r["enclosing_symbol_id"]]) for r in i.imported_uses.collect()} == {(lib + "g().", 1, app), (lib + "g().", None, app)}
    assert sorted((r["symbol_str"], r["file"]) for r in i.unresolved_refs.collect()) == [("F", "pb/m.ts"), ("g", "pb/none.ts")]


def test_unindexed_imports_deep_surface_and_overlays(spark):
    a, b, lib, app, docs, packages = two_packages()
    un = lambda file, module, **x: (file, module, None, x.get("scope"), x.get("relative"), x.get("lost"))
    told = {
        "packageId": b,
        "unindexedImports": [un("pb/e.mjs", "a/x"), un("pb/s.mjs", "a", scope="script"), un("pb/c.ts", "b"), un("pb/z.ts", "zod"), un("pb/v.vue", "pb/./m", relative=True), un("pb/w.vue", "pb/none", relative=True), un("pb/y.vue", "./q", relative=True, lost=True)],
        "deepImportExports": [("a", "src/a.ts", "g", "src/a.ts", "g"), ("a", "src/a.ts", "m", "src/a.ts", "m"), ("b", "m.ts", "run", "m.ts", "run")],
    }
    edges = [("r", "file:./pb/m.ts", "npm:a#*"), ("r", "file:pb/m.ts", "npm:r:a#none"), ("r", "pb/m.ts", "npm:a#*"), ("r", "file:pb/none.ts", "npm:a#*"), ("r", "file:pb/m.ts", "a#*")]
    i = build(spark, docs, packages, [{"packageId": a}, told], edges=edges)
    names = named(i)
    assert {tuple(r) for r in i.witness_files.collect()} == {(b, a, "pb/s.mjs"), (b, b, "pb/c.ts"), (b, b, "pb/v.vue"), (b, b, "pb/w.vue"), (b, b, "pb/y.vue")}
    assert [(r["package_id"], r["target_package_id"], r["file"]) for r in i.package_flags.where("flag = 'unindexed_consumer'").collect()] == [(b, a, "pb/e.mjs")]
    assert {tuple(r) for r in i.unindexed_loads.collect()} == {(b, "pb/v.vue", "pb/m.ts", True), (b, "pb/w.vue", "pb/none", False), (b, "pb/y.vue", "./q", False)}
    assert {names[r["symbol_id"]] for r in i.entry_symbols.collect()} == {app + "run()."}
    assert {names[r["symbol_id"]] for r in i.symbols.where("is_exported").collect()} == {lib + "g()."}
    assert {(names[r["from_symbol_id"]], names[r["to_symbol_id"]]) for r in i.overlay_edges.collect()} == {(app, lib + "g().")}


def test_names_of_several_packages_are_noted(spark):
    a, b, lib, app, docs, packages = two_packages()
    twin = "npm:q:a"
    docs.append((twin, "src/a.ts", [occurrence("scip-typescript npm a 1.0.0 src/`a.ts`/g().", 1, (8, 9, 10))]))
    packages.append((twin, "q", ".", "npm", "a", []))
    docs[1] = (b, "m.ts", docs[1][2][:2])
    i = build(spark, docs, packages, [{"packageId": b, "shorthandRefs": [("pb/m.ts", 4, 8, "x", "a", "src/a.ts", 8, 9)], "unindexedImports": [("pb/e.mjs", "a", None, None, None, None)]}])
    assert i.checker_refs.count() == 0
    flags = {(r["flag"], r["target_package_id"]) for r in i.package_flags.where(f"package_id = '{b}'").collect()}
    assert flags == {("ambiguous_dep", a), ("ambiguous_dep", twin), ("unindexed_consumer", a), ("unindexed_consumer", twin)}
