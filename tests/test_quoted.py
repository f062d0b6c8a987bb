"""The index of string literals."""

import pytest

from refloom.functions.literals import literals


def one(text, dart=False):
    found = literals(text, dart)
    assert len(found) == 1
    return found[0]


@pytest.mark.parametrize(
    "text, generated, message",
    [
        ("const t = `import { A } from 'lib'`;", True, False), ("x = \"export * from 'lib'\"", True, False), ("x = 'import \"a\"'", True, False), ("f(`require('${m}')`)", True, False), ("x = \"await import('a')\"", True, False),
        ("x = 'plain words'", False, False), ("console.warn(\"import { A } from 'lib'\")", False, True), ("this.logger.info({ a: ['import(\"b\")'] })", False, True), ("deprecated('x')", False, True),
        ("x = '[Deprecated] use import(\"y\")'", False, True), ("warn(() => { return 'require(\"a\")' })", True, False), ("warn(1); x = 'require(\"a\")'", True, False), ("call(warn, 'require(\"a\")')", True, False),
        ("t.importDeclaration([s], t.stringLiteral('lib'))", True, False), ("t.other([s], 'lib')", False, False), ("console.log(a, b[0], 'x')", False, True),
    ],
)
def test_generated_code_and_messages(text, generated, message):
    found = one(text)
    assert (found["generated"], found["message"]) == (generated, message)


def test_specifiers_and_comments_are_no_literals():
    assert literals("import { A } from 'lib'; // 'x'\n/* \"y\" */ require('z')") == []


def test_words_of_literals():
    found = one("\nconst t = `import { A, B as C, D, E } from '${lib}/F'\nG`;")
    assert dict((w, (c, n)) for w, c, n in found["quoted"])["A"] == (2, 2)
    clauses = {w for w, c, _ in found["quoted"] if c}
    assert clauses == {"A", "B", "C", "D", "E"} and "lib" not in {w for w, *_ in found["quoted"]}
    assert ("G", 3) in found["made"] and ("A", 2) in found["made"] and ("lib", 2) not in found["made"]


def test_builder_calls_reach_back_to_the_call():
    found = one("const n = importDeclaration([spec(Island)],\n  lit('lib/x'))")
    assert ("Island", 1) in found["made"] and ("lib", 2) in found["made"]


def test_interpolations_of_dart():
    found = one("final s = 'a $name b ${x.y} c';", True)
    assert [w for w, *_ in found["quoted"]] == ["a", "b", "c"]


def test_uses_across_managers(spark):
    """Dart that calls JavaScript, JavaScript that calls Dart handed to it, nothing else; unreadable files count."""
    from refloom.operators.analysis import Analysis, Policy
    from refloom.operators.crossing import crossing_hits
    from refloom.schema import TABLES

    rows = {
        "packages": [("N", "r", "n", "npm", "n", "1", "private", True, []), ("P", "r", "p", "pub", "p", "1", "private", True, []), ("Q", "other", "q", "pub", "q", "1", "private", True, [])],
        "symbols": [(1, "n/start().", "N", "n/a.ts", 1, 0, "function", "start", None, True, None), (2, "p/given().", "P", "p/lib/g.dart", 1, 0, "function", "given", None, True, None), (3, "p/kept().", "P", "p/lib/k.dart", 1, 0, "function", "kept", None, True, None), (4, "p/lost().", "P", "p/lib/l.dart", 1, 0, "function", "lost", None, True, None)],
    }
    a = Analysis({name: spark.createDataFrame(rows.get(name, []), ddl) for name, ddl in TABLES.items()}, Policy())
    names = a.t["symbols"].selectExpr("symbol_id", "package_id as target_package_id", "name as token")
    files = [
        ("P", "p/lib/u.dart", "import 'dart:js';\n// start\n@JS('bridge.start')\nexternal restart();"), ("P", "p/lib/v.dart", "final start = 1;"), ("P", "p/test/u_test.dart", "@JS('start')"), ("P", "p/web/start.js", "start()"),
        ("P", "p/lib/g.dart", "@JSExport\nvoid given() {}"), ("P", "p/lib/k.dart", "// @JSExport\nvoid kept() {}"), ("P", "p/lib/l.dart", None), ("N", "n/b.js", "given(); kept(); xlost(); lost"), ("Q", "q/u.dart", "@JS('start')"), ("N", "n/a.ts", "start()"),
    ]
    got = sorted(tuple(r) for r in crossing_hits(a, names, spark.createDataFrame(files, "package_id string, file string, text string")).collect())
    assert got == [(1, "P", "p/lib/l.dart", 0), (1, "P", "p/lib/u.dart", 3), (2, "N", "n/b.js", 1), (4, "N", "n/b.js", 1)]
