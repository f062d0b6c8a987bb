"""What must not depend on how large an organisation is."""

from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F
from test_ingest import occurrence
from test_unseen import build

from refloom.functions.semver import satisfies
from refloom.operators import analysis, deps
from refloom.plans import registry, testentries, testindex, testorg, testunseen
from refloom.schema import TABLES, empty


def test_constraints_meet_versions_not_candidates(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(version, constraint, manager):
        seen.add(1)
        return satisfies(version, constraint, manager)

    monkeypatch.setattr(deps, "satisfies_udf", F.udf(counted, "boolean"))
    packages = spark.range(60).selectExpr("concat('p', id) package_id", "'npm' manager", "concat('r', id % 20) repo", "concat('lib', id % 2) name", "concat(1 + id div 50, '.0.0') version", "'private' visibility")
    asked = spark.range(60).selectExpr("concat('p', id) consumer_package_id", "'npm' dep_manager", "concat('lib', id % 2) dep_name", "concat('^', 1 + id % 3, '.0.0') dep_constraint", "false dev")
    rows = {r["consumer_package_id"]: r for r in deps.resolve_dependencies(asked, packages).collect()}
    assert seen.value <= 2 * 3 * 2  # names, constraints, versions
    assert len(rows) == 60 and all(r["ambiguous"] for r in rows.values())  # three near, 25 or five of a version


def test_resolution_takes_the_first_rule_that_leaves_one(spark):
    ddl = "package_id string, manager string, repo string, name string, version string, visibility string"
    packages = [("one", "npm", "r", "a", "1.0.0", "private")]
    packages += [("near", "npm", "r", "b", "1.0.0", "private"), ("far", "npm", "s", "b", "1.0.0", "published-public")]
    packages += [("open", "npm", "s", "c", "1.0.0", "published-public"), ("shut", "npm", "s", "c", "1.0.0", "private")]
    packages += [("old", "npm", "s", "d", "1.0.0", "private"), ("new", "npm", "s", "d", "2.0.0", "private")]
    packages += [("lost", "npm", "s", "e", None, "private"), ("kept", "npm", "s", "e", "2.0.0", "private")]
    packages += [("m", "npm", "r", "me", "1.0.0", "private")]
    asked = [("m", "npm", n, c, False) for n, c in (("a", None), ("b", "^9.0.0"), ("c", "^9.0.0"), ("d", "^2.0.0"), ("e", "^2.0.0"), ("x", "npm:a@1"), ("none", "*"))]
    found = deps.resolve_dependencies(spark.createDataFrame(asked, "consumer_package_id string, dep_manager string, dep_name string, dep_constraint string, dev boolean"), spark.createDataFrame(packages, ddl))
    rows = {r["dep_name"]: (r["resolved_package_id"], r["resolution"], r["ambiguous"]) for r in found.collect()}
    assert rows == {
        "a": ("one", "name", False), "b": ("near", "same-repo", False), "c": ("open", "published", False), "d": ("new", "constraint", False),
        "e": (None, None, True), "x": ("one", "name", False), "none": (None, None, False),
    }


def _tables(**rows):
    con = duckdb.connect()
    for name, sql in rows.items():
        con.sql(f"CREATE TABLE {name} AS {sql}")
    return con


def test_modules_never_have_the_id_of_a_part():
    con = _tables(supplier="SELECT range AS s_suppkey, 0 AS s_nationkey FROM range(30)", nation="SELECT 0 AS n_nationkey, 'N' AS n_name", part="SELECT range AS p_partkey FROM range(1300000)", lineitem="SELECT 0 AS l_orderkey WHERE false")
    parts = ", ".join(f"{n} AS ({sql})" for n, sql in testorg.oracle_parts() if n in ("t_o_pkg", "t_packages", "t_o_file"))
    ids = con.sql(f"WITH {parts} SELECT count(*), count(DISTINCT module_symbol_id), count(p_partkey) FROM t_o_file LEFT JOIN part ON p_partkey = module_symbol_id").limit(1).fetchall()[0]
    assert ids == (150, 150, 0)


@pytest.mark.parametrize("sql, symbol, line", [(registry._HITS_SQL, 4, 3), (registry._SEEN_SQL, 3, 3)])
def test_oracle_of_the_witness_looks_for_exported_names(sql, symbol, line):
    """As the witness does: a name that text may use is the own one or one that an entry exports."""
    con = _tables(
        verdicts=f"SELECT {symbol} AS symbol_id, 'needs_review' AS verdict, ['witness_pending'] AS reasons",
        t_symbols=f"SELECT {symbol} AS symbol_id, '_sym{symbol}' AS name, 'd' AS package_id",
        t_symbol_exports=f"SELECT {symbol} AS symbol_id, 'sym{symbol}' AS exported_as",
        t_packages="SELECT 'd' AS package_id, 'npm' AS manager, 'd' AS name, 1 AS k UNION ALL SELECT 'u', 'npm', 'u', 0 UNION ALL SELECT 'd0', 'npm', 'd0', 2" if symbol == 3 else "SELECT 'd' AS package_id, 'npm' AS manager, 'd' AS name, 0 AS k UNION ALL SELECT 'u', 'npm', 'u', 1",
        t_package_deps="SELECT 'u' AS consumer_package_id, 'd' AS resolved_package_id, false AS dev",
        t_o_n="SELECT 1 AS ns",
        t_o_file="SELECT 0 AS k, 0 AS f, 'src/f0.ts' AS file",
        t_witness_files="SELECT 'd' AS target_package_id, 'u' AS consumer_package_id, 'x' AS file WHERE false",
    )
    assert [(r[0], r[3]) for r in con.sql(sql).fetchall()] == [(symbol, line)]


def test_declared_uses_need_no_references(spark):
    """Overlay edges come from declarations and exports; no reference is read for them."""
    ingest = build(spark, [("a", "src/a.ts", [])], [("a", "r", ".", "npm", "a", ["src/a.ts"])], [{"packageId": "a"}], edges=[("r", "file:src/a.ts", "npm:a#*")])
    assert ingest.overlay_edges.columns == ["from_symbol_id", "to_symbol_id", "source", "from_package_id", "to_package_id"]
    assert not {"_edges", "_used", "occurrences"} & set(vars(ingest))


def test_queries_derive_only_what_they_read(spark):
    tables = testorg.Derived(spark, "/root/testdata/sf0.001")
    assert tables["o_file"].count() == 5 * tables["packages"].count()
    assert not {"o_ref", "occurrences", "edges", "symbol_exports", "symbols", "package_deps"} & set(tables)


def test_packages_of_a_repository_are_not_paired(spark):
    p = spark.range(400).selectExpr("concat('p', id) package_id", "'r' repo", "'' path", "if(id % 4 = 3, 'pub', 'npm') manager", "id k", "400L ns")
    met = testentries._first_others(p)
    assert {(r["manager"], r["j"]) for r in met.collect()} == {("npm", 3), ("pub", 0)} and met.count() == 400
    join = met._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[1]
    assert "Aggregate" in join  # one side is told once a manager before the join


def test_pairs_of_alternatives_are_numbers_and_each_is_met_once(spark):
    """Many documents import one alternative: its declarations are read once, and a path of two packages means both."""
    packages = [("a", "r", "", "npm", "a", []), ("b", "r", "", "pub", "b", [])]
    alternative = occurrence("scip-typescript npm a 1.0.0 `alt.ts`/one().", 1, [1, 0, 3])
    docs = [("a", f"m{n}.ts", [occurrence(f"scip-typescript npm a 1.0.0 `m{n}.ts`/", 1, [0, 0, 0])]) for n in range(4)]
    docs += [("a", "alt.ts", [alternative]), ("b", "alt.ts", [occurrence("scip-dart pub b 1.0.0 `alt.ts`/two().", 1, [1, 0, 3])])]
    told = [{"file": f"m{n}.ts", "line": 1, "col": 0, "target": "dart:io", "alternatives": ["alt.ts", "none.ts"], "directive": "import"} for n in range(4)]
    told = [(t["file"], t["line"], t["col"], t["target"], t["alternatives"], t["directive"]) for t in told]
    ingest = build(spark, docs, packages, [{"packageId": "a", "conditionalImports": told}])
    assert not [f.name for f in ingest._conditional.schema if f.dataType.typeName() == "string"]
    assert ingest._conditional.count() == 8 and ingest._conditional.where("foreign").count() == 4
    assert sorted(r["name"] for r in ingest._alternative_tops.collect()) == ["one", "two"]
    assert ingest.conditional_entries.count() == 1  # of the other package


def test_names_of_symbols_do_not_ask_what_is_exported(spark):
    declared = spark.createDataFrame([(1, "x")], "symbol_id long, symbol_str string")
    assert [tuple(r) for r in testindex._with_names(SimpleNamespace(_declared=declared), declared.select("symbol_id"), of="symbol_id").collect()] == [("x",)]


def test_fields_of_sidecars_are_written_when_first_read(spark, monkeypatch):
    written = []
    monkeypatch.setattr(testunseen, "materialize", lambda df: written.append(df.columns) or df)
    tables = testunseen.Apart({"one": spark.range(1).toDF("a"), "two": spark.range(1).toDF("b")})
    assert "two" in tables and tables["one"] is tables["one"] and written == [["a"]]


def test_only_edges_to_types_are_told_apart(spark, monkeypatch):
    """Supertypes of lost references: edges that end elsewhere are left out before the others are dealt."""
    steps = []

    def stopped(start, step):
        steps.append(step(spark.createDataFrame([], "target_package_id string, dkey string, type_id long")))
        raise InterruptedError

    monkeypatch.setattr(analysis, "fixpoint", stopped)
    with pytest.raises(InterruptedError):
        _ = analysis.Analysis({name: empty(spark, name) for name in TABLES}, testorg.POLICY).unresolved_ref_classes
    plan = steps[0]._jdf.queryExecution().analyzed().toString()
    assert "LeftSemi" in plan and plan.index("Deduplicate") < plan.index("LeftSemi")
