"""Decoded indexes and export surfaces of the derived organisation, and what must come of them.

The inputs are nested as indexers write them; the expected relations are derived from the
star-schema tables without that detour, in SQL of their own.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators.ingest import Ingest
from refloom.plans.testorg import analysis, oracle_parts
from refloom.sources.readers import SIDECAR
from refloom.storage import materialize

#: Read by both engines; braces name tables or relations before.
_SHARED: dict[str, str] = {
    "x_file": """
SELECT f.k, f.f, f.package_id, f.file, substr(f.file, length(a.path) + 2) AS rel, 'scip-typescript ' || a.manager || ' ' || a.name || ' ' AS head,
  '`' || replace(substr(f.file, length(a.path) + 2), '/', '`/`') || '`/' AS modpath,
  a.k % 31 <> 12 AND a.k % 29 <> 6 AND a.k % 41 <> 3 AS live, a.k % 37 <> 9 AS listed, NOT (a.k % 31 = 30 AND f.f = 3) AS has_module
FROM {o_file} f JOIN {packages} a ON a.k = f.k""",
    "x_sym": """
SELECT p.id, p.idx, p.k, x.f, x.package_id, x.file, x.rel, x.head, x.live, x.listed, 'sym' || CAST(p.id AS STRING) AS name,
  x.modpath || CASE WHEN p.idx < 15 THEN '' ELSE 'sym' || CAST(p.id - 10 * p.ns AS STRING) || CASE (p.idx - 10) % 4 WHEN 0 THEN '#' WHEN 1 THEN '().' ELSE '.' END END
    || 'sym' || CAST(p.id AS STRING) || CASE p.idx % 4 WHEN 0 THEN '#' WHEN 1 THEN '().' ELSE '.' END AS descs,
  CASE WHEN p.idx >= 15 THEN p.id - 10 * p.ns ELSE CAST(NULL AS BIGINT) END AS parent_id
FROM {o_part} p JOIN {x_file} x ON x.k = p.k AND x.f = p.idx % 5""",
    "x_ref": """
SELECT u.k AS use_k, u.f, u.rel, u.file, u.package_id, u.live, s.id, s.head, s.descs, s.package_id AS def_package_id, s.live AS def_live, r.eidx, r.o, r.ln, r.ns,
  CASE WHEN r.o % 11 = 3 THEN 'gone' WHEN r.o % 11 = 4 AND s.idx % 4 = 0 THEN 'constructor' WHEN r.o % 11 = 5 THEN 'literal' ELSE 'plain' END AS form,
  CASE WHEN r.eidx < 0 THEN 500 + r.ln ELSE 10 * r.eidx + 2 + r.ln END AS line, r.o % 50 AS col
FROM {o_ref} r JOIN {x_sym} s ON s.id = r.symbol_id JOIN {x_file} u ON u.k = r.use_k AND u.f = CASE WHEN r.eidx < 0 THEN r.ln % 5 ELSE r.eidx % 5 END""",
}
_ASKED = """CASE form WHEN 'gone' THEN regexp_replace(descs, 'sym[0-9]+[^/]*$', 'gone') || CAST(id AS STRING) || '().' WHEN 'constructor' THEN descs || '`<constructor>`().' WHEN 'literal' THEN descs || 'typeLiteral3:x.' ELSE descs END"""

_OCCURRENCES = f"""
SELECT k, f, rel, 0 AS part, id AS a, 0 AS b, head || '1.0.0 ' || descs AS symbol, 1 AS role, array(10 * idx + 1, 4, 9) AS at, array(10 * idx + 1, 0, 10 * idx + 10, 0) AS body FROM {{x_sym}}
UNION ALL SELECT k, f, rel, 0, -1, 0, head || '1.0.0 ' || modpath, 1, array(0, 0, 0), NULL FROM {{x_file}} WHERE has_module
UNION ALL SELECT k, f, rel, 0, -2, 0, 'local 3', 1, array(3, 1, 2), NULL FROM {{x_file}} WHERE f = 1
UNION ALL SELECT k, f, rel, 0, id, 1, head || '1.0.0 ' || descs || '(x)', 1, array(10 * idx + 1, 12, 13), NULL FROM {{x_sym}} WHERE idx % 4 = 1
UNION ALL SELECT k, f, rel, 2, 0, 0, CASE WHEN k % 31 = 12 THEN head || '1.0.0 Foo#==().' ELSE 'scip-typescript npm elsewhere 1.0.0 a b c' END, 0, array(600, 1, 2), NULL FROM {{x_file}} WHERE f = 2 AND k % 31 IN (12, 13)
UNION ALL SELECT k, f, rel, 2, 1, 0, 'scip-typescript npm left-pad 1.0.0 `index.d.ts`/pad().', 0, array(601, 1, 4), NULL FROM {{x_file}} WHERE f = 0
UNION ALL SELECT use_k, f, rel, 1, o, ln, head || '9.9.9 ' || {_ASKED}, 8, array(CAST(line AS INT), CAST(col AS INT), CAST(col + 3 AS INT)), NULL FROM {{x_ref}}"""


@lru_cache(maxsize=4)
def shared(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived organisation's tables and the relations of ``_SHARED``."""
    t = analysis(spark, sf_dir).t
    frames = {k: t[k] for k in ("packages", "package_deps", "o_n", "o_file", "o_part", "o_ref")}
    for name, sql in _SHARED.items():
        frames[name] = materialize(spark.sql(sql, **{k: v for k, v in frames.items() if "{" + k + "}" in sql}))
    packages = frames["packages"].withColumn("entry_points", F.array(F.concat("path", F.when(F.col("manager") == "pub", "/lib/src/f0.dart").otherwise("/src/f0.ts"))))
    return frames | {"packages": packages}


def index_of(x: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """Nested indexes of occurrence rows (k, f, rel, part, a, b, symbol, role, at, body)."""
    packages = x["packages"]
    occurrence = F.struct(F.col("symbol"), F.col("role").cast("int").alias("symbolRoles"), F.transform("at", lambda v: v.cast("int")).alias("range"), F.transform("body", lambda v: v.cast("int")).alias("enclosingRange"))
    symbol = F.struct(F.concat("head", F.lit("1.0.0 "), "descs").alias("symbol"), F.element_at(F.array(*map(F.lit, (7, 17, 61, 26))), (F.col("idx") % 4 + 1).cast("int")).alias("kind"))
    # occurrences and kinds are dealt once, by package: documents and indexes are made of the same partitions
    o = rows.select("k", "f", "rel", F.struct("part", "a", "b", occurrence.alias("o")).alias("o"), F.lit(None).cast("struct<symbol:string,kind:int>").alias("s"))
    kinds = x["x_sym"].select("k", "f", "rel", symbol.alias("s"))
    dealt = o.unionByName(kinds, allowMissingColumns=True).repartition("k")
    docs = dealt.groupBy("k", "f", "rel").agg(F.transform(F.sort_array(F.collect_list("o")), lambda v: v["o"]).alias("occurrences"), F.collect_list("s").alias("symbols")).where(F.size("occurrences") > 0)
    doc = F.struct(F.concat(F.when(F.col("k") % 2 == 1, "./").otherwise(""), "rel").alias("relativePath"), "symbols", "occurrences")
    index = docs.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", doc.alias("d")))), lambda v: v["d"]).alias("documents"))
    return index.where("k % 29 <> 6 and k % 41 <> 3").join(packages.select("k", "package_id"), "k").select("package_id", F.col("k").alias("load_order"), "documents")


def manifest_of(packages: DataFrame) -> DataFrame:
    return packages.select("package_id", F.expr("CASE WHEN k % 41 = 3 THEN NULL WHEN k % 29 = 6 THEN 'failed' WHEN k % 23 = 5 THEN 'partial' ELSE 'ok' END").alias("status"), F.expr("CASE WHEN k % 41 = 3 THEN array() WHEN k % 29 = 6 THEN array('info: a', 'error: boom', 'warn: w') WHEN k % 23 = 5 THEN array('warn: w', 'cause: first', 'cause: second\n more') END").alias("diagnostics"))


def sidecars_of(x: dict[str, DataFrame]) -> DataFrame:
    """Export surfaces without what ``testunseen`` adds."""
    packages = x["packages"]
    s = x["x_sym"].where("listed")
    site = F.array(F.struct(F.col("file"), F.lit(700).alias("line"), F.lit(0).alias("col")))
    exports = s.where("idx % 2 = 0").groupBy("package_id").agg(F.collect_list(F.struct(F.col("file").alias("entry"), F.when(F.col("idx") == 0, "default").otherwise(F.col("name")).alias("exportedAs"), "name", "file", (10 * F.col("idx") + 1).cast("int").alias("line"), F.lit(4).alias("col"), site.alias("sites"), F.lit(None).cast("string").alias("note"))).alias("exports"))
    entries = s.where("id % 101 = 7").groupBy("package_id").agg(F.collect_list(F.struct("file", (10 * F.col("idx") + 1).cast("int").alias("line"), F.lit(4).alias("col"), "name", F.when(F.col("id") % 2 == 0, "ambient").alias("kind"))).alias("entrySymbols"))
    side = packages.where("k % 37 <> 9").crossJoin(F.broadcast(x["o_n"])).join(exports, "package_id", "left").join(entries, "package_id", "left")
    named = F.concat(F.lit("pkg"), ((F.col("k") + 1) % F.col("ns")).cast("string"))
    side = side.withColumns({
        "packageId": F.col("package_id"), "generatedFiles": F.when(F.col("k") % 19 == 2, F.array(F.concat("path", F.lit("/src/f1.ts")))),
        "unresolved": F.when(F.col("k") % 43 == 2, F.array(F.struct(F.lit("src/dyn.ts").alias("file"), F.lit("computed access").alias("reason")))),
        "flags": F.when(F.col("k") % 47 == 4, F.array(F.struct(F.lit("namespace_dynamic").alias("flag"), F.lit("spread").alias("reason"), F.lit(None).cast("string").alias("file"), named.alias("targetPackage")))),
    })
    fields = packages.sparkSession.createDataFrame([], SIDECAR).schema
    return side.select(*[F.col(f.name).cast(f.dataType) if f.name in side.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def occurrence_rows(spark: SparkSession, x: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(_OCCURRENCES, **{k: x[k] for k in _SHARED})


@lru_cache(maxsize=4)
def ingested(spark: SparkSession, sf_dir: str) -> Ingest:
    """The ingest of the derived organisation's indexes."""
    x = shared(spark, sf_dir)
    # inputs lie in files, as indexers leave them: many relations read them
    index, sidecars = materialize(index_of(x, occurrence_rows(spark, x))), materialize(sidecars_of(x))
    return Ingest(x["packages"], x["package_deps"], index, sidecars, manifest_of(x["packages"]))


_SYMBOL = "head || '. ' || descs"
#: What must come of it: DuckDB SQL over the shared relations.
_EXPECTED = {
    "x_module": "SELECT k, f, package_id, file, live, CASE WHEN has_module THEN head || '. ' || modpath ELSE 'file ' || package_id || ' ' || file END AS symbol_str, has_module FROM x_file",
    "x_symbols": f"""SELECT s.package_id, s.file, {_SYMBOL} AS symbol_str, 10 * s.idx + 1 AS line, 4 AS col, ['class', 'function', 'variable', 'method'][s.idx % 4 + 1] AS kind, s.name,
  q.head || '. ' || q.descs AS parent, s.idx % 2 = 0 AND s.listed AS is_exported FROM x_sym s LEFT JOIN (SELECT id AS qid, head, descs FROM x_sym) q ON qid = s.parent_id WHERE s.live
UNION ALL SELECT package_id, file, symbol_str, 0, 0, CASE WHEN has_module THEN '' ELSE 'file' END, file, NULL, false FROM x_module WHERE live""".replace(_SYMBOL, "s.head || '. ' || s.descs"),
    "x_met": f"""SELECT r.*, CASE WHEN form = 'gone' OR NOT def_live THEN NULL ELSE {_SYMBOL} END AS symbol_str, head || '. ' || {_ASKED} AS asked FROM x_ref r WHERE live""",
    "x_occ": f"""SELECT m.symbol_str, m.package_id, m.def_package_id, m.file, m.line, m.col, 8 AS role, coalesce(e.head || '. ' || e.descs, o.symbol_str) AS enclosing
  FROM x_met m JOIN x_module o ON o.file = m.file AND o.package_id = m.package_id LEFT JOIN (SELECT id AS eid, head, descs FROM x_sym) e ON m.eidx >= 0 AND eid = m.use_k + m.eidx * m.ns WHERE m.symbol_str IS NOT NULL
UNION ALL SELECT s.head || '. ' || s.descs, s.package_id, s.package_id, s.file, 10 * s.idx + 1, 4, 1, o.symbol_str FROM x_sym s JOIN x_module o ON o.file = s.file AND o.package_id = s.package_id WHERE s.live
UNION ALL SELECT symbol_str, package_id, package_id, file, 0, 0, 1, symbol_str FROM x_module WHERE live AND has_module""",
}

QUERIES = {
    "s1_ingest_symbols": "SELECT symbol_str, package_id, file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, kind, name, parent, is_exported FROM x_symbols",
    "i7_documents": "SELECT d.package_id, d.file, o.symbol_str AS module_symbol, d.f = 0 AND d.rel IN ('src/f0.ts', 'lib/src/f0.dart') AS is_entry, regexp_matches(d.rel, '(^|/)(vendor|generated)/') OR (d.k % 19 = 2 AND d.listed AND d.rel = 'src/f1.ts') AS is_generated FROM x_file d JOIN x_module o ON o.package_id = d.package_id AND o.file = d.file WHERE d.live",
    "i8_occurrences": "SELECT symbol_str, package_id, def_package_id, file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, role, enclosing, package_id <> def_package_id AS is_external FROM x_occ",
    "i8_edges": """SELECT DISTINCT enclosing AS from_symbol, symbol_str AS to_symbol, package_id AS from_package_id, def_package_id AS to_package_id FROM x_occ WHERE role = 8
UNION SELECT parent, symbol_str, package_id, package_id FROM x_symbols WHERE parent IS NOT NULL
UNION SELECT o.symbol_str, s.head || '. ' || s.descs, s.package_id, s.package_id FROM x_sym s JOIN x_module o ON o.package_id = s.package_id AND o.file = s.file WHERE s.live AND s.listed AND s.id % 101 = 7""",
    "i10_unresolved_refs": "SELECT package_id AS consumer_package_id, def_package_id AS target_package_id, asked AS symbol_str, file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col FROM x_met WHERE symbol_str IS NULL AND package_id <> def_package_id",
    "i14_symbol_exports": "SELECT head || '. ' || descs AS symbol_str, file AS entry_file, CASE idx WHEN 0 THEN 'default' ELSE name END AS exported_as FROM x_sym WHERE live AND listed AND idx % 2 = 0",
    "i1_package_flags": """SELECT package_id, flag, reason, file, target_package_id FROM (
  SELECT package_id, CASE WHEN k % 41 = 3 OR k % 29 = 6 THEN 'index_failed' ELSE 'opaque_consumer' END AS flag, CASE WHEN k % 41 = 3 THEN 'package missing from index.json' WHEN k % 29 = 6 THEN 'error: boom' ELSE 'second' END AS reason, NULL AS file, NULL AS target_package_id FROM t_packages WHERE k % 41 = 3 OR k % 29 = 6 OR k % 23 = 5
  UNION ALL SELECT package_id, 'index_failed', 'invalid symbol "' || head || '1.0.0 Foo#==()."', NULL, NULL FROM x_file WHERE f = 2 AND k % 31 = 12 AND k % 29 <> 6 AND k % 41 <> 3
  UNION ALL SELECT package_id, 'opaque_consumer', 'no exports sidecar', NULL, NULL FROM x_file WHERE f = 0 AND live AND NOT listed
  UNION ALL SELECT package_id, 'dynamic_access', 'computed access', 'src/dyn.ts', NULL FROM x_file WHERE f = 0 AND listed AND k % 43 = 2 AND NOT (k % 31 = 12 AND k % 29 <> 6 AND k % 41 <> 3)
  UNION ALL SELECT x.package_id, 'namespace_dynamic', 'spread', NULL, t.package_id FROM x_file x CROSS JOIN t_o_n LEFT JOIN t_packages t ON t.manager = 'npm' AND t.name = 'pkg' || CAST((x.k + 1) % ns AS STRING) WHERE x.f = 0 AND x.listed AND x.k % 47 = 4 AND NOT (x.k % 31 = 12 AND x.k % 29 <> 6 AND x.k % 41 <> 3))""",
}


def oracle(final: str, more: dict[str, str] | None = None) -> str:
    """SQL of a query: the derivation, the shared relations (and ``more`` after them) and what must come of them."""
    names = {k: f"t_{k}" for k in ("o_file", "packages", "o_part", "o_ref", "o_n")} | {k: k for k in (*_SHARED, *(more or {}))}
    parts = [*oracle_parts(), *((k, sql.format(**names)) for k, sql in _SHARED.items()), *_EXPECTED.items(), *((k, sql.format(**names)) for k, sql in (more or {}).items())]
    needed, text = set(), final
    for name, sql in reversed(parts):
        if name in text:
            needed.add(name)
            text += sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in parts if n in needed) + "\n" + final


def _with_names(i: Ingest, df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with ids replaced by symbol strings: new name = old column."""
    s = i.symbol_names  # parents and what is exported are not asked
    for new, old in columns.items():
        df = df.join(s.select(F.col("symbol_id").alias(old), F.col("symbol_str").alias(new)), old, "left").drop(old)
    return df


def _symbols(i: Ingest) -> DataFrame:
    return _with_names(i, i.symbols, parent="parent_symbol_id").select("symbol_str", "package_id", "file", "line", "col", "kind", "name", "parent", "is_exported")


BUILDS = {
    "s1_ingest_symbols": _symbols,
    "i7_documents": lambda i: _with_names(i, i.documents.drop("made"), module_symbol="module_symbol_id").select("package_id", "file", "module_symbol", "is_entry", "is_generated"),
    "i8_occurrences": lambda i: _with_names(i, i.occurrences, symbol_str="symbol_id", enclosing="enclosing_symbol_id").select("symbol_str", "package_id", "def_package_id", "file", "line", "col", "role", "enclosing", "is_external"),
    "i8_edges": lambda i: _with_names(i, i.edges.drop("source"), from_symbol="from_symbol_id", to_symbol="to_symbol_id").select("from_symbol", "to_symbol", "from_package_id", "to_package_id"),
    "i10_unresolved_refs": lambda i: i.unresolved_refs,
    "i14_symbol_exports": lambda i: _with_names(i, i.symbol_exports, symbol_str="symbol_id").select("symbol_str", "entry_file", "exported_as"),
    "i1_package_flags": lambda i: i.package_flags.select("package_id", "flag", "reason", "file", "target_package_id"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, build=build: build(ingested(spark, sf_dir))) for name, build in BUILDS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in QUERIES.items()}
