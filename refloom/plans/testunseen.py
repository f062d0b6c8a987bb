"""What sidecars tell beyond the index, for the derived organisation, and what must come of it.

The fields are flat relations that both engines derive (``_TOLD``); Spark nests them into
sidecars and lets ``Ingest`` read them, the oracle writes down the outcome. Two files of every
third package hold declarations of equal names, and every file has a text with heads of
declarations, so that twins and signatures have something to find.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators.analysis import ERROR_CLASS, SIGNATURE
from refloom.operators.ingest import Ingest
from refloom.plans import testindex
from refloom.plans.testindex import _with_names
from refloom.sources.readers import SIDECAR
from refloom.storage import materialize

#: A sidecar counts unless its index is given up; its package's documents exist if there is an index at all.
_VALID = "listed AND NOT (k % 31 = 12 AND k % 29 <> 6 AND k % 41 <> 3)"
#: Read by both engines; braces name tables or relations before.
_TOLD: dict[str, str] = {
    "y_pkg": f"""
SELECT a.*, x.listed, x.live, {_VALID.replace('listed', 'x.listed').replace('k %', 'a.k %')} AS told, n.ns FROM {{packages}} a JOIN {{x_file}} x ON x.k = a.k AND x.f = 0 JOIN {{o_n}} n ON true""",
    # at places that no index has, and (o % 17 = 4) at those of its own references
    "y_checker": """
SELECT DISTINCT r.use_k AS k, r.package_id, r.file, CASE WHEN r.o % 17 = 4 THEN r.line ELSE 900 + r.ln END AS line, r.o % 50 AS col, 'm' AS member, t.name AS target_name, t.manager AS target_manager, s.rel AS target_rel,
  10 * s.idx + 1 AS target_line, s.id, CASE WHEN r.o % 17 = 4 THEN r.eidx ELSE -1 END AS eidx, r.ns, r.o % 2 AS part
FROM {x_ref} r JOIN {x_sym} s ON s.id = r.id JOIN {y_pkg} t ON t.k = s.k JOIN {y_pkg} u ON u.k = r.use_k WHERE r.o % 17 IN (2, 4) AND u.told""",
    "y_spread": """
SELECT a.k, x.package_id, x.file, 950 AS line, a.k % 40 AS col, a.name AS target_name, a.manager AS target_manager, a.k AS target_k, y.rel AS target_rel, y.file AS target_file
FROM {y_pkg} a JOIN {x_file} x ON x.k = a.k AND x.f = 1 JOIN {x_file} y ON y.k = a.k AND y.f = 2 WHERE a.told AND a.k % 7 = 2
UNION ALL SELECT a.k, x.package_id, x.file, 951, 3, t.name, t.manager, t.k, y.rel, y.file
FROM {y_pkg} a JOIN {x_file} x ON x.k = a.k AND x.f = 0 JOIN {y_pkg} t ON t.k = (a.k + 1) % a.ns JOIN {x_file} y ON y.k = t.k AND y.f = 1 WHERE a.told AND a.k % 5 = 1""",
    "y_unindexed": """
SELECT a.k, a.package_id, 'tools/a.js' AS file, t.name || '/deep' AS module, CAST(NULL AS STRING) AS scope, t.k AS target_k, t.manager AS target_manager, false AS relative, false AS lost FROM {y_pkg} a JOIN {y_pkg} t ON t.k = (a.k + 2) % a.ns WHERE a.told AND a.k % 6 = 1
UNION ALL SELECT a.k, a.package_id, 'scripts/b.mjs', t.name, 'script', t.k, t.manager, false, false FROM {y_pkg} a JOIN {y_pkg} t ON t.k = (a.k + 3) % a.ns WHERE a.told AND a.k % 6 = 2
UNION ALL SELECT a.k, a.package_id, 'build.config.ts', a.name, CAST(NULL AS STRING), a.k, a.manager, false, false FROM {y_pkg} a WHERE a.told AND a.k % 6 = 3
UNION ALL SELECT a.k, a.package_id, 'app/c.vue', a.path || '/src/f2', CAST(NULL AS STRING), a.k, a.manager, true, false FROM {y_pkg} a WHERE a.told AND a.k % 6 = 4
UNION ALL SELECT a.k, a.package_id, 'app/d.vue', './none/x', CAST(NULL AS STRING), a.k, a.manager, true, true FROM {y_pkg} a WHERE a.told AND a.k % 6 = 5
UNION ALL SELECT a.k, a.package_id, 'app/e.vue', a.path || '/lib/../src/./f1.ts', CAST(NULL AS STRING), a.k, a.manager, true, false FROM {y_pkg} a WHERE a.told AND a.k % 6 = 0""",
    "y_deep": """
SELECT a.k, t.name AS target_name, t.manager AS target_manager, s.rel, s.name, s.file, s.id, s.idx, s.live, s.head, s.descs
FROM {y_pkg} a JOIN {y_pkg} t ON t.k = (a.k + 4) % a.ns JOIN {x_sym} s ON s.k = t.k AND s.idx IN (1, 6, 16) WHERE a.told AND a.k % 3 = 1""",
    "y_lost": """
SELECT a.k, a.package_id, a.manager, a.live, t.k AS target_k, t.manager AS target_manager, t.package_id AS target_id, x.file AS seen_file,
  CASE a.manager WHEN 'pub' THEN 'package:' || t.name || '/x.dart' ELSE t.name || '/sub' END AS module,
  CASE w.w WHEN 0 THEN 'sym' || CAST(t.k + 2 * a.ns AS STRING) WHEN 1 THEN 'default' ELSE 'nothing' END AS name, w.w,
  CASE WHEN w.w = 1 AND a.k % 9 = 4 THEN 'src/unknown.ts' ELSE x.file END AS file, CASE WHEN a.k % 2 = 0 THEN NULL ELSE 960 + w.w END AS line, CASE WHEN a.k % 2 = 0 THEN NULL ELSE 5 END AS col
FROM {y_pkg} a JOIN {y_pkg} t ON t.k = (a.k + 8) % a.ns JOIN {x_file} x ON x.k = a.k AND x.f = 0 JOIN (SELECT 0 AS w UNION ALL SELECT 1 UNION ALL SELECT 2) w ON true WHERE a.told""",
    # two files of equal names, and references to those of the first
    "y_twin": """
SELECT x.k, x.f, x.package_id, x.file, x.rel, x.head, x.modpath, x.live, x.has_module, d.d, d.name, d.tail, 1000 + 20 * d.d AS line
FROM {x_file} x JOIN (SELECT 1 AS f, 0 AS d, 'twin' AS name, 'twin().' AS tail UNION ALL SELECT 1, 1, 'other', 'other#' UNION ALL SELECT 1, 2, 'part', 'other#part.' UNION ALL SELECT 1, 3, 'alone', 'alone().'
  UNION ALL SELECT 2, 0, 'twin', 'twin().' UNION ALL SELECT 2, 1, 'other', 'other.') d ON d.f = x.f WHERE x.k % 3 = 0""",
    "y_twin_ref": """
SELECT DISTINCT u.k, u.f, u.rel, u.package_id, u.file, r.o % 50 AS col, CAST(1200 + r.ln AS BIGINT) AS line, t.k AS def_k, t.d, t.package_id AS def_package_id, t.head, t.modpath, t.tail
FROM {x_ref} r JOIN {x_sym} s ON s.id = r.id JOIN {y_twin} t ON t.k = s.k AND t.f = 1 AND t.d = r.o % 4 JOIN {x_file} u ON u.k = r.use_k AND u.f = r.f WHERE r.o % 5 = 1""",
    "y_cond": """
SELECT a.k, x.file, 1 AS line, 0 AS col, t.file AS target, b.file AS alternative, CASE WHEN a.k % 2 = 0 THEN 'export' ELSE 'import' END AS directive
FROM {y_pkg} a JOIN {x_file} x ON x.k = a.k AND x.f = 0 JOIN {x_file} t ON t.k = a.k AND t.f = 1 JOIN {x_file} b ON b.k = a.k AND b.f = 2 WHERE a.told AND a.k % 3 = 0
UNION ALL SELECT a.k, x.file, 2, 0, 'dart:io', b.file, CASE WHEN a.k % 4 = 0 THEN 'export' ELSE CAST(NULL AS STRING) END
FROM {y_pkg} a JOIN {x_file} x ON x.k = a.k AND x.f = 0 JOIN {x_file} b ON b.k = a.k AND b.f = 3 WHERE a.told AND a.k % 3 = 1
UNION ALL SELECT a.k, x.file, 3, 0, 'dart:io', y.file, 'import'
FROM {y_pkg} a JOIN {x_file} x ON x.k = a.k AND x.f = 1 JOIN {y_pkg} c ON c.repo = a.repo AND c.k > a.k AND c.k % 5 = 3 JOIN {x_file} y ON y.k = c.k AND y.f = 4 WHERE a.told AND a.k % 11 = 2""",
}

_MORE_OCCURRENCES = """
SELECT k, f, rel, 3 AS part, CAST(d AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, head || '1.0.0 ' || modpath || tail AS symbol, 1 AS role, array(line, 4, 9) AS at, array(line, 0, line + 9, 0) AS body FROM {y_twin}
UNION ALL SELECT k, f, rel, 4, line, CAST(100 * def_k + col AS BIGINT), head || '9.9.9 ' || modpath || tail, 0, array(CAST(line AS INT), CAST(col AS INT), CAST(col + 3 AS INT)), CAST(NULL AS array<int>) FROM {y_twin_ref}"""

#: How many lines of parameters a declaration has in its file's text.
_PARAMETERS = "{id} % 6"


def _texts(x: dict[str, DataFrame]) -> DataFrame:
    """repo, path, text: each declaration's head at its place, everything else blank."""
    s = x["x_sym"].withColumns({"n": F.expr(_PARAMETERS.format(id="id")), "at": 10 * F.col("idx") + 1})
    name = F.concat(F.lit("    "), "name")
    first = F.when(F.col("idx") % 4 == 0, F.concat(name, F.when(F.col("id") % 3 == 0, " extends BaseError {").otherwise(" extends Base { // no Error"))).when(F.col("idx") % 4 == 1, F.concat(name, F.lit("("))).otherwise(F.concat(name, F.lit(": Handler = async (")))
    last = F.when(F.col("idx") % 4 == 1, "    ): R {").otherwise("    ): R => {")
    lines = F.concat(F.array(F.struct(F.col("at").alias("line"), first.alias("text"))), F.when(F.col("idx") % 4 != 0, F.concat(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.struct((F.col("at") + k).alias("line"), F.lit("      p = '){', // a =>").alias("text"))), F.array(F.struct((F.col("at") + F.col("n") + 1).alias("line"), last.alias("text"))))).otherwise(F.array().cast("array<struct<line:bigint,text:string>>")))
    lines = F.when((F.col("idx") % 4 != 0) & (F.col("n") == 0), F.array(F.struct(F.col("at").alias("line"), first.alias("text")), F.struct((F.col("at") + 1).alias("line"), last.alias("text")))).otherwise(lines)
    by_file = s.select("package_id", "file", F.explode(lines).alias("l")).groupBy("package_id", "file").agg(F.map_from_entries(F.collect_list(F.struct("l.line", "l.text"))).alias("lines"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(220)), lambda k: F.coalesce(F.element_at("lines", k.cast("bigint")), F.lit(""))), "\n")
    return by_file.join(x["packages"].select("package_id", "repo"), "package_id").select("repo", F.col("file").alias("path"), text.alias("text"))


class Apart(dict):
    """Tables that are written when they are first read."""

    def __init__(self, plans: dict[str, DataFrame]):
        super().__init__(plans)
        self._written: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._written:
            self[name] = materialize(super().__getitem__(name))
            self._written.add(name)
        return super().__getitem__(name)


def _nested(x: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """packageId and further fields of sidecars, by field: each is nested and written when it is first read."""
    col = F.col
    checked = F.struct("file", col("line").cast("int").alias("line"), col("col").cast("int").alias("col"), "member", col("target_name").alias("targetPackage"), col("target_rel").alias("targetFile"), col("target_line").cast("int").alias("targetLine"), F.lit(4).alias("targetCol"))
    fields = {
        "namespaceMemberRefs": (x["y_checker"].where("part = 0"), checked),
        "shorthandRefs": (x["y_checker"].where("part = 1"), checked),
        "namespaceSpreadRefs": (x["y_spread"], F.struct("file", "line", col("col").cast("int").alias("col"), col("target_name").alias("targetPackage"), col("target_rel").alias("targetFile"))),
        "unindexedImports": (x["y_unindexed"], F.struct("file", "module", F.lit(None).cast("string").alias("targetPackage"), "scope", "relative", col("lost").alias("unresolved"))),
        "deepImportExports": (x["y_deep"], F.struct(col("target_name").alias("targetPackage"), col("rel").alias("file"), "name", col("rel").alias("entry"), col("name").alias("exportedAs"))),
        "unresolvedImports": (x["y_lost"], F.struct("module", "name", "file", col("line").cast("int").alias("line"), col("col").cast("int").alias("col"))),
        "conditionalImports": (x["y_cond"], F.struct("file", "line", "col", "target", F.array("alternative", F.lit("package:far/far.dart"), F.lit("src/missing.ts")).alias("alternatives"), "directive")),
    }
    schema = x["packages"].sparkSession.createDataFrame([], SIDECAR).schema
    owners = x["packages"].where("k % 37 <> 9").select("k", F.col("package_id").alias("packageId"))
    return Apart({name: rows.groupBy("k").agg(F.collect_list(element).alias(name)).join(owners, "k").select("packageId", F.col(name).cast(schema[name].dataType)) for name, (rows, element) in fields.items()})


@lru_cache(maxsize=4)
def enriched(spark: SparkSession, sf_dir: str) -> Ingest:
    """The ingest of the derived organisation with everything that its sidecars tell and its files' texts."""
    x = dict(testindex.shared(spark, sf_dir))
    for name, sql in _TOLD.items():
        x[name] = spark.sql(sql, **{k: v for k, v in x.items() if "{" + k + "}" in sql})
    rows = testindex.occurrence_rows(spark, x).unionByName(spark.sql(_MORE_OCCURRENCES, y_twin=x["y_twin"], y_twin_ref=x["y_twin_ref"]))
    runtime = x["packages"].join(F.broadcast(x["o_n"]), how="cross").withColumns({
        "runtime_entry_points": F.when(F.col("k") % 8 == 1, F.col("entry_points")).otherwise(F.array().cast("array<string>")),
        "runtime_entry_symbols": F.when(F.col("k") % 8 == 3, F.array(F.concat(F.lit("sym"), (F.col("k") + 10 * F.col("ns")).cast("string")))).otherwise(F.array().cast("array<string>")),
    })
    extra = x["packages"].where("k % 10 = 4").select("repo", F.concat(F.lit("file:./"), F.col("entry_points")[0]).alias("from"), F.concat("manager", F.lit(":"), F.when(F.col("k") % 20 == 4, F.concat("repo", F.lit(":"))).otherwise(""), "name", F.when(F.col("k") % 4 == 0, "#*").otherwise(F.concat(F.lit("#sym"), F.col("k").cast("string")))).alias("to"))
    # inputs lie in files, as indexers leave them: many relations read them
    index, sidecars = materialize(testindex.index_of(x, rows)), materialize(testindex.sidecars_of(x))
    return Ingest(runtime, x["package_deps"], index, sidecars, testindex.manifest_of(x["packages"]), _texts(x), extra, _nested(x))


_NAME = "head || '. ' || descs"
_TOP = "idx < 15"
#: What must come of it, after the shared relations.
_OUTCOME: dict[str, str] = {
    "z_sym": f"SELECT id, idx, k, f, package_id, file, rel, name, live, {_NAME} AS symbol_str, idx % 2 = 0 AND listed AS is_exported, {_TOP} AS is_top FROM {{x_sym}} WHERE live UNION ALL "
    "SELECT -1 - d, 100 + d, k, f, package_id, file, rel, name, live, head || '. ' || modpath || tail, false, tail <> 'other#part.' FROM {y_twin} WHERE live",
    "z_deep": f"SELECT DISTINCT {_NAME} AS symbol_str, file AS entry_file, name AS exported_as FROM {{y_deep}} WHERE target_manager = 'npm' AND live AND {_TOP}",
    "z_twins": """SELECT DISTINCT c.k, a.symbol_str AS default_str, b.symbol_str AS twin_str, b.package_id, c.directive = 'export' AS exports FROM {y_cond} c JOIN {z_sym} a ON a.k = c.k AND a.f = 1 AND a.id IN (-1, -2) JOIN {z_sym} b ON b.k = c.k AND b.f = 2 AND b.id = a.id
JOIN {x_file} x ON x.k = c.k AND x.f = 1 JOIN {x_file} y ON y.k = c.k AND y.f = 2 WHERE c.line = 1 AND x.has_module AND y.has_module""",
    "z_surface": "SELECT symbol_str, file AS entry_file, CASE idx WHEN 0 THEN 'default' ELSE name END AS exported_as FROM {z_sym} WHERE is_exported UNION SELECT * FROM {z_deep}",
    "z_module": "SELECT k, f, package_id, file, symbol_str FROM x_module WHERE live",
    "z_enclosed": "SELECT k + idx * 0 AS k, idx, symbol_str FROM {z_sym} WHERE id >= 0",
    "z_checker": """SELECT DISTINCT s.symbol_str, c.package_id, s.package_id AS def_package_id, c.file, c.line, c.col, coalesce(e.symbol_str, m.symbol_str) AS enclosing
FROM {y_checker} c JOIN {z_sym} s ON s.id = c.id JOIN {z_module} m ON m.package_id = c.package_id AND m.file = c.file LEFT JOIN {z_enclosed} e ON e.k = c.k AND e.idx = c.eidx
WHERE c.target_manager = 'npm' AND NOT EXISTS (SELECT 1 FROM x_occ o WHERE o.symbol_str = s.symbol_str AND o.package_id = c.package_id AND o.file = c.file AND o.line = c.line AND o.col = c.col)""",
    "z_lost": """SELECT DISTINCT y.package_id, y.target_id, y.name, y.file, y.line, y.col, s.symbol_str, m.symbol_str AS enclosing FROM {y_lost} y LEFT JOIN {z_module} m ON m.package_id = y.package_id AND m.file = y.file
LEFT JOIN (SELECT DISTINCT z.k, z.symbol_str, z.name, u.exported_as FROM {z_sym} z JOIN {z_surface} u USING (symbol_str)) s ON s.k = y.target_k AND (s.name = y.name OR s.exported_as = y.name) AND m.symbol_str IS NOT NULL
WHERE y.target_manager = y.manager AND y.target_id <> y.package_id""",
    "z_spread": "SELECT y.*, m.symbol_str AS enclosing FROM {y_spread} y JOIN {z_module} m ON m.package_id = y.package_id AND m.file = y.file JOIN {z_module} t ON t.k = y.target_k AND t.file = y.target_file WHERE y.target_manager = 'npm'",
    "z_exported": "SELECT DISTINCT symbol_str FROM {z_surface}",
    "z_spread_uses": """SELECT DISTINCT s.symbol_str, y.package_id, s.package_id AS def_package_id, y.file, y.line, y.col, y.enclosing FROM {z_spread} y JOIN {z_sym} s ON s.k = y.target_k AND s.file = y.target_file JOIN {z_exported} USING (symbol_str)
WHERE s.is_top AND (y.k = y.target_k OR NOT (y.k % 47 = 4 AND y.target_name = 'pkg' || CAST(y.target_k AS VARCHAR)))""",
    "z_loads": """SELECT y.k, y.package_id, y.file, CASE WHEN lost THEN module ELSE replace(replace(module, '/lib/..', ''), '/./', '/') END AS module, m.file AS found FROM {y_unindexed} y
LEFT JOIN {z_module} m ON NOT lost AND m.package_id = y.package_id AND m.file IN (replace(replace(module, '/lib/..', ''), '/./', '/'), module || '.ts') WHERE relative""",
    "z_whole": "SELECT c.k, c.file, c.line, c.col, c.directive, m.symbol_str AS importer, m.package_id, s.symbol_str, s.name, s.package_id AS def_package_id, s.is_top FROM {y_cond} c JOIN {z_module} m ON m.k = c.k AND m.file = c.file JOIN {z_sym} s ON s.file = c.alternative WHERE c.target = 'dart:io' AND s.is_top",
    # a directive whose documents have no module of their own keeps the alternative whole too: here only the third file can lack one
    "z_twin_uses": """SELECT DISTINCT w.twin_str AS symbol_str, r.package_id, w.package_id AS def_package_id, r.file, r.line, r.col, m.symbol_str AS enclosing FROM {z_twins} w JOIN {y_twin_ref} r ON r.head || '. ' || r.modpath || r.tail = w.default_str JOIN {z_module} m ON m.package_id = r.package_id AND m.file = r.file""",
    "z_kept_uses": "SELECT DISTINCT w.symbol_str, w.package_id, w.def_package_id, w.file, w.line, w.col, w.importer AS enclosing FROM {z_whole} w JOIN {z_exported} USING (symbol_str)",
}
_USE = "symbol_str, package_id, def_package_id, file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, enclosing"
QUERIES = {
    "i9_signature_bits": f"""SELECT symbol_str, package_id, file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, 8 + {SIGNATURE} AS role FROM x_met m WHERE symbol_str IS NOT NULL AND eidx >= 0 AND eidx % 4 <> 0 AND (eidx % 4 = 1 OR NOT ends_with(file, '.dart'))
  AND (ln < {_PARAMETERS.format(id='(use_k + eidx * ns)')} OR (ln = {_PARAMETERS.format(id='(use_k + eidx * ns)')} AND col < CASE WHEN ends_with(file, '.dart') THEN 5 ELSE 9 END))
UNION ALL SELECT head || '. ' || descs, package_id, file, CAST(10 * idx + 1 AS INTEGER), 4, 1 + {ERROR_CLASS} FROM x_sym WHERE live AND idx % 4 = 0 AND id % 3 = 0""",
    "i11_checker_refs": f"SELECT {_USE} FROM z_checker",
    "i15_witness_files": """SELECT DISTINCT y.package_id AS consumer_package_id, t.package_id AS target_package_id, y.file FROM y_unindexed y JOIN t_packages t ON t.k = y.target_k WHERE NOT relative AND target_manager = 'npm' AND (scope IS NOT NULL OR target_k = y.k)
UNION SELECT package_id, package_id, file FROM y_unindexed WHERE relative""",
    "i15_unindexed_flags": "SELECT DISTINCT y.package_id, 'unindexed_consumer' AS flag, 'unindexed file imports ' || module AS reason, y.file, t.package_id AS target_package_id FROM y_unindexed y JOIN t_packages t ON t.k = y.target_k WHERE NOT relative AND target_manager = 'npm' AND scope IS NULL AND target_k <> y.k",
    "i16_export_surface": "SELECT * FROM z_surface UNION SELECT w.twin_str, u.entry_file, u.exported_as FROM z_twins w JOIN z_surface u ON u.symbol_str = w.default_str WHERE w.exports",
    "i17_unresolved_imports": """SELECT 'use' AS outcome, package_id, target_id, symbol_str AS symbol, file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, enclosing FROM z_lost WHERE symbol_str IS NOT NULL
UNION ALL SELECT 'gone', package_id, target_id, name, file, CAST(line AS INTEGER), CAST(col AS INTEGER), NULL FROM z_lost WHERE symbol_str IS NULL""",
    "i18_entry_symbols": """SELECT symbol_str, max(kind) AS kind FROM (
  SELECT head || '. ' || descs AS symbol_str, CASE WHEN id % 2 = 0 THEN 'ambient' ELSE 'runtime' END AS kind FROM x_sym WHERE live AND listed AND id % 101 = 7
  UNION ALL SELECT symbol_str, 'runtime' FROM z_sym JOIN z_exported USING (symbol_str) WHERE is_top AND f = 0 AND rel IN ('src/f0.ts', 'lib/src/f0.dart') AND (k % 8 = 1 OR (k % 8 = 3 AND idx = 10))
  UNION ALL SELECT s.symbol_str, 'runtime' FROM z_loads l JOIN z_sym s ON s.package_id = l.package_id AND s.file = l.found WHERE s.is_top AND s.symbol_str NOT IN (SELECT symbol_str FROM z_exported)
  UNION ALL SELECT symbol_str, 'runtime' FROM z_whole WHERE package_id <> def_package_id OR (directive = 'export' AND NOT starts_with(name, '_'))) GROUP BY symbol_str""",
    "i19_unindexed_loads": "SELECT DISTINCT package_id, file, coalesce(found, module) AS module, found IS NOT NULL AS resolved FROM z_loads",
    "i20_spread_uses": f"SELECT {_USE} FROM z_spread_uses",
    "i20_spread_edges": "SELECT DISTINCT y.enclosing AS from_symbol, s.symbol_str AS to_symbol, y.package_id AS from_package_id, s.package_id AS to_package_id FROM z_spread y JOIN z_sym s ON s.k = y.target_k AND s.file = y.target_file",
    "i21_conditional_uses": f"SELECT {_USE} FROM z_twin_uses UNION SELECT {_USE} FROM z_kept_uses",
    "i22_overlay_edges": """SELECT DISTINCT m.symbol_str AS from_symbol, s.symbol_str AS to_symbol, m.package_id AS from_package_id, s.package_id AS to_package_id FROM t_packages a JOIN z_module m ON m.k = a.k AND m.f = 0
  JOIN x_file x ON x.k = a.k AND x.f = 0 AND x.rel IN ('src/f0.ts', 'lib/src/f0.dart') JOIN z_sym s ON s.k = a.k JOIN (SELECT DISTINCT symbol_str FROM z_surface UNION SELECT twin_str FROM z_twins WHERE exports AND default_str IN (SELECT symbol_str FROM z_surface)) u ON u.symbol_str = s.symbol_str
  WHERE a.k % 10 = 4 AND (a.k % 4 = 0 OR s.name = 'sym' || CAST(a.k AS VARCHAR))""",
}


def _uses(i: Ingest, df: DataFrame) -> DataFrame:
    return _with_names(i, df, symbol_str="symbol_id", enclosing="enclosing_symbol_id").select("symbol_str", "package_id", "def_package_id", "file", "line", "col", "enclosing")


def _edges(i: Ingest, df: DataFrame) -> DataFrame:
    return _with_names(i, df.drop("source"), from_symbol="from_symbol_id", to_symbol="to_symbol_id").select("from_symbol", "to_symbol", "from_package_id", "to_package_id")


def _signature_bits(i: Ingest) -> DataFrame:
    return _with_names(i, i.marked_occurrences, symbol_str="symbol_id").select("symbol_str", "package_id", "file", "line", "col", "role")


def _imports(i: Ingest) -> DataFrame:
    uses = _with_names(i, i.imported_uses, symbol="symbol_id", enclosing="enclosing_symbol_id").select(F.lit("use").alias("outcome"), "package_id", F.col("def_package_id").alias("target_id"), "symbol", "file", "line", "col", "enclosing")
    gone = i._imports_gone.select(F.lit("gone").alias("outcome"), F.col("consumer_package_id").alias("package_id"), F.col("target_package_id").alias("target_id"), F.col("symbol_str").alias("symbol"), "file", "line", "col", F.lit(None).cast("string").alias("enclosing"))
    return uses.unionByName(gone)


BUILDS = {
    "i9_signature_bits": _signature_bits,
    "i11_checker_refs": lambda i: _uses(i, i.checker_refs),
    "i15_witness_files": lambda i: i.witness_files,
    "i15_unindexed_flags": lambda i: i.package_flags.where("flag = 'unindexed_consumer'").select("package_id", "flag", "reason", "file", "target_package_id"),
    "i16_export_surface": lambda i: _with_names(i, i.symbol_exports, symbol_str="symbol_id").select("symbol_str", "entry_file", "exported_as"),
    "i17_unresolved_imports": _imports,
    "i18_entry_symbols": lambda i: _with_names(i, i.entry_symbols, symbol_str="symbol_id").select("symbol_str", "kind"),
    "i19_unindexed_loads": lambda i: i.unindexed_loads,
    "i20_spread_uses": lambda i: _uses(i, i.spread_uses),
    "i20_spread_edges": lambda i: _edges(i, i.spread_edges.distinct()),
    "i21_conditional_uses": lambda i: _uses(i, i.conditional_uses),
    "i22_overlay_edges": lambda i: _edges(i, i.overlay_edges),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, build=build: build(enriched(spark, sf_dir))) for name, build in BUILDS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: testindex.oracle(sql, {**_TOLD, **_OUTCOME}) for name, sql in QUERIES.items()}
