"""Manifests of the derived organisation's npm packages, their entry points, and the witness that reads their exports maps."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators import witness
from refloom.operators.crossing import crossing_hits
from refloom.operators.entries import Entries, exports_map, manifest_leaves
from refloom.operators.quoted import quoted_hits
from refloom.operators.runtime_entries import RuntimeEntries
from refloom.plans.testorg import analysis

#: Manifest of a package by its number modulo 8 (those of modulo 3 and 7 belong to the other manager).
MANIFESTS = {
    0: {"main": "dist/f0.js", "types": "dist/f0.d.ts"},
    1: {"exports": {".": {"import": {"types": "./dist/f0.d.mts", "default": "./dist/f0.mjs"}, "require": None}, "./f1": "./lib/f1.js", "./*": "./src/*.ts"}},
    2: {"main": "lib/commonjs/f0.js", "source": "src/f2.ts"},
    4: {"bin": {"x": "./src/f1.ts"}, "main": "src/f0"},
    5: {"main": "dist/web/f0.js", "exports": {"./gone": [{"a": "./dist/gone.js"}]}},
    6: {"name": "x", "imports": {"#c": {"node": "./src/f2.ts", "default": "./dist/f1.js"}, "#d": "far"}},
}
#: Exports maps that offer a package's second file as its first, by a star and by a nested condition.
OFFERS = {"k % 28 = 0": {"exports": {"./*0": "./lib/*1.js"}}, "k % 14 = 0": {"exports": {"./f0": {"import": ["./dist/f1.mjs"], "require": None}}}, "true": {"main": "x.js"}}


def _chosen(cases: dict[str, dict]) -> Column:
    out = F.lit(None).cast("string")
    for condition, manifest in reversed(cases.items()):
        out = F.when(F.expr(condition), json.dumps(manifest)).otherwise(out)
    return out


def _manifests(packages: DataFrame, cases: dict[str, dict]) -> DataFrame:
    return packages.where("manager = 'npm'").select("repo", F.col("path").alias("dir"), _chosen(cases).alias("text"))


@lru_cache(maxsize=4)
def entries(spark: SparkSession, sf_dir: str) -> Entries:
    t = analysis(spark, sf_dir).t
    files = t["o_file"].join(t["packages"].select("package_id", "repo"), "package_id").select("repo", F.col("file").alias("path"))
    return Entries(_manifests(t["packages"], {f"k % 8 = {v}": m for v, m in MANIFESTS.items()}), files)


def _manifest_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from refloom.plans.registry import _pending, _seen

    a = analysis(spark, sf_dir)
    manifests = _manifests(a.t["packages"], OFFERS)
    maps = exports_map(manifest_leaves(manifests), manifests, a.t["packages"])
    return witness.witness_hits(a, _pending(a), _seen(a), maps)


#: By a package's number modulo 9: its manifest, and files beside its sources with their text.
RUNTIME = {
    0: ({"dependencies": {"next": "15"}}, {"pages/p.tsx": "", "lib/q.ts": ""}),
    1: ({}, {"Dockerfile": 'FROM node\nWORKDIR /app\nCMD ["node", "/app/dist/f0.js"]'}),
    2: ({}, {"index.html": '<script type="module" src="/src/f0.ts?v=1"></script>'}),
    3: ({}, {"vite.config.ts": "export default { build: { rollupOptions: { input: { a: resolve(__dirname, 'src/f0.ts'), b: 'none.ts' } } } }"}),
    4: ({}, {"webpack.config.js": "module.exports = { entry: './src/f0' }", "index.html": '<script src="dist/main.js"></script>'}),
    5: ({}, {"rollup.config.mjs": "export default { input: 'src/f0.js' }"}),
    6: ({"scripts": {"dev": "NODE_ENV=x tsx watch src/f1.ts", "e": "node -e 'x.js'"}}, {}),
    7: ({}, {"wrangler.toml": 'main = "src/f0.ts"\n[x]\nmain = "src/f2.ts"', "functions/h.ts": "", "functions/h.test.ts": ""}),
    8: ({"scripts": {"dev": "vite"}}, {"docs/x.html": '<script src="../src/f0.ts"></script>'}),
}


@lru_cache(maxsize=4)
def runtime_entries(spark: SparkSession, sf_dir: str) -> RuntimeEntries:
    t = analysis(spark, sf_dir).t
    files = t["o_file"].join(t["packages"].select("package_id", "repo"), "package_id").select("repo", F.col("file").alias("path"), F.lit(None).cast("string").alias("text"))
    extra = spark.createDataFrame([(v, path, text) for v, (_, more) in RUNTIME.items() for path, text in more.items()], "v long, rel string, text string")
    extra = t["packages"].where("manager = 'npm'").withColumn("v", F.col("k") % 9).join(F.broadcast(extra), "v").select("repo", F.concat_ws("/", "path", "rel").alias("path"), "text")
    return RuntimeEntries(_manifests(t["packages"], {f"k % 9 = {v}": m for v, (m, _) in RUNTIME.items()}), files.unionByName(extra))


def _quoting(a) -> DataFrame:
    """A file of each package whose literals quote its symbols: generated code (in every other package), a message, a list, an import clause."""
    p = a.t["packages"].crossJoin(F.broadcast(a.t["o_n"]))
    sym = lambda i: F.concat(F.lit("sym"), (F.col("k") + i * F.col("ns")).cast("string"))
    made = F.concat(F.lit("const t = `import { "), sym(0), F.lit(" } from '"), F.col("name"), F.lit("'`;"))
    lines = [
        F.when(F.col("k") % 2 == 0, made).otherwise("const t = 1;"),
        F.concat(F.lit("console.warn(\"import { "), sym(2), F.lit(" } from '"), F.col("name"), F.lit("'\");")),
        F.concat(F.lit("const names = [\""), sym(4), F.lit("\", \""), sym(1), F.lit(" x\"];")),
        F.concat(F.lit("const c = \"x as "), sym(6), F.lit("\"; // \""), sym(4), F.lit("\"")),
    ]
    return p.where("manager = 'npm'").select("package_id", F.lit("src/quote.ts").alias("file"), F.concat_ws("\n", *lines).alias("text"))


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir)
    names = a.t["symbols"].where("parent_symbol_id is null and is_exported").select("symbol_id", F.col("package_id").alias("target_package_id"), F.col("name").alias("token"))
    return quoted_hits(a, names, _quoting(a))


def _first_others(p: DataFrame) -> DataFrame:
    """``p`` with j, the first package of its repository that has another manager.

    The first of each manager is found before packages meet: pairs of a repository's packages
    would grow with their square.
    """
    other = p.groupBy("repo", F.col("manager").alias("other_manager")).agg(F.min("k").alias("j"))
    return p.join(other, "repo").where("manager <> other_manager").groupBy("package_id", "path", "manager", "k", "ns").agg(F.min("j").alias("j"))


def _crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways: packages of the second manager call scripts (every other file does) and hand themselves over (those of every eighth number)."""
    a = analysis(spark, sf_dir)
    p = a.t["packages"].crossJoin(F.broadcast(a.t["o_n"])).select("package_id", "repo", "path", "manager", "k", "ns")
    sym = lambda k, i: F.concat(F.lit("sym"), (k + i * F.col("ns")).cast("string"))
    met = _first_others(p)
    use = F.concat(F.lit("// "), sym(F.col("j"), 2), F.lit("\nfinal x = '"), sym(F.col("j"), 0), F.lit(".start';"))
    dart = met.where("manager = 'pub'").select("package_id", F.lit("lib/bridge.dart").alias("file"), F.concat(F.when(F.col("k") % 8 == 3, F.lit("import 'dart:js';\n")).otherwise("\n"), use).alias("text"))
    script = met.where("manager = 'npm'").select("package_id", F.lit("src/bridge.js").alias("file"), F.concat(F.lit("\n"), use).alias("text"))
    own = a.t["o_file"].where("f = 0").join(p.select("package_id", "manager"), "package_id").where("manager = 'pub' and file like '%.dart'").select("package_id", "file", F.when(F.col("k") % 8 == 7, F.lit("@JSExport\nclass X {}")).otherwise("// @JSExport").alias("text"))
    names = a.t["symbols"].where("parent_symbol_id is null and is_exported").select("symbol_id", F.col("package_id").alias("target_package_id"), F.col("name").alias("token"))
    return crossing_hits(a, names, dart.unionByName(script).unionByName(own))


_FILES = "SELECT p.repo, p.path AS dir, p.k, f.f, f.file, substr(f.file, length(p.path) + 2) AS rel FROM t_packages p JOIN t_o_file f ON f.k = p.k WHERE p.manager = 'npm'"
#: file number, manifest, whether it is run and not imported; the first manifest's pattern takes all sources.
_WANTED = "(VALUES (0, 0, false), (0, 1, false), (1, 1, false), (0, 2, false), (2, 2, false), (0, 4, false), (1, 4, true), (0, 5, false), (1, 6, true), (2, 6, true)) w(n, v, run)"
QUERIES = {
    "s16_entry_points": f"""SELECT DISTINCT repo, dir, file, NOT run AS surface, run AS runtime, false AS fallback FROM ({_FILES}) x JOIN {_WANTED} ON v = k % 8 AND f = n AND rel = 'src/f' || n || '.ts'
UNION SELECT repo, dir, file, true, false, false FROM ({_FILES}) WHERE k % 8 = 1 AND rel LIKE 'src/%.ts'""",
    "s16_unresolved_entries": f"""SELECT repo, dir, './dist/gone.js' AS target FROM ({_FILES}) WHERE k % 8 = 5 AND f = 0 UNION ALL SELECT repo, dir, './lib/f1.js' FROM ({_FILES}) WHERE k % 8 = 1 AND f = 1 AND rel <> 'src/f1.ts'""",
}

#: manifest, file, what starts it, and whether the file is one of the derived ones (which may be missing).
_STARTED = """(VALUES (0, 'pages/p.tsx', 'Next.js', false), (1, 'src/f0.ts', 'image', true), (2, 'src/f0.ts', 'page', true), (3, 'src/f0.ts', 'bundler', true), (4, 'src/f0.ts', 'webpack', true), (4, 'src/f0.ts', 'page', true),
  (5, 'src/f0.ts', 'bundler', true), (6, 'src/f1.ts', 'script', true), (7, 'src/f0.ts', 'worker', true), (7, 'functions/h.ts', 'Cloudflare Pages Functions', false)) w(v, rel, what, derived)"""
QUERIES["s17_runtime_entries"] = f"""SELECT p.repo, p.path AS dir, p.path || '/' || rel AS file, what FROM t_packages p JOIN {_STARTED} ON v = p.k % 9
WHERE p.manager = 'npm' AND (NOT derived OR EXISTS (SELECT 1 FROM t_o_file f WHERE f.file = p.path || '/' || rel))"""

QUERIES["w11_quoted_names"] = """SELECT s.symbol_id, h.package_id, 'src/quote.ts' AS file, h.line FROM t_symbols s JOIN t_packages p USING (package_id) JOIN t_o_part o ON o.id = s.symbol_id
JOIN (VALUES (0, 'self', 1, true), (0, 'self-string', 1, true), (4, 'self-string', 3, true), (6, 'self-string', 4, false)) h(idx, package_id, line, made) ON h.idx = o.idx AND (p.k % 2 = 0 OR NOT made)
WHERE p.manager = 'npm' AND s.is_exported AND s.name = 'sym' || s.symbol_id"""

QUERIES["w13_crossing_hits"] = """SELECT s.symbol_id, c.package_id, CASE c.manager WHEN 'pub' THEN 'lib/bridge.dart' ELSE 'src/bridge.js' END AS file, 3 AS line
FROM (SELECT p.package_id, p.manager, p.k, min(o.k) AS j FROM t_packages p JOIN t_packages o ON o.repo = p.repo AND o.manager <> p.manager GROUP BY ALL) c
JOIN t_symbols s ON s.symbol_id = c.j JOIN t_o_file f ON f.k = c.j AND f.f = 0
WHERE s.is_exported AND s.name = 'sym' || s.symbol_id AND CASE c.manager WHEN 'pub' THEN c.k % 8 = 3 ELSE c.j % 8 = 7 AND ends_with(f.file, '.dart') END"""


def queries() -> dict:
    return {
        "s16_entry_points": lambda spark, sf_dir: entries(spark, sf_dir).found,
        "s16_unresolved_entries": lambda spark, sf_dir: entries(spark, sf_dir).unresolved,
        "s17_runtime_entries": lambda spark, sf_dir: runtime_entries(spark, sf_dir).runtime,
        "w7_manifest_hits": _manifest_hits,
        "w11_quoted_names": _quoted,
        "w13_crossing_hits": _crossing,
    }


def oracle_sql() -> dict[str, str]:
    from refloom.plans.oracles import oracle
    from refloom.plans.registry import _SEEN_SQL

    offered = _SEEN_SQL.replace("WHERE dk % 7 <> 0", "WHERE (dk % 7 <> 0 OR (dk % 14 = 0 AND NOT (dk % 19 = 7 AND dk % 23 <> 5)))")
    return {name: oracle(sql) for name, sql in QUERIES.items()} | {"w7_manifest_hits": oracle(offered)}
