"""An organisation derived from the star-schema tables, in SQL that Spark and DuckDB read alike.

Suppliers are packages, parts symbols; every line item is a reference, resolved or not.
References are uneven, as in code: of 20 orders one refers to the line's own part and one
fails to resolve; the others refer to a few helpers of the part's package or to seven
packages that all use. Packages whose number is 15 of 30 keep to themselves. Two symbols of
each package are used inside one other each, so that islands form and come back with what
text still names. Modules have negative ids, which no part's key meets however many parts there
are. Every rule is integer arithmetic and concatenation, so both engines derive the same rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from refloom.operators.analysis import Analysis, Policy
from refloom.schema import empty
from refloom.storage import materialize

NOW = 1_800_000_000
POLICY = Policy(now=NOW)

#: Relations in order of dependence; braces name tables or earlier relations.
DERIVED: dict[str, str] = {
    "o_n": "SELECT count(*) AS ns FROM {supplier}",
    "o_pkg": """
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 3 THEN 'pub' ELSE 'npm' END AS manager, 'org/' || n_name AS repo,
  CASE WHEN s_suppkey % 41 = 7 THEN 'pkg' || CAST(s_suppkey AS STRING) || '-testing' ELSE 'pkg' || CAST(s_suppkey AS STRING) END AS name,
  'packages/p' || CAST(s_suppkey AS STRING) AS path
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "repos": "SELECT 'org/' || n_name AS repo, 'main' AS default_branch FROM {nation}",
    "repo_history": "SELECT 'org/' || n_name AS repo, CASE n_nationkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'shallow' ELSE 'none' END AS history FROM {nation}",
    "packages": """
SELECT manager || ':' || repo || ':' || name AS package_id, k, repo, path, manager, name,
  CASE WHEN k % 9 = 8 THEN CAST(NULL AS STRING) ELSE CAST(k % 4 + 1 AS STRING) || '.' || CAST(k % 7 AS STRING) || '.0' END AS version,
  CASE k % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'published-private' ELSE 'published-public' END AS visibility, k % 5 <> 0 AS is_library
FROM {o_pkg}""",
    "o_file": """
SELECT k, package_id, f, path || '/' || CASE
  WHEN f = 4 AND k % 2 = 0 THEN CASE manager WHEN 'pub' THEN 'test/f4_test.dart' ELSE 'test/f4.ts' END
  WHEN f = 3 AND k % 5 = 0 THEN 'docs/f3.ts'
  WHEN f = 3 AND k % 11 = 4 THEN 'scripts/f3.ts'
  WHEN f = 2 AND k % 13 = 6 THEN 'generated/f2.ts'
  WHEN f = 2 AND k % 17 = 3 THEN 'vendor/f2.ts'
  WHEN f = 1 AND k % 23 = 5 THEN 'src/test-utils/f1.ts'
  WHEN f = 1 AND k % 19 = 7 THEN CASE manager WHEN 'pub' THEN 'lib/mock.dart' ELSE 'src/mocks.ts' END
  WHEN manager = 'pub' THEN 'lib/src/f' || CAST(f AS STRING) || '.dart'
  ELSE 'src/f' || CAST(f AS STRING) || '.ts' END AS file, -1 - 5 * k - f AS module_symbol_id
FROM {packages}, (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) fs""",
    "documents": "SELECT package_id, file, CASE WHEN k % 31 = 30 AND f = 3 THEN CAST(NULL AS BIGINT) ELSE module_symbol_id END AS module_symbol_id, f = 0 AS is_entry, k % 19 = 2 AND f = 1 AS is_generated FROM {o_file}",
    "o_part": """
SELECT p_partkey AS id, p_partkey % ns AS k, CAST(floor(p_partkey / ns) AS BIGINT) AS idx, ns FROM {part}, {o_n}""",
    "symbols": """
SELECT id AS symbol_id, 'idx ' || file || '/' || CASE WHEN id % 29 = 3 THEN '_' ELSE '' END || 'sym' || CAST(id AS STRING) ||
    CASE idx % 4 WHEN 0 THEN '#' WHEN 1 THEN '().' ELSE '.' END AS symbol_str,
  package_id, file, CAST(id % 200 AS INT) AS line, CAST(2 + id % 5 AS INT) AS col,
  CASE WHEN id % 67 = 13 THEN CAST(NULL AS STRING) WHEN id % 71 = 13 THEN 'import-prefix' WHEN id % 73 = 13 THEN 'anonymous-member' ELSE CASE idx % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'variable' ELSE 'method' END END AS kind,
  CASE WHEN id % 29 = 3 THEN '_' ELSE '' END || 'sym' || CAST(id AS STRING) AS name,
  CASE WHEN idx >= 15 THEN id - 10 * ns ELSE CAST(NULL AS BIGINT) END AS parent_symbol_id, idx % 2 = 0 AS is_exported,
  CASE WHEN id % 23 = 5 THEN CAST(NULL AS BIGINT) ELSE 1800000000 - (id * 37 % 1000) * 86400 END AS first_seen_at
FROM {o_part} p JOIN {o_file} f ON p.k = f.k AND p.idx % 5 = f.f
UNION ALL
SELECT module_symbol_id, 'idx ' || file || '/', package_id, file, 0, 0, 'file', file, CAST(NULL AS BIGINT), false, 1800000000 FROM {o_file}""",
    "o_line": """
SELECT l_orderkey AS ok, l_partkey AS part, l_linenumber AS ln, CAST(floor(l_orderkey / 20) AS BIGINT) AS o, ns, l_orderkey % 20 AS kind,
  l_partkey % ns AS home, l_suppkey % ns AS guest FROM {lineitem}, {o_n}""",
    "o_aim": """
SELECT *, CASE WHEN kind NOT IN (0, 10) AND ln >= 6 THEN guest % 7 ELSE home END AS def_k, CASE WHEN ln >= 6 THEN guest ELSE home END AS from_k,
  CASE WHEN kind IN (0, 10) THEN CAST(floor(part / ns) AS BIGINT) WHEN ln >= 6 THEN 2 * (part % 3) ELSE 1 + 2 * (ln % 2) END AS didx FROM {o_line}""",
    "o_ref": """
SELECT def_k + didx * ns AS symbol_id, CASE WHEN def_k % 30 = 15 OR from_k % 30 = 15 THEN def_k ELSE from_k END AS use_k,
  CASE WHEN ok % 7 = 0 THEN CAST(-1 AS BIGINT) ELSE (o + 3 * ln) % 20 END AS eidx, def_k, ns, CAST(ln AS BIGINT) AS ln, o
FROM {o_aim} WHERE kind <> 10
UNION ALL SELECT p.id, p.k, CAST(CASE p.idx WHEN 10 THEN 4 ELSE 0 END AS BIGINT), p.k, p.ns, CAST(1 AS BIGINT), CAST(7 AS BIGINT) FROM {o_part} p WHERE p.idx IN (10, 14)""",
    "occurrences": """
SELECT r.symbol_id, u.package_id, d.package_id AS def_package_id, u.file, CAST(CASE WHEN o % 3 = 0 THEN (use_k + eidx * ns) % 200 ELSE o % 200 END AS INT) AS line,
  CAST(ln AS INT) AS col, CASE WHEN o % 13 = 1 THEN 1048576 ELSE 0 END AS role,
  CASE WHEN eidx < 0 THEN u.module_symbol_id ELSE use_k + eidx * ns END AS enclosing_symbol_id,
  o % 37 = 5 AS is_export_site, use_k <> def_k AS is_external
FROM {o_ref} r JOIN {o_file} u ON u.k = r.use_k AND u.f = CASE WHEN eidx < 0 THEN ln % 5 ELSE eidx % 5 END
JOIN {packages} d ON d.k = r.def_k
UNION ALL
SELECT s.symbol_id, s.package_id, s.package_id, s.file, s.line, s.col,
  CASE WHEN p.id % 53 = 4 THEN 2097153 ELSE 1 END,
  CASE WHEN p.idx IN (12, 13) THEN p.id - 5 * p.ns ELSE CAST(NULL AS BIGINT) END, false, false
FROM {symbols} s JOIN {o_part} p ON s.symbol_id = p.id""",
    "edges": """
SELECT DISTINCT o.enclosing_symbol_id AS from_symbol_id, o.symbol_id AS to_symbol_id, 'scip' AS source, o.package_id AS from_package_id, o.def_package_id AS to_package_id
FROM {occurrences} o WHERE o.role % 2 = 0 AND NOT o.is_export_site
UNION ALL
SELECT a.module_symbol_id, b.id, 'overlay', a.package_id, c.package_id
FROM {o_file} a JOIN {o_n} n ON true JOIN {o_part} b ON b.k = (a.k + a.k % 2) % n.ns AND b.idx = 6 JOIN {packages} c ON c.k = b.k WHERE a.f = 0 AND a.k % 29 IN (3, 4)""",
    "package_deps": """
SELECT DISTINCT u.package_id AS consumer_package_id, d.manager AS dep_manager, d.name AS dep_name,
  CASE (u.k + d.k) % 4 WHEN 0 THEN '^' || CAST(u.k % 4 + 1 AS STRING) || '.0.0' WHEN 1 THEN d.version WHEN 2 THEN '1.2.3' ELSE 'workspace:*' END AS dep_constraint,
  CASE WHEN (u.k + d.k) % 17 = 16 THEN CAST(NULL AS STRING) ELSE d.package_id END AS resolved_package_id, (u.k + d.k) % 6 = 0 AS dev
FROM {o_ref} r JOIN {packages} u ON u.k = r.use_k JOIN {packages} d ON d.k = r.def_k WHERE r.use_k <> r.def_k""",
    "package_flags": """
SELECT package_id, 'opaque_consumer' AS flag, 'partial' AS reason, CAST(NULL AS STRING) AS file, CAST(NULL AS STRING) AS target_package_id FROM {packages} WHERE k % 97 = 5
UNION ALL
SELECT a.package_id, 'unindexed_consumer', 'import', 'src/x.js', b.package_id FROM {packages} a JOIN {o_n} n ON true JOIN {packages} b ON b.k = (a.k + 2) % n.ns WHERE a.k % 53 = 9""",
    "promoted_packages": "SELECT package_id, 'only documents' AS reason FROM {packages} WHERE k % 59 = 13 OR k % 10 = 5",
    "keep_rules": "SELECT package_id, CASE WHEN k % 2 = 0 THEN '*' ELSE 'sym' || CAST(k AS STRING) END AS symbol_name FROM {packages} WHERE k % 37 IN (1, 2)",
    "entry_symbols": "SELECT id AS symbol_id, CASE WHEN id % 2 = 0 THEN 'runtime' ELSE 'ambient' END AS kind FROM {o_part} WHERE id % 101 = 7",
    "symbol_exports": """
SELECT p.id AS symbol_id, f.file AS entry_file, CASE WHEN p.idx = 0 THEN 'default' ELSE 'sym' || CAST(p.id AS STRING) END AS exported_as
FROM {o_part} p JOIN {o_file} f ON f.k = p.k AND f.f = CASE WHEN p.k % 7 = 0 THEN 1 ELSE 0 END WHERE p.idx % 2 = 0
UNION ALL
SELECT p.id, f.file, 'again' FROM {o_part} p JOIN {packages} a ON a.k = p.k JOIN {packages} b ON b.repo = a.repo AND b.k > a.k AND b.k % 3 = 1 JOIN {o_file} f ON f.k = b.k AND f.f = 0 WHERE p.idx = 4 AND p.k % 11 = 2""",
    "unindexed_loads": "SELECT a.package_id, a.file, b.file AS module, a.k % 2 = 0 AS resolved FROM {o_file} a JOIN {o_file} b ON b.k = a.k AND b.f = 3 WHERE a.f = 0 AND a.k % 47 IN (3, 4)",
    "witness_files": "SELECT a.package_id AS consumer_package_id, b.package_id AS target_package_id, 'app/main.js' AS file FROM {packages} a JOIN {o_n} n ON true JOIN {packages} b ON b.k = (a.k + 3) % n.ns WHERE a.k % 61 = 21",
    "unresolved_refs": """
SELECT u.package_id AS consumer_package_id, d.package_id AS target_package_id,
  CASE ln % 5 WHEN 0 THEN '*' WHEN 1 THEN 'idx gone.json`/x' WHEN 2 THEN 'idx old/`sym' || CAST(part AS STRING) || '`' || CASE didx % 4 WHEN 0 THEN '#' WHEN 1 THEN '().' ELSE '.' END
    WHEN 3 THEN 'idx old/sym' || CAST(home AS STRING) || '#sym' || CAST(part AS STRING) || '.' ELSE 'idx old/none' || CAST(part AS STRING) || '#' END AS symbol_str,
  'src/f' || CAST(ln % 5 AS STRING) || '.ts' AS file, CAST(ok % 90 AS INT) AS line, CAST(ln AS INT) AS col
FROM {o_aim} JOIN {packages} d ON d.k = CASE WHEN home % 30 = 15 THEN (home + 1) % ns ELSE home END JOIN {packages} u ON u.k = CASE WHEN guest = d.k THEN (guest + 1) % ns ELSE guest END
WHERE kind = 10""",
}
BASE = ("supplier", "nation", "part", "lineitem")


def oracle_parts() -> list[tuple[str, str]]:
    """The derivation as DuckDB relations, prefixed so that they cannot meet the driver's views."""
    names = {b: b for b in BASE} | {k: f"t_{k}" for k in DERIVED}
    return [(f"t_{k}", sql.format(**names)) for k, sql in DERIVED.items()]


#: Read by many relations, and joined with themselves.
WRITTEN = ("packages", "o_file", "symbols", "occurrences", "edges", "package_deps", "documents", "symbol_exports")


class Derived(dict):
    """The organisation's tables; each is derived when it is first read, so a query costs only what it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in BASE:
            self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in DERIVED:
            frame = self.spark.sql(DERIVED[name], **{k: self[k] for k in set(re.findall(r"{(\w+)}", DERIVED[name]))})
            self[name] = materialize(frame) if name in WRITTEN else frame
        else:
            raise KeyError(name)
        return self[name]


@lru_cache(maxsize=4)
def derive(spark: SparkSession, sf_dir: str) -> Derived:
    """The organisation's tables, each written at most once a session and folder."""
    return Derived(spark, sf_dir)


@lru_cache(maxsize=4)
def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """One analysis a session and folder: its materialised relations serve every query."""
    tables = derive(spark, sf_dir)
    for name in ("excluded_repos", "ignored_manifests", "witness_ok"):
        tables[name] = empty(spark, name)
    return Analysis(tables, POLICY)
