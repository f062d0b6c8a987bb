"""Queries and oracle SQL of the cross-reference operators, by name.

Array columns leave as comma-joined strings and counts as long, so that engines compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators import deps, invariants, report, witness
from refloom.operators.analysis import Analysis
from refloom.plans import testentries, testindex, testunseen
from refloom.plans.oracles import oracle, relation, settled, with_dead
from refloom.plans.testorg import analysis

#: Relations whose rows leave as they are: query name -> (relation, columns).
PLAIN: dict[str, tuple[str, str]] = {
    "p2_ref_occurrences": ("ref_occurrences", "symbol_id package_id def_package_id file line col role enclosing_symbol_id is_external"),
    "p3_module_symbols": ("module_symbols", "symbol_id"),
    "p4_private_packages": ("private_packages", "package_id"),
    "p5_opaque_packages": ("opaque_packages", "package_id"),
    "p6_surface_files": ("surface_files", "package_id file"),
    "p7_test_files": ("test_files", "package_id file"),
    "p8_doc_files": ("doc_files", "package_id file"),
    "p9_vendored_files": ("vendored_files", "package_id file"),
    "p10_generated_files": ("generated_files", "package_id file"),
    "p11_script_files": ("script_files", "package_id file"),
    "p12_symbol_age_ok": ("symbol_age_ok", "symbol_id"),
    "p13_kept_symbols": ("kept_symbols", "symbol_id"),
    "p14_private_dead_scope": ("private_dead_scope", "symbol_id package_id"),
    "p15_private_dead_eligible": ("private_dead_eligible", "symbol_id"),
    "p15_unreachable_before": ("unreachable_before", "symbol_id"),
    "j1_symbol_owners": ("symbol_owners", "symbol_id owner_id"),
    "j2_owner_ref_occurrences": ("owner_ref_occurrences", "symbol_id member_symbol_id package_id file line col enclosing_symbol_id is_external"),
    "j3_reexporting_packages": ("reexporting_packages", "symbol_id exporter_package_id"),
    "j4_external_ref_occurrences": ("external_ref_occurrences", "symbol_id member_symbol_id consumer_package_id file line col in_test in_docs dev_dep test_support"),
    "j5_internal_ref_occurrences": ("internal_ref_occurrences", "symbol_id member_symbol_id package_id file line col in_test in_docs"),
    "j6_overlay_refs": ("overlay_refs", "symbol_id from_package_id is_external"),
    "j7_blocked_packages": ("blocked_packages", "package_id blocker_package_id flag"),
    "j8_verdict_blockers": ("verdict_blockers", "package_id blocker_package_id flag"),
    "j9_runtime_entry_defaults": ("runtime_entry_defaults", "symbol_id"),
    "j10_test_support_symbols": ("test_support_symbols", "symbol_id"),
    "j12_unexport_exempt_packages": ("unexport_exempt_packages", "package_id"),
    "j13_signature_refs": ("signature_refs", "symbol_id api_symbol_id"),
    "j14_unexport_dropped": ("unexport_dropped", "symbol_id"),
    "j16_unresolved_ref_classes": ("unresolved_ref_classes", "consumer_package_id target_package_id symbol_str file line col class"),
    "a1_external_refs": ("external_refs", "symbol_id consumer_package_id n"),
    "a2_internal_refs": ("internal_refs", "symbol_id n"),
    "a4_private_dead_skipped": ("private_dead_skipped", "package_id reason symbols"),
    "d2_test_only_refs": ("test_only_refs", "symbol_id"),
    "d2_docs_only_refs": ("docs_only_refs", "symbol_id"),
    "d8_private_dead_packages": ("private_dead_packages", "package_id"),
    "r1_symbol_ancestors": ("symbol_ancestors", "symbol_id ancestor_id"),
    "r2_reachable": ("reachable", "symbol_id"),
    "r2_reach_seeds_before": ("reach_seeds_before", "symbol_id"),
    "r3_reachable_after": ("reachable_after_base", "symbol_id"),
    "r5_signature_pinned": ("signature_pinned", "symbol_id"),
    "d1_base_verdicts": ("base_verdicts", "symbol_id verdict reasons blocked_by"),
    "d3_verdicts": ("verdicts", "symbol_id verdict reasons blocked_by"),
    "analyze_findings": ("findings", "symbol_id verdict reasons blocked_by"),
}
_LISTS = ("reasons", "blocked_by")


def _joined(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.array_join(c, ",").alias(c) if c in _LISTS else F.col(c) for c in columns])


def _joined_sql(relation: str, columns: list[str]) -> str:
    return "SELECT " + ", ".join(f"array_to_string({c}, ',') AS {c}" if c in _LISTS else c for c in columns) + f" FROM {relation}"


def _plain(relation: str, columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _joined(getattr(analysis(spark, sf_dir), relation), columns.split())


def _on(build: Callable[[Analysis], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(analysis(spark, sf_dir))


def _settled(a: Analysis) -> DataFrame:
    return a.findings.where("verdict <> 'private_dead'")


BUILT: dict[str, tuple[Callable[[Analysis], DataFrame], str]] = {
    "r2_reach_edges": (lambda a: a.reach_edges, "SELECT a AS from_symbol_id, b AS to_symbol_id FROM reach_edges"),
    "j11_candidate_symbols": (lambda a: a.candidates(_settled(a)).select("symbol_id", "name"), f"SELECT symbol_id, name FROM {relation('candidates')}"),
    "r4_candidate_reach": (lambda a: a.candidate_reach(_settled(a), a.reachable_after(_settled(a))), f"SELECT origin_id, symbol_id FROM {relation('candidate_reach')}"),
    "d7_private_dead_unlocked": (
        lambda a: _joined(a.private_dead_unlocked(_settled(a), a.reachable_after(_settled(a))), ["symbol_id", "reasons"]),
        f"SELECT symbol_id, array_to_string(reasons, ',') AS reasons FROM {relation('private_dead_unlocked')}",
    ),
    "j15_private_dead": (lambda a: _joined(a.findings.where("verdict = 'private_dead'"), ["symbol_id", "reasons"]), f"SELECT symbol_id, array_to_string(reasons, ',') AS reasons FROM {relation('private_dead')}"),
    "a7_counts_by_verdict": (lambda a: a.findings.groupBy("verdict").agg(F.count("*").alias("n")), "SELECT verdict, count(*) AS n FROM findings GROUP BY verdict"),
    "a3_blockers_of_package": (
        lambda a: a.verdict_blockers.groupBy("package_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "blocker_package_id", "flag"))), ",").alias("blocked_by")),
        "SELECT package_id, string_agg(DISTINCT blocker_package_id || ':' || flag, ',' ORDER BY blocker_package_id || ':' || flag) AS blocked_by FROM " + relation("verdict_blockers") + " GROUP BY package_id",
    ),
}

# --- dependency resolution over packages that share names -----------------------------------

_SHARED = "SELECT package_id, manager, repo, version, visibility, 'lib' || CAST(k % 7 AS STRING) AS name FROM {packages}"
_ASKED = """SELECT package_id AS consumer_package_id, manager AS dep_manager, 'lib' || CAST(k * 3 % 9 AS STRING) AS dep_name,
  CASE WHEN k % 5 = 0 THEN 'workspace:*' ELSE '^' || CAST(k % 4 + 1 AS STRING) || '.0.0' END AS dep_constraint, false AS dev FROM {packages}"""


def _resolved(a: Analysis) -> DataFrame:
    spark, packages = a.t["packages"].sparkSession, a.t["packages"]
    found = deps.resolve_dependencies(spark.sql(_ASKED, packages=packages), spark.sql(_SHARED, packages=packages))
    return found.select("consumer_package_id", "dep_name", "resolved_package_id", "resolution", "ambiguous")


_RESOLVED_SQL = f"""
SELECT consumer_package_id, dep_name,
  CASE WHEN n = 1 THEN one WHEN nn = 1 THEN near WHEN no = 1 THEN open_one WHEN nu = 0 AND nf = 1 THEN fit END AS resolved_package_id,
  CASE WHEN n = 1 THEN 'name' WHEN nn = 1 THEN 'same-repo' WHEN no = 1 THEN 'published' WHEN nu = 0 AND nf = 1 THEN 'constraint' END AS resolution,
  coalesce(n, 0) > 1 AND nn <> 1 AND no <> 1 AND NOT (nu = 0 AND nf = 1) AS ambiguous
FROM (
  SELECT a.consumer_package_id, a.dep_name, count(c.package_id) AS n, max(c.package_id) AS one,
    count(*) FILTER (WHERE c.repo = h.repo) AS nn, max(c.package_id) FILTER (WHERE c.repo = h.repo) AS near,
    count(*) FILTER (WHERE c.visibility <> 'private') AS no, max(c.package_id) FILTER (WHERE c.visibility <> 'private') AS open_one,
    count(*) FILTER (WHERE f) AS nf, max(c.package_id) FILTER (WHERE f) AS fit, count(*) FILTER (WHERE c.package_id IS NOT NULL AND f IS NULL) AS nu
  FROM ({_ASKED.format(packages="t_packages")}) a JOIN t_packages h ON h.package_id = a.consumer_package_id
  LEFT JOIN LATERAL (SELECT *, CASE WHEN a.dep_constraint LIKE '^%' THEN split_part(version, '.', 1) = split_part(substr(a.dep_constraint, 2), '.', 1) END AS f
    FROM ({_SHARED.format(packages="t_packages")}) s WHERE s.name = a.dep_name AND s.manager = a.dep_manager) c ON true
  GROUP BY ALL)
"""

# --- source text for the witness: each file imports one package and names some of its symbols ---

_TEXTS = """SELECT u.package_id, 'src/w' || CAST(d.k AS STRING) || '.ts' AS file, d.package_id AS target_package_id, n.ns, d.k AS dk, u.k AS uk,
  CASE WHEN (u.k + d.k) % 19 = 18 AND u.k % 4 = 1 THEN CAST(NULL AS STRING) ELSE 'import {{ sym' || CAST(d.k AS STRING) || ' }} from "' || d.name || '";' || chr(10) || '// sym' || CAST(d.k + 2 * ns AS STRING) || 'x' || chr(10) || 'run(sym' || CAST(d.k + 4 * ns AS STRING) || ', 1);' END AS text
FROM {package_deps} p JOIN {packages} u ON u.package_id = p.consumer_package_id JOIN {packages} d ON d.package_id = p.resolved_package_id JOIN {o_n} n ON true WHERE d.manager = 'npm' AND NOT p.dev"""


def _texts(a: Analysis) -> DataFrame:
    frames = {k: a.t[k] for k in ("package_deps", "packages", "o_n")}
    return frames["packages"].sparkSession.sql(_TEXTS, **frames).select("package_id", "file", "text").dropDuplicates(["package_id", "file"])


def _pending(a: Analysis) -> DataFrame:
    return a.verdicts.where(F.array_contains("reasons", "witness_pending") & (F.col("verdict") == "needs_review"))


#: Symbols under review by each name that text may call them: their own and those they are exported by.
_WAITING = """waiting AS (SELECT symbol_id, c.name, package_id AS target_package_id FROM verdicts JOIN t_symbols s USING (symbol_id)
  JOIN (SELECT symbol_id, name FROM t_symbols UNION SELECT symbol_id, exported_as FROM t_symbol_exports) c USING (symbol_id) WHERE verdict = 'needs_review' AND list_contains(reasons, 'witness_pending'))"""

_HITS_SQL = f"""
WITH texts AS (SELECT DISTINCT * FROM ({_TEXTS.format(package_deps="t_package_deps", packages="t_packages", o_n="t_o_n")})),
{_WAITING},
pairs AS (SELECT DISTINCT consumer_package_id AS package_id, resolved_package_id AS target_package_id FROM t_package_deps WHERE resolved_package_id IS NOT NULL)
SELECT DISTINCT symbol_id, t.package_id, file, CAST(CASE name WHEN 'sym' || dk THEN 1 ELSE 3 END AS INTEGER) AS line FROM texts t JOIN waiting w USING (target_package_id)
WHERE text IS NOT NULL AND name IN ('sym' || dk, 'sym' || (dk + 4 * ns))
UNION SELECT symbol_id, t.package_id, file, 0 FROM texts t JOIN pairs p USING (package_id) JOIN waiting w ON w.target_package_id = p.target_package_id WHERE text IS NULL
UNION SELECT symbol_id, consumer_package_id, file, 0 FROM t_witness_files JOIN waiting USING (target_package_id)
"""

# --- and text of files that the index saw: through a subpath, with a member access, a spread and a string ---

_SEEN = """SELECT u.package_id, f.file, d.package_id AS target_package_id, d.k AS dk, n.ns, 'import {{ sym' || CAST(d.k AS STRING) || ' }} from "' || d.name || '/f0";' || chr(10) || 'x.sym' || CAST(d.k + 2 * ns AS STRING) || '(1); y.' || chr(10)
  || '  sym' || CAST(d.k AS STRING) || '; use(sym' || CAST(d.k + 2 * ns AS STRING) || ', ...sym' || CAST(d.k AS STRING) || ');' || chr(10) || '"sym' || CAST(d.k + 2 * ns AS STRING) || '" /* sym' || CAST(d.k AS STRING) || ' */' AS text
FROM (SELECT p.consumer_package_id AS c, min(d.k) AS dk FROM {package_deps} p JOIN {packages} d ON d.package_id = p.resolved_package_id JOIN {packages} u ON u.package_id = p.consumer_package_id WHERE d.manager = 'npm' AND d.k % 7 <> u.k % 3 GROUP BY p.consumer_package_id) m
JOIN {packages} u ON u.package_id = m.c JOIN {packages} d ON d.k = m.dk JOIN {o_file} f ON f.k = u.k AND f.f = 0 JOIN {o_n} n ON true"""


def _seen(a: Analysis) -> DataFrame:
    frames = {k: a.t[k] for k in ("package_deps", "packages", "o_file", "o_n")}
    return frames["packages"].sparkSession.sql(_SEEN, **frames).select("package_id", "file", "text")


_SEEN_SQL = f"""
WITH texts AS ({_SEEN.format(package_deps="t_package_deps", packages="t_packages", o_file="t_o_file", o_n="t_o_n")}),
{_WAITING}
SELECT DISTINCT symbol_id, t.package_id, file, CAST(unnest(CASE WHEN name IN ('sym' || dk, '_sym' || dk) THEN [1, 3] ELSE [3] END) AS INTEGER) AS line FROM texts t JOIN waiting w USING (target_package_id)
WHERE dk % 7 <> 0 AND name IN ('sym' || dk, 'sym' || (dk + 2 * ns))
UNION SELECT symbol_id, consumer_package_id, file, 0 FROM t_witness_files JOIN waiting USING (target_package_id)
"""

_ROWS_SQL = f"""SELECT f.symbol_id, f.verdict, f.reasons, f.blocked_by, s.name AS symbol, s.package_id, s.file, s.line + 1 AS line, s.col + 1 AS col, p.repo,
  CASE WHEN f.verdict = 'deletion_candidate' THEN 'delete' WHEN f.verdict = 'deprecation_candidate' THEN CASE WHEN list_contains(f.reasons, 'internal_refs_only') THEN 'unexport' ELSE 'deprecate' END
    WHEN f.verdict = 'unexport_candidate' THEN 'unexport'
    WHEN f.verdict = 'private_dead' AND s.package_id NOT IN (SELECT package_id FROM {relation('private_packages')}) AND NOT list_contains(f.reasons, 'already_unreachable') THEN 'org_dead' ELSE f.verdict END AS view
  FROM findings f JOIN t_symbols s USING (symbol_id) JOIN t_packages p USING (package_id)"""
#: After the witness: what text named stays in review, the rest may go, islands come back, and the privately dead follow.
_WITNESSED_SQL = """SELECT symbol_id, CASE WHEN NOT waiting OR places IS NOT NULL THEN verdict WHEN priv THEN 'deletion_candidate' ELSE 'deprecation_candidate' END AS verdict,
  CASE WHEN waiting THEN list_concat(list_filter(reasons, lambda r: r <> 'witness_pending'), coalesce(places, [])) ELSE reasons END AS reasons, blocked_by
  FROM (SELECT v.*, priv, verdict = 'needs_review' AND list_contains(reasons, 'witness_pending') AS waiting FROM verdicts v JOIN t_symbols USING (symbol_id) JOIN pkg USING (package_id))
  LEFT JOIN (SELECT symbol_id, list_transform(list({'p': package_id, 'f': file, 'l': line} ORDER BY package_id, file, line)[1:5], lambda x: 'witness_mismatch:' || x.p || ':' || CASE x.l WHEN 0 THEN 'checkout missing' ELSE x.f || ':' || x.l END) AS places
    FROM (SELECT DISTINCT symbol_id, package_id, CASE line WHEN 0 THEN '' ELSE file END AS file, line FROM text_hits) GROUP BY symbol_id) USING (symbol_id)"""
_MORE = [("rep_rows", _ROWS_SQL), ("text_hits", _HITS_SQL), ("witnessed", _WITNESSED_SQL), *settled("rechecked", "witnessed"), *with_dead("closed", "rechecked")]


def _rows(a: Analysis) -> DataFrame:
    return report.finding_rows(a, a.findings)


_SARIF_SQL = """SELECT repo, verdict AS rule, file AS uri, line, col, symbol, symbol || ': ' || array_to_string(reasons, ', ') AS message,
  sha256(verdict || '|' || package_id || '|' || file || '|' || symbol || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END) AS fingerprint
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, verdict, package_id, file, symbol ORDER BY line, col, array_to_string(reasons, ', ')) AS nth FROM rep_rows)"""

REPORT: dict[str, tuple[Callable[[Analysis], DataFrame], str]] = {
    "p18_view_rows": (lambda a: report.view_rows(_rows(a)).select("view", "symbol_id", "repo", "file", "line", "col"), "SELECT unnest(CASE view WHEN 'deprecate' THEN ['deprecate', 'org_dead'] ELSE [view] END) AS view, symbol_id, repo, file, line, col FROM rep_rows"),
    "a8_package_counts": (
        lambda a: report.package_counts(_rows(a)),
        "SELECT package_id, " + ", ".join(f"count(*) FILTER (WHERE v = '{v}') AS \"{v}\"" for v in report.VIEWS) + " FROM (SELECT package_id, unnest(CASE view WHEN 'deprecate' THEN ['deprecate', 'org_dead'] ELSE [view] END) AS v FROM rep_rows) GROUP BY package_id",
    ),
    "a9_blockers": (
        lambda a: report.blockers(a, _rows(a), None),
        "SELECT regexp_replace(e, ':[^:]*$', '') AS blocker, count(DISTINCT symbol_id) AS findings, count(DISTINCT package_id) AS packages, string_agg(DISTINCT regexp_extract(e, '[^:]*$'), ',' ORDER BY regexp_extract(e, '[^:]*$')) AS flags FROM (SELECT symbol_id, package_id, unnest(blocked_by) AS e FROM rep_rows WHERE verdict = 'blocked') GROUP BY 1",
    ),
    "a10_gap_names": (
        lambda a: report.gap_names(a),
        """SELECT class, target_package_id, CAST(sum(n) AS BIGINT) AS refs, array_to_string(list(name ORDER BY n DESC, name)[1:3], ',') AS examples FROM (
  SELECT class, target_package_id, name, count(*) AS n FROM (SELECT consumer_package_id, target_package_id, CASE symbol_str WHEN '*' THEN '*' ELSE regexp_extract(symbol_str, '[^/]*$') END AS name, file, line, col,
    arg_min(class, CASE class WHEN 'version_skew' THEN 0 WHEN 'moved_at_head' THEN 1 WHEN 'unindexed_module' THEN 2 WHEN 'opaque_target' THEN 3 ELSE 4 END) AS class FROM unresolved_ref_classes GROUP BY 1, 2, 3, 4, 5, 6)
  GROUP BY ALL) GROUP BY class, target_package_id""",
    ),
    "a11_reason_counts": (
        lambda a: report.reason_counts(_rows(a)),
        "SELECT verdict, CASE WHEN list_contains(reasons, 'dead_island') THEN 'dead_island' WHEN list_contains(reasons, 'only_test_refs') THEN 'only_test_refs' WHEN list_contains(reasons, 'only_docs_refs') THEN 'only_docs_refs' WHEN list_contains(reasons, 'no_refs') THEN 'no_refs' ELSE 'other' END AS reason, count(*) AS n FROM rep_rows GROUP BY 1, 2",
    ),
    "j26_age_coverage": (
        lambda a: report.age_coverage(a),
        "SELECT r.repo, coalesce(h.history, 'none') AS history, count(symbol_id) AS symbols, count(first_seen_at) AS dated FROM t_repos r LEFT JOIN t_repo_history h USING (repo) LEFT JOIN t_packages p ON p.repo = r.repo LEFT JOIN t_symbols s ON s.package_id = p.package_id AND is_exported GROUP BY 1, 2",
    ),
    "a5_dev_dependencies": (lambda a: report.dev_dependencies(a), "SELECT consumer_package_id, resolved_package_id AS target_package_id, bool_or(dev) AS dev FROM t_package_deps WHERE resolved_package_id IS NOT NULL GROUP BY 1, 2"),
    "o5_sarif_results": (
        lambda a: report.sarif_results(_rows(a)).select("repo", "rule", "uri", "line", "col", "symbol", "message", "fingerprint"),
        _SARIF_SQL,
    ),
    "k2_sarif_logs": (
        lambda a: report.sarif_logs(a, _rows(a)),
        f"""SELECT repo, CAST(to_json({{'version': '2.1.0', '$schema': 'https://json.schemastore.org/sarif-2.1.0.json', 'runs': [{{'tool': {{'driver': {{'name': 'refloom', 'rules': [{', '.join(f"{{'id': '{v}'}}" for v in report.LEVELS)}]}}}},
    'results': coalesce(list({{'ruleId': rule, 'level': level, 'message': {{'text': message}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': uri}}, 'region': {{'startLine': line, 'startColumn': col}}}}}}], 'partialFingerprints': {{'primary/v1': fingerprint}}}}
      ORDER BY rule, uri, line, symbol, message, level, col, fingerprint) FILTER (WHERE rule IS NOT NULL), [])}}]}}) AS VARCHAR) AS sarif
  FROM t_repos LEFT JOIN (SELECT *, CASE rule {' '.join(f"WHEN '{v}' THEN '{l}'" for v, l in report.LEVELS.items())} END AS level FROM ({_SARIF_SQL})) USING (repo) GROUP BY repo""",
    ),
    "j22_dependency_resolution": (_resolved, _RESOLVED_SQL),
    "w2_witness_hits": (lambda a: witness.witness_hits(a, _pending(a), _texts(a)), _HITS_SQL),
    "d9_witnessed_findings": (lambda a: _joined(witness.propagate(a, witness.apply_witness(a, a.verdicts, _texts(a))[0]), ["symbol_id", "verdict", "reasons", "blocked_by"]), _joined_sql("closed", ["symbol_id", "verdict", "reasons", "blocked_by"])),
    "w3_indexed_hits": (lambda a: witness.witness_hits(a, _pending(a), _seen(a)), _SEEN_SQL),
    "inv_violations": (lambda a: invariants.violations(a, a.findings), "SELECT '' AS rule, '' AS row WHERE false"),
}

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _plain(*spec) for name, spec in PLAIN.items()}
    found.update({name: _on(build) for name, (build, _) in {**BUILT, **REPORT}.items()})
    return found | testindex.queries() | testunseen.queries() | testentries.queries()


def oracle_sql() -> dict[str, str]:
    found = {name: oracle(_joined_sql(relation(of), columns.split())) for name, (of, columns) in PLAIN.items()}
    found.update({name: oracle(sql) for name, (_, sql) in BUILT.items()})
    found.update({name: oracle(sql, more=_MORE) for name, (_, sql) in REPORT.items()})
    return found | testindex.oracle_sql() | testunseen.oracle_sql() | testentries.oracle_sql()
