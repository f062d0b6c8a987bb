"""What each relation must hold, as DuckDB SQL over the derived organisation, for differential tests.

Written from the relations' definitions, not from the engine's plans: facts about files,
packages and symbols are gathered in a few wide relations, every use of a symbol is one row
of evidence, and the relations that queries show are selections of these. Each is one common
table expression; a query's oracle is the chain up to what it names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from refloom.functions import globs
from refloom.operators.analysis import TYPE_KINDS, VALUE_KINDS
from refloom.plans.testorg import NOW, POLICY, oracle_parts

_OLD = NOW - POLICY.min_age_days * 86400
#: Passes of the reconciliation that are written out; the derived organisation needs fewer (tested).
PASSES = 3


def _fits(column: str, wanted: list[str]) -> str:
    return f"coalesce(regexp_matches({column}, '{globs.path_regex(wanted)}'), false)"


def _support_name(column: str, suffix: str = "") -> str:
    return f"regexp_matches({column}, '{globs.name_regex(globs.TEST_SUPPORT_NAMES, suffix)}')"


def _names(kinds) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


_LAST = "regexp_extract({0}, '[^/]*$')"
_KEY = "replace(replace(replace(regexp_extract({0}, '[^/]*$'), '`', ''), '<get>', ''), '<set>', '')"

FACTS: list[tuple[str, str]] = [
    # --- packages and who blocks them
    (
        "blocking",
        """SELECT DISTINCT f.package_id AS blocker_package_id, f.flag, t.package_id, t.own FROM t_package_flags f
  JOIN (SELECT consumer_package_id AS source, NULL AS aim, resolved_package_id AS package_id, false AS own FROM t_package_deps WHERE resolved_package_id IS NOT NULL
    UNION ALL SELECT package_id, target_package_id, target_package_id, false FROM t_package_flags WHERE target_package_id IS NOT NULL
    UNION ALL SELECT package_id, NULL, package_id, true FROM t_package_flags WHERE target_package_id IS NULL) t
  ON t.source = f.package_id AND t.aim IS NOT DISTINCT FROM f.target_package_id""",
    ),
    (
        "pkg",
        """SELECT p.*, CASE WHEN path IN ('.', '') THEN '' ELSE path || '/' END AS base, visibility <> 'published-public' AS priv, coalesce(opaque, false) AS opaque, blockers, coalesce(used, false) AS used,
  coalesce(touched, false) AS touched, e.package_id IS NOT NULL AS promoted, history
  FROM t_packages p LEFT JOIN t_repo_history USING (repo) LEFT JOIN t_promoted_packages e USING (package_id)
  LEFT JOIN (SELECT package_id, bool_or(own) AS opaque, list(DISTINCT blocker_package_id || ':' || flag ORDER BY blocker_package_id || ':' || flag) AS blockers FROM blocking GROUP BY package_id) USING (package_id)
  LEFT JOIN (SELECT package_id, true AS touched, bool_or(dep) AS used FROM (
    SELECT resolved_package_id AS package_id, true AS dep FROM t_package_deps UNION ALL SELECT target_package_id, false FROM t_package_flags UNION ALL SELECT target_package_id, false FROM t_witness_files
    UNION ALL SELECT target_package_id, false FROM t_unresolved_refs UNION ALL SELECT to_package_id, false FROM t_edges WHERE to_package_id <> from_package_id) WHERE package_id IS NOT NULL GROUP BY package_id) USING (package_id)""",
    ),
    # --- files
    (
        "doc",
        f"""SELECT *, NOT surface AND {_fits("file", globs.TEST_GLOBS)} AS test, NOT surface AND {_fits("file", globs.SCRIPT_GLOBS)} AS script, NOT surface AND {_fits("shown", globs.DOCS_GLOBS)} AS docs,
  {_fits("below", globs.VENDORED_GLOBS)} AS vendored, {_fits("below", globs.VENDORED_GLOBS)} OR is_generated OR {_fits("file", globs.GENERATED_GLOBS)} AS generated
  FROM (SELECT d.*, manager, coalesce(manager = 'pub' AND starts_with(below, 'lib/'), false) AS surface, CASE WHEN promoted AND base <> '' THEN substr(file, length(base) + 1) ELSE file END AS shown
    FROM (SELECT d.*, CASE WHEN starts_with(d.file, base) THEN substr(d.file, length(base) + 1) END AS below, manager, promoted, base FROM t_documents d JOIN pkg USING (package_id)) d)""",
    ),
    # --- symbols and what encloses them
    ("modules", "SELECT DISTINCT id AS symbol_id FROM (SELECT module_symbol_id AS id FROM t_documents UNION ALL SELECT CASE kind WHEN 'file' THEN symbol_id END FROM t_symbols) WHERE id IS NOT NULL"),
    (
        "owners",
        """SELECT DISTINCT s.symbol_id, owner_id FROM t_symbols s
  JOIN (SELECT symbol_id, parent_symbol_id AS owner_id, true AS declared FROM t_symbols UNION ALL SELECT symbol_id, enclosing_symbol_id, false FROM t_occurrences WHERE role % 2 = 1) USING (symbol_id) JOIN t_symbols o ON o.symbol_id = owner_id
  WHERE declared OR (owner_id <> s.symbol_id AND o.package_id = s.package_id AND owner_id NOT IN (FROM modules))""",
    ),
    # each symbol with itself and all that enclose it
    ("kin", "SELECT symbol_id, symbol_id AS ancestor_id FROM t_symbols UNION SELECT kin.symbol_id, owner_id FROM kin JOIN owners ON owners.symbol_id = ancestor_id"),
    ("homes", "SELECT symbol_id, package_id FROM t_symbols UNION SELECT symbol_id, exporter_package_id FROM again"),
    (
        "again",
        """SELECT DISTINCT symbol_id, d.package_id AS exporter_package_id FROM t_symbol_exports x JOIN t_symbols s USING (symbol_id) JOIN t_packages own ON own.package_id = s.package_id
  JOIN (t_documents d JOIN t_packages other ON other.package_id = d.package_id) ON d.file = entry_file AND other.repo = own.repo WHERE d.package_id <> s.package_id""",
    ),
    ("dev_uses", "SELECT DISTINCT symbol_id, consumer_package_id AS package_id FROM homes JOIN t_package_deps ON resolved_package_id = homes.package_id WHERE dev"),
    (
        "support",
        f"""SELECT DISTINCT symbol_id FROM t_symbols s JOIN pkg p USING (package_id) LEFT JOIN doc d USING (package_id, file) LEFT JOIN t_symbol_exports x USING (symbol_id)
  WHERE {_support_name("regexp_replace(p.name, '^[^/]*/', '')")}
  OR (starts_with(s.file, p.base) AND regexp_matches(substr(s.file, length(p.base) + 1), '{globs.name_regex(globs.TEST_SUPPORT_DIRS)}'))
  OR (d.surface AND {_support_name(_LAST.format("s.file"), ".dart")})
  OR {_support_name("CASE split_part(" + _LAST.format("entry_file") + ", '.', 1) WHEN 'index' THEN " + _LAST.format("regexp_replace(entry_file, '/?[^/]*$', '')") + " ELSE split_part(" + _LAST.format("entry_file") + ", '.', 1) END")}""",
    ),
    # --- uses: one row for a reference and each symbol that it is a use of
    (
        "uses",
        """SELECT k.ancestor_id AS symbol_id, o.symbol_id AS member_symbol_id, o.package_id, o.file, o.line, o.col, o.role, o.enclosing_symbol_id, o.is_external,
  coalesce(d.test, false) AS in_test, coalesce(d.docs, false) OR (o.is_external AND c.promoted AND c.repo = h.repo) AS in_docs, o.is_external AND v.symbol_id IS NOT NULL AS dev_dep, o.is_external AND t.symbol_id IS NOT NULL AS test_support
  FROM t_occurrences o JOIN kin k USING (symbol_id) JOIN t_symbols s ON s.symbol_id = k.ancestor_id JOIN pkg h ON h.package_id = s.package_id JOIN pkg c ON c.package_id = o.package_id
  LEFT JOIN doc d ON d.package_id = o.package_id AND d.file = o.file LEFT JOIN dev_uses v ON v.symbol_id = k.ancestor_id AND v.package_id = o.package_id LEFT JOIN support t ON t.symbol_id = k.ancestor_id
  WHERE o.role % 2 = 0 AND NOT o.is_export_site""",
    ),
    ("outer_uses", "SELECT * FROM uses WHERE is_external"),
    ("inner_uses", "SELECT u.* FROM uses u LEFT JOIN kin w ON w.symbol_id = enclosing_symbol_id AND w.ancestor_id = u.symbol_id WHERE NOT is_external AND w.symbol_id IS NULL"),
    ("drawn", "SELECT ancestor_id AS symbol_id, from_package_id, from_package_id <> to_package_id AS is_external FROM t_edges JOIN kin ON kin.symbol_id = to_symbol_id WHERE source = 'overlay'"),
    (
        "evidence",
        """SELECT symbol_id, true AS outside, package_id, (NOT in_test OR dev_dep OR test_support) AND NOT in_docs AS counts, in_test AND NOT (dev_dep OR test_support) AS by_test, in_docs AS by_docs FROM outer_uses
  UNION ALL SELECT symbol_id, false, package_id, NOT (in_test OR in_docs), in_test, in_docs FROM inner_uses UNION ALL SELECT symbol_id, is_external, from_package_id, true, false, false FROM drawn""",
    ),
    (
        "tally",
        "SELECT symbol_id, count_if(counts AND outside) AS outer_n, count_if(counts AND NOT outside) AS inner_n, bool_or(by_test) AS tested, bool_or(by_docs) AS documented FROM evidence GROUP BY symbol_id",
    ),
    (
        "sym",
        f"""SELECT s.*, p.priv, p.blockers, p.opaque, p.is_library, coalesce(outer_n, 0) AS outer_n, coalesce(inner_n, 0) AS inner_n, coalesce(tested, false) AS tested, coalesce(documented, false) AS documented,
  CASE WHEN first_seen_at IS NULL THEN history <> 'full' ELSE first_seen_at <= {_OLD} END AS aged, k.package_id IS NOT NULL AS kept, e.symbol_id IS NOT NULL AS entry, e.kind AS entry_kind,
  NOT is_library AND NOT used AND coalesce(default_export, false) AS program, coalesce(d.generated, false) AS generated, coalesce(d.script, false) AS script, coalesce(d.test, false) AS test, coalesce(d.docs, false) AS docs, m.symbol_id IS NOT NULL AS module
  FROM t_symbols s JOIN pkg p USING (package_id) LEFT JOIN tally USING (symbol_id) LEFT JOIN t_entry_symbols e USING (symbol_id) LEFT JOIN doc d ON d.package_id = s.package_id AND d.file = s.file LEFT JOIN modules m USING (symbol_id)
  LEFT JOIN (SELECT DISTINCT package_id, symbol_name FROM t_keep_rules) k ON k.package_id = s.package_id AND k.symbol_name IN ('*', s.name)
  LEFT JOIN (SELECT symbol_id, bool_or(exported_as = 'default') AS default_export FROM t_symbol_exports GROUP BY symbol_id) USING (symbol_id)""",
    ),
    # --- first verdicts
    (
        "base_verdicts",
        """SELECT symbol_id, CASE WHEN blockers IS NOT NULL THEN 'blocked' WHEN inner_n = 0 THEN 'needs_review' WHEN priv THEN 'unexport_candidate' ELSE 'deprecation_candidate' END AS verdict,
  list_concat(CASE WHEN inner_n + tested::INT + documented::INT = 0 THEN ['no_refs'] ELSE list_concat(list_concat(CASE WHEN inner_n > 0 THEN ['internal_refs_only'] ELSE [] END, CASE WHEN tested THEN ['only_test_refs'] ELSE [] END), CASE WHEN documented THEN ['only_docs_refs'] ELSE [] END) END,
    CASE WHEN blockers IS NULL AND inner_n = 0 THEN ['witness_pending'] ELSE [] END) AS reasons, coalesce(blockers, []) AS blocked_by
  FROM sym WHERE is_exported AND aged AND outer_n = 0 AND NOT (kept OR entry OR program OR generated OR script)""",
    ),
    # --- reachability
    (
        "reach_edges",
        """SELECT DISTINCT unnest(ends).a AS a, unnest(ends).b AS b FROM (
  SELECT [{'a': from_symbol_id, 'b': to_symbol_id}] AS ends FROM t_edges WHERE to_package_id = from_package_id UNION ALL SELECT [{'a': owner_id, 'b': symbol_id}, {'a': symbol_id, 'b': owner_id}] FROM owners
  UNION ALL SELECT [{'a': s.symbol_id, 'b': d.module_symbol_id}] FROM t_symbols s JOIN t_documents d USING (package_id, file) WHERE d.module_symbol_id <> s.symbol_id)""",
    ),
    (
        "reach_seeds_before",
        """SELECT symbol_id FROM sym WHERE is_exported OR entry UNION SELECT module_symbol_id FROM doc WHERE (is_entry OR script) AND module_symbol_id IS NOT NULL
  UNION SELECT from_symbol_id FROM t_edges WHERE source = 'overlay'""",
    ),
    ("reachable", "FROM reach_seeds_before UNION SELECT b FROM reachable JOIN reach_edges ON a = symbol_id"),
    # --- signatures
    ("inward", "SELECT symbol_id FROM base_verdicts WHERE list_contains(reasons, 'internal_refs_only')"),
    (
        "signature_refs",
        f"""SELECT DISTINCT o.symbol_id, k.ancestor_id AS api_symbol_id FROM t_occurrences o JOIN sym named USING (symbol_id) JOIN inward USING (symbol_id) JOIN sym decl ON decl.symbol_id = o.enclosing_symbol_id JOIN kin k ON k.symbol_id = decl.symbol_id
  JOIN sym api ON api.symbol_id = k.ancestor_id JOIN pkg p ON p.package_id = named.package_id LEFT JOIN kin w ON w.symbol_id = decl.symbol_id AND w.ancestor_id = named.symbol_id
  WHERE o.role % 2 = 0 AND NOT o.is_export_site AND NOT o.is_external AND api.is_exported AND api.symbol_id <> named.symbol_id AND decl.package_id = named.package_id AND w.symbol_id IS NULL AND NOT regexp_matches(decl.name, '^[_#]')
  AND ((o.role >> 20) % 2 = 1 OR decl.kind IN ({_names(TYPE_KINDS)}) OR decl.symbol_str LIKE '%#'
    OR ((o.file, o.line) = (decl.file, decl.line) AND (o.col < decl.col OR decl.kind IN ({_names(VALUE_KINDS)}) OR (p.manager = 'npm' AND named.symbol_str LIKE '%#'))))""",
    ),
    ("thrown", "SELECT DISTINCT symbol_id FROM t_occurrences WHERE role % 2 = 1 AND (role >> 21) % 2 = 1"),
    (
        "signature_pinned",
        """SELECT DISTINCT symbol_id FROM (SELECT r.symbol_id FROM signature_refs r LEFT JOIN inward i ON i.symbol_id = api_symbol_id WHERE i.symbol_id IS NULL UNION ALL SELECT symbol_id FROM inward JOIN thrown USING (symbol_id))
  UNION SELECT r.symbol_id FROM signature_refs r JOIN signature_pinned p ON p.symbol_id = api_symbol_id""",
    ),
    ("unexport_dropped", "SELECT symbol_id FROM inward LEFT JOIN signature_pinned s USING (symbol_id) JOIN t_symbols USING (symbol_id) JOIN pkg USING (package_id) WHERE s.symbol_id IS NOT NULL OR (pkg.visibility = 'private' AND NOT touched)"),
]


def _alive(name: str, source: str) -> list[tuple[str, str]]:
    """``name``: what stays reachable once the candidates of ``source`` no longer count; ``name_going``: those candidates."""
    going = "verdict LIKE '%!_candidate' ESCAPE '!' OR (verdict = 'needs_review' AND list_contains(reasons, 'witness_pending'))"
    return [
        (f"{name}_going", f"SELECT symbol_id, name FROM {source} JOIN t_symbols USING (symbol_id) WHERE {going}"),
        (name, f"SELECT s.symbol_id FROM reach_seeds_before s LEFT JOIN {name}_going g USING (symbol_id) WHERE g.symbol_id IS NULL UNION SELECT b FROM {name} JOIN reach_edges ON a = symbol_id"),
    ]


def settled(name: str, source: str) -> list[tuple[str, str]]:
    """``name``: the findings of ``source`` after PASSES passes that take islands back which are reachable again."""
    parts, last = [], source
    for k in range(1, PASSES + 1):
        alive, out = f"{name}_alive{k}", f"{name}_pass{k}"
        parts += _alive(alive, last)
        parts.append((
            out,
            f"""SELECT symbol_id, CASE WHEN NOT back OR NOT open THEN verdict WHEN priv THEN 'unexport_candidate' ELSE 'deprecation_candidate' END AS verdict,
  CASE WHEN back THEN list_filter(reasons, lambda r: r <> 'dead_island' AND (r <> 'witness_pending' OR NOT open)) ELSE reasons END AS reasons, blocked_by
  FROM (SELECT f.*, pkg.priv, d.symbol_id IS NOT NULL AS dropped, verdict <> 'needs_review' OR list_contains(reasons, 'witness_pending') AS open,
    v.symbol_id IS NOT NULL AND list_contains(reasons, 'dead_island') AND verdict IN ('deletion_candidate', 'deprecation_candidate', 'needs_review') AS back
    FROM {last} f JOIN t_symbols USING (symbol_id) JOIN pkg USING (package_id) LEFT JOIN {alive} v USING (symbol_id) LEFT JOIN unexport_dropped d USING (symbol_id)) WHERE NOT (back AND open AND dropped)""",
        ))
        last = out
    return [*parts, (name, f"FROM {last}")]


def with_dead(name: str, source: str) -> list[tuple[str, str]]:
    """``name``: ``source`` and the privately dead; the steps to them as ``name_...``."""
    return [
        *_alive(f"{name}_alive", source),
        (f"{name}_spread", f"SELECT symbol_id AS origin_id, symbol_id FROM {name}_alive_going UNION SELECT origin_id, b FROM {name}_spread s JOIN reach_edges ON a = s.symbol_id WHERE b NOT IN (FROM {name}_alive)"),
        (
            f"{name}_unlocked",
            f"""SELECT s.symbol_id, list(DISTINCT 'unlocked_by:' || g.name ORDER BY 'unlocked_by:' || g.name) AS reasons FROM {name}_spread s JOIN {name}_alive_going g ON g.symbol_id = origin_id
  JOIN eligible ON eligible.symbol_id = s.symbol_id JOIN reachable ON reachable.symbol_id = s.symbol_id LEFT JOIN {name}_alive v ON v.symbol_id = s.symbol_id WHERE v.symbol_id IS NULL GROUP BY s.symbol_id""",
        ),
        (f"{name}_gone", f"SELECT symbol_id, ['already_unreachable'] AS reasons FROM unreachable_before UNION ALL FROM {name}_unlocked"),
        (
            f"{name}_dead",
            f"""SELECT g.symbol_id, 'private_dead' AS verdict, g.reasons, []::VARCHAR[] AS blocked_by FROM {name}_gone g
  LEFT JOIN (SELECT DISTINCT k.symbol_id FROM kin k JOIN (SELECT symbol_id FROM {name}_gone UNION SELECT symbol_id FROM {name}_alive_going) a ON a.symbol_id = ancestor_id WHERE k.symbol_id <> ancestor_id) inner_ USING (symbol_id) WHERE inner_.symbol_id IS NULL""",
        ),
        (name, f"FROM {source} UNION ALL FROM {name}_dead"),
    ]


VERDICTS: list[tuple[str, str]] = [
    *_alive("reachable_after_base", "base_verdicts"),
    (
        "verdicts",
        """SELECT symbol_id, CASE WHEN island THEN 'needs_review' ELSE verdict END AS verdict, list_concat(reasons, CASE WHEN island THEN ['dead_island', 'witness_pending'] ELSE [] END) AS reasons, blocked_by
  FROM (SELECT b.*, v.symbol_id IS NULL AND verdict IN ('unexport_candidate', 'deprecation_candidate') AS island, d.symbol_id IS NOT NULL AND (v.symbol_id IS NOT NULL OR verdict = 'blocked') AS out
    FROM base_verdicts b LEFT JOIN reachable_after_base v USING (symbol_id) LEFT JOIN unexport_dropped d USING (symbol_id)) WHERE NOT out""",
    ),
    ("loads", "SELECT package_id, bool_or(NOT resolved) AS open FROM t_unindexed_loads GROUP BY package_id"),
    (
        "scope",
        "SELECT symbol_id, package_id FROM sym WHERE NOT (is_exported OR module OR entry OR kept OR opaque OR test OR generated OR docs OR script) AND blockers IS NULL AND kind IS DISTINCT FROM 'anonymous-member' AND kind IS DISTINCT FROM 'import-prefix'",
    ),
    (
        "ways_in",
        """SELECT package_id FROM pkg LEFT JOIN loads USING (package_id) WHERE NOT coalesce(open, false) AND (package_id IN (SELECT package_id FROM t_documents WHERE is_entry)
  OR package_id IN (SELECT s.package_id FROM sym s LEFT JOIN t_unindexed_loads l ON l.package_id = s.package_id AND l.module = s.file AND l.resolved WHERE s.is_exported OR (s.entry_kind = 'runtime' AND l.module IS NULL)))""",
    ),
    ("eligible", "SELECT symbol_id FROM scope JOIN ways_in USING (package_id)"),
    ("unreachable_before", "SELECT symbol_id FROM eligible ANTI JOIN reachable USING (symbol_id)"),
    *settled("settled", "verdicts"),
    *with_dead("findings", "settled"),
]

SKEW: list[tuple[str, str]] = [
    ("asked", f"SELECT *, {_KEY.format('symbol_str')} AS dkey FROM t_unresolved_refs"),
    ("head", f"SELECT symbol_id, package_id, parent_symbol_id, {_KEY.format('symbol_str')} AS dkey, parent_symbol_id IS NULL AND symbol_str LIKE '%#' AS top_type FROM t_symbols"),
    # types that a missing member may have come from: its own, and all that these name
    (
        "ancestry",
        """SELECT DISTINCT a.target_package_id, a.dkey, h.symbol_id AS type_id FROM asked a JOIN head h ON h.package_id = a.target_package_id AND h.dkey = regexp_extract(a.dkey, '^[^#]+#') WHERE regexp_matches(a.dkey, '^[^#]+#.')
  UNION SELECT target_package_id, s.dkey, to_symbol_id FROM ancestry s JOIN t_edges ON from_symbol_id = type_id JOIN head h ON h.symbol_id = to_symbol_id WHERE h.top_type""",
    ),
    (
        "there",
        """SELECT DISTINCT a.target_package_id, a.dkey FROM asked a LEFT JOIN head same ON same.package_id = a.target_package_id AND same.dkey = a.dkey AND a.dkey <> ''
  LEFT JOIN (SELECT s.target_package_id, s.dkey FROM ancestry s JOIN head m ON m.parent_symbol_id = type_id WHERE regexp_replace(m.dkey, '^[^#]*#', '') = regexp_replace(s.dkey, '^[^#]*#', '')) i ON i.target_package_id = a.target_package_id AND i.dkey = a.dkey
  WHERE same.symbol_id IS NOT NULL OR i.dkey IS NOT NULL""",
    ),
    (
        "pinned_apart",
        """SELECT DISTINCT consumer_package_id, resolved_package_id FROM (SELECT *, regexp_extract(dep_constraint, '^([~^]?)[0-9][0-9A-Za-z.+-]*$', 1) AS mark, regexp_replace(dep_constraint, '^[~^]', '') AS wanted
    FROM t_package_deps JOIN t_packages ON package_id = resolved_package_id WHERE version IS NOT NULL AND regexp_matches(dep_constraint, '^[~^]?[0-9][0-9A-Za-z.+-]*$'))
  WHERE CASE mark WHEN '' THEN wanted <> version ELSE split_part(wanted, '.', 1) <> split_part(version, '.', 1) END""",
    ),
    (
        "unresolved_ref_classes",
        """SELECT a.consumer_package_id, a.target_package_id, symbol_str, file, line, col, CASE WHEN c.repo = t.repo AND p.consumer_package_id IS NULL THEN 'same_repo' WHEN t.opaque OR x.package_id IS NULL THEN 'opaque_target'
  WHEN symbol_str = '*' OR (symbol_str LIKE '% %.json`/%') THEN 'unindexed_module' WHEN h.dkey IS NOT NULL THEN 'moved_at_head' ELSE 'version_skew' END AS class
  FROM asked a JOIN pkg c ON c.package_id = a.consumer_package_id JOIN pkg t ON t.package_id = a.target_package_id LEFT JOIN pinned_apart p ON p.consumer_package_id = a.consumer_package_id AND p.resolved_package_id = a.target_package_id
  LEFT JOIN (SELECT DISTINCT package_id FROM t_symbols WHERE is_exported) x ON x.package_id = a.target_package_id LEFT JOIN there h ON h.target_package_id = a.target_package_id AND h.dkey = a.dkey""",
    ),
]

#: What queries show, by the relation's name.
SHOWN: dict[str, str] = {
    "ref_occurrences": "SELECT * FROM t_occurrences WHERE role % 2 = 0 AND NOT is_export_site",
    "module_symbols": "FROM modules",
    "private_packages": "SELECT package_id FROM pkg WHERE priv",
    "opaque_packages": "SELECT package_id FROM pkg WHERE opaque",
    "surface_files": "SELECT package_id, file FROM doc WHERE surface",
    "test_files": "SELECT package_id, file FROM doc WHERE test",
    "doc_files": "SELECT package_id, file FROM doc WHERE docs",
    "vendored_files": "SELECT package_id, file FROM doc WHERE vendored",
    "generated_files": "SELECT package_id, file FROM doc WHERE generated",
    "script_files": "SELECT package_id, file FROM doc WHERE script",
    "symbol_age_ok": "SELECT symbol_id FROM sym WHERE aged",
    "kept_symbols": "SELECT DISTINCT symbol_id FROM sym WHERE kept",
    "private_dead_scope": "SELECT DISTINCT symbol_id, package_id FROM scope",
    "private_dead_eligible": "SELECT DISTINCT symbol_id FROM eligible",
    "symbol_owners": "FROM owners",
    "owner_ref_occurrences": "FROM uses",
    "reexporting_packages": "FROM again",
    "external_ref_occurrences": "SELECT *, package_id AS consumer_package_id FROM outer_uses",
    "internal_ref_occurrences": "FROM inner_uses",
    "overlay_refs": "FROM drawn",
    "blocked_packages": "SELECT DISTINCT package_id, blocker_package_id, flag FROM blocking WHERE NOT own",
    "verdict_blockers": "SELECT DISTINCT package_id, blocker_package_id, flag FROM blocking",
    "runtime_entry_defaults": "SELECT DISTINCT symbol_id FROM sym WHERE program",
    "test_support_symbols": "FROM support",
    "unexport_exempt_packages": "SELECT package_id FROM pkg WHERE visibility = 'private' AND NOT touched",
    "external_refs": "SELECT symbol_id, package_id AS consumer_package_id, count(*) AS n FROM evidence WHERE outside AND counts GROUP BY ALL",
    "internal_refs": "SELECT symbol_id, inner_n AS n FROM tally WHERE inner_n > 0",
    "private_dead_skipped": """SELECT package_id, coalesce('unresolved load: ' || first || CASE WHEN n > 1 THEN ' (+' || (n - 1) || ' more)' ELSE '' END, 'no known entry points') AS reason, count(DISTINCT symbol_id) AS symbols
  FROM scope ANTI JOIN ways_in USING (package_id) ANTI JOIN reachable USING (symbol_id) LEFT JOIN (SELECT package_id, count(*) AS n, min_by(module || ' in ' || file, (file, module)) AS first FROM t_unindexed_loads WHERE NOT resolved GROUP BY package_id) USING (package_id) GROUP BY ALL""",
    "test_only_refs": "SELECT symbol_id FROM tally WHERE tested AND outer_n = 0",
    "docs_only_refs": "SELECT symbol_id FROM tally WHERE documented AND outer_n = 0",
    "private_dead_packages": "FROM ways_in",
    "symbol_ancestors": "FROM kin WHERE symbol_id <> ancestor_id",
    "candidates": "FROM findings_alive_going",
    "candidate_reach": "FROM findings_spread",
    "private_dead_unlocked": "FROM findings_unlocked",
    "private_dead": "FROM findings_dead",
}
_RECURSIVE = ("kin", "reachable", "reachable_after_base", "signature_pinned", "ancestry")


def _is_recursive(name: str) -> bool:
    return name in _RECURSIVE or name.endswith("_spread") or "_alive" in name and not name.endswith("_going")


@lru_cache(maxsize=None)
def _parts() -> tuple[tuple[str, str], ...]:
    facts = dict(FACTS)
    order = [n for n, _ in FACTS if n != "again"]
    order.insert(order.index("homes"), "again")
    return (*oracle_parts(), *((n, facts[n]) for n in order), *VERDICTS, *SKEW, *((f"shown_{n}", sql) for n, sql in SHOWN.items()))


def relation(name: str) -> str:
    """The common table expression that holds what the engine calls ``name``."""
    return f"shown_{name}" if name in SHOWN else name


def oracle(final: str, more: list[tuple[str, str]] = ()) -> str:
    """SQL of a query: the chain of relations that ``final`` needs, then ``final``."""
    needed, text = set(), final
    parts = [*_parts(), *more]
    for name, sql in reversed(parts):  # only what is used, so that small queries stay small
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + sql
    body = ",\n".join(f"{n} AS {'' if _is_recursive(n) else 'MATERIALIZED '}({s})" for n, s in parts if n in needed)
    if final.lstrip().startswith("WITH "):  # the query brings relations of its own
        return f"WITH RECURSIVE {body},\n{final.lstrip()[5:]}"
    return f"WITH RECURSIVE {body}\n{final}" if body else final
