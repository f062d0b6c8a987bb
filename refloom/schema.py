"""Tables of an organisation, as Spark DDL (position columns are 0-based)."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "repos": "repo string, default_branch string, head_sha string, indexed_at long, index_status string",
    "excluded_repos": "repo string, reason string, manifests array<string>",
    "repo_history": "repo string, history string",
    "ignored_manifests": "repo string, manifest string, glob string",
    "packages": "package_id string, repo string, path string, manager string, name string, version string, visibility string, is_library boolean, entry_points array<string>",
    "package_deps": "consumer_package_id string, dep_manager string, dep_name string, dep_constraint string, resolved_package_id string, dev boolean, resolution string, ambiguous boolean",
    "promoted_packages": "package_id string, reason string",
    "symbols": "symbol_id long, symbol_str string, package_id string, file string, line int, col int, kind string, name string, parent_symbol_id long, is_exported boolean, first_seen_at long",
    "documents": "package_id string, file string, module_symbol_id long, is_entry boolean, is_generated boolean",
    "occurrences": "symbol_id long, package_id string, def_package_id string, file string, line int, col int, role int, enclosing_symbol_id long, is_export_site boolean, is_external boolean",
    "symbol_exports": "symbol_id long, entry_file string, exported_as string",
    "entry_symbols": "symbol_id long, kind string",
    "unindexed_loads": "package_id string, file string, module string, resolved boolean",
    "edges": "from_symbol_id long, to_symbol_id long, source string, from_package_id string, to_package_id string",
    "unresolved_refs": "consumer_package_id string, target_package_id string, symbol_str string, file string, line int, col int",
    "package_flags": "package_id string, flag string, reason string, file string, target_package_id string",
    "keep_rules": "package_id string, symbol_name string",
    "witness_files": "consumer_package_id string, target_package_id string, file string",
    "witness_ok": "symbol_id long, checked_at long",
    "findings": "symbol_id long, verdict string, reasons array<string>, blocked_by array<string>",
}

# The closed sets of names.
MANAGERS = ("npm", "pub")
VISIBILITIES = ("private", "published-private", "published-public")
VERDICTS = ("deletion_candidate", "deprecation_candidate", "unexport_candidate", "private_dead", "needs_review", "blocked", "version_skew")
HISTORIES = ("full", "shallow", "none")
SOURCES = ("scip", "overlay")


def empty(spark, name: str):
    return spark.createDataFrame([], TABLES[name])
