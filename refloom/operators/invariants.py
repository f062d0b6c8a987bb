"""Integrity rules as queries that must return no row; a stage runs them at its end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.operators.analysis import CANDIDATES, Analysis, anti, semi
from refloom.schema import HISTORIES, MANAGERS, SOURCES, VERDICTS, VISIBILITIES

# Fixed values: (child table, column, parent table, parent column) of every reference.
REFERENCES = (
    ("packages", "repo", "repos", "repo"),
    ("repo_history", "repo", "repos", "repo"),
    ("package_deps", "consumer_package_id", "packages", "package_id"),
    ("package_deps", "resolved_package_id", "packages", "package_id"),
    ("symbols", "package_id", "packages", "package_id"),
    ("symbols", "parent_symbol_id", "symbols", "symbol_id"),
    ("documents", "package_id", "packages", "package_id"),
    ("documents", "module_symbol_id", "symbols", "symbol_id"),
    ("occurrences", "symbol_id", "symbols", "symbol_id"),
    ("occurrences", "enclosing_symbol_id", "symbols", "symbol_id"),
    ("symbol_exports", "symbol_id", "symbols", "symbol_id"),
    ("entry_symbols", "symbol_id", "symbols", "symbol_id"),
    ("edges", "from_symbol_id", "symbols", "symbol_id"),
    ("edges", "to_symbol_id", "symbols", "symbol_id"),
    ("package_flags", "package_id", "packages", "package_id"),
    ("keep_rules", "package_id", "packages", "package_id"),
    ("unresolved_refs", "target_package_id", "packages", "package_id"),
    ("witness_files", "target_package_id", "packages", "package_id"),
)
KEYS = {"packages": ["package_id"], "symbols": ["symbol_id"], "documents": ["package_id", "file"], "repos": ["repo"]}


def _row(rule: str, df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("row"))


def _placed(df: DataFrame, symbols: DataFrame, id_col: str, package_col: str) -> DataFrame:
    """Rows whose symbol is not of the package that the row says."""
    own = symbols.select(F.col("symbol_id").alias(id_col), F.col("package_id").alias("own_package"))
    return df.join(own, id_col).where(~F.col("own_package").eqNullSafe(F.col(package_col)))


def violations(a: Analysis, findings: DataFrame | None = None) -> DataFrame:
    """rule, row of everything that breaks a rule; findings are checked where given."""
    t, out = a.t, []
    for child, column, parent, key in REFERENCES:
        rows = t[child].where(F.col(column).isNotNull()).select(F.col(column).alias("ref")).distinct()
        out.append(_row(f"{child}.{column} exists", anti(rows, t[parent].select(F.col(key).alias("ref")), "ref"), "ref"))
    for name, key in KEYS.items():
        out.append(_row(f"{name} key", t[name].groupBy(*key).count().where("count > 1"), *key))
    for name, column, allowed in (("packages", "manager", MANAGERS), ("packages", "visibility", VISIBILITIES), ("repo_history", "history", HISTORIES), ("edges", "source", SOURCES)):
        out.append(_row(f"{name}.{column} known", t[name].where(~F.col(column).isin(*allowed)), column))
    symbols = t["symbols"]
    out.append(_row("occurrence of its symbol's package", _placed(t["occurrences"], symbols, "symbol_id", "def_package_id"), "symbol_id", "def_package_id"))
    for end in ("from", "to"):
        out.append(_row(f"edge {end} its symbol's package", _placed(t["edges"], symbols, f"{end}_symbol_id", f"{end}_package_id"), "from_symbol_id", "to_symbol_id"))
    parents = symbols.where("parent_symbol_id is not null").select(F.col("symbol_id").alias("child"), F.col("parent_symbol_id").alias("parent"), "package_id")
    out.append(_row("parent in the same package", _placed(parents, symbols, "parent", "package_id"), "child"))
    modules = t["documents"].where("module_symbol_id is not null")
    out.append(_row("module symbol in the same package", _placed(modules, symbols, "module_symbol_id", "package_id"), "package_id", "file"))
    out.append(_row("self target", t["package_flags"].where("target_package_id = package_id"), "package_id"))
    if findings is not None:
        f = findings.join(symbols.select("symbol_id", "package_id"), "symbol_id")
        going = f.where(F.col("verdict").isin(*CANDIDATES))
        out += [
            _row("verdict known", f.where(~F.col("verdict").isin(*VERDICTS)), "symbol_id"),
            _row("candidate without opaque consumer", semi(going, a.blocked_packages.select("package_id"), "package_id"), "symbol_id"),
            _row("deletion and unexport in private packages", anti(f.where("verdict in ('deletion_candidate', 'unexport_candidate')"), a.private_packages, "package_id"), "symbol_id"),
            _row("deprecation in published packages", semi(f.where("verdict = 'deprecation_candidate'"), a.private_packages, "package_id"), "symbol_id"),
            _row("candidate not kept", semi(going, a.kept_symbols, "symbol_id"), "symbol_id"),
            _row("deletion witnessed", anti(f.where("verdict = 'deletion_candidate'"), t["witness_ok"].select("symbol_id"), "symbol_id"), "symbol_id"),
        ]
    return reduce(DataFrame.unionByName, out)
