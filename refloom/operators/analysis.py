"""Every relation of the cross-reference analysis, as lazily built DataFrames.

Names follow what a relation holds. Recursion results and what many relations read
are materialised once; everything else is a plan that Catalyst sees whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import globs
from refloom.functions.text import after, basename, descriptor_key, dirname, package_base, stem
from refloom.operators.fixpoint import fixpoint, reach_by_package, wide_packages
from refloom.storage import materialize, materialize_counted

# Role bits of an occurrence.
DEFINITION, SIGNATURE, ERROR_CLASS = 1, 1 << 20, 1 << 21
# Verdicts and reasons.
CANDIDATES = ("deletion_candidate", "unexport_candidate", "deprecation_candidate")
TYPE_KINDS = ("class", "interface", "typealias", "type", "enum", "mixin", "extension", "struct", "trait", "protocol")
VALUE_KINDS = ("field", "variable", "property", "constant", "staticfield", "staticproperty", "staticvariable")
DAY = 86400
ISLAND_PASSES = 10


@dataclass(frozen=True)
class Policy:
    """Settings of a run; None for an age or a time means not set, which lets nothing pass."""

    min_age_days: int | None = 180
    trust_private_registry: bool = True
    count_tests: bool = False
    count_docs: bool = False
    closed_org: bool = False
    now: int | None = None


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def marked(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """``left`` with a boolean column: has ``right`` a row of the same key?"""
    keys = right.select(*on).distinct().withColumn(name, F.lit(True))
    return left.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("symbol_id")).where(F.col(column).isNotNull())


class Analysis:
    """The relations over one organisation's tables (see ``refloom.schema``)."""

    def __init__(self, tables: dict[str, DataFrame], policy: Policy):
        self.t, self.policy = tables, policy

    # --- packages -----------------------------------------------------------------------

    @cached_property
    def private_packages(self) -> DataFrame:
        trusted = F.lit(self.policy.trust_private_registry) & (F.col("visibility") == "published-private")
        return self.t["packages"].where((F.col("visibility") == "private") | trusted | F.lit(self.policy.closed_org)).select("package_id")

    @cached_property
    def opaque_packages(self) -> DataFrame:
        return self.t["package_flags"].where("target_package_id is null").select("package_id").distinct()

    @cached_property
    def blocked_packages(self) -> DataFrame:
        """package_id, blocker_package_id, flag: packages with a consumer that cannot be seen into."""
        flags = self.t["package_flags"]
        deps = self.t["package_deps"].where("resolved_package_id is not null").select(F.col("resolved_package_id").alias("blocked"), F.col("consumer_package_id").alias("package_id"))
        by_dep = deps.join(flags, "package_id").where(F.col("target_package_id").isNull() | (F.col("target_package_id") == F.col("blocked")))
        by_dep = by_dep.select(F.col("blocked").alias("package_id"), F.col("package_id").alias("blocker_package_id"), "flag")
        aimed = flags.where("target_package_id is not null").select(F.col("target_package_id").alias("package_id"), F.col("package_id").alias("blocker_package_id"), "flag")
        return by_dep.unionByName(aimed).distinct()

    @cached_property
    def verdict_blockers(self) -> DataFrame:
        own = self.t["package_flags"].where("target_package_id is null").select("package_id", F.col("package_id").alias("blocker_package_id"), "flag")
        return self.blocked_packages.unionByName(own).distinct()

    @cached_property
    def unexport_exempt_packages(self) -> DataFrame:
        """Private packages that nothing outside could use."""
        out = self.t["packages"].where("visibility = 'private'").select("package_id").distinct()
        crossing = self.t["edges"].where("from_package_id <> to_package_id")
        for source, column in (
            (self.t["package_deps"], "resolved_package_id"),
            (self.t["package_flags"], "target_package_id"),
            (self.t["witness_files"], "target_package_id"),
            (self.t["unresolved_refs"], "target_package_id"),
            (crossing, "to_package_id"),
        ):
            out = anti(out, source.where(F.col(column).isNotNull()).select(F.col(column).alias("package_id")), "package_id")
        return out

    # --- files --------------------------------------------------------------------------

    @cached_property
    def _located(self) -> DataFrame:
        """Documents with their path below the package root (null outside it)."""
        p = self.t["packages"].select("package_id", "manager", package_base(F.col("path")).alias("base"))
        d = self.t["documents"].join(p, "package_id")
        return d.withColumn("rel", F.when(F.col("file").startswith(F.col("base")), after(F.col("file"), F.col("base"))))

    @cached_property
    def surface_files(self) -> DataFrame:
        return self._located.where((F.col("manager") == "pub") & F.col("rel").startswith("lib/")).select("package_id", "file")

    def _classed(self, wanted: list[str]) -> DataFrame:
        found = self.t["documents"].where(globs.matches(F.col("file"), wanted)).select("package_id", "file")
        return anti(found, self.surface_files, ["package_id", "file"])

    @cached_property
    def test_files(self) -> DataFrame:
        return self._classed(globs.TEST_GLOBS)

    @cached_property
    def script_files(self) -> DataFrame:
        return self._classed(globs.SCRIPT_GLOBS)

    @cached_property
    def doc_files(self) -> DataFrame:
        """Documentation folders; in a promoted package only below its root."""
        p = self.t["packages"].select("package_id", "path")
        d = marked(self.t["documents"].join(p, "package_id"), self.t["promoted_packages"], ["package_id"], "promoted")
        whole = ~F.col("promoted") | F.col("path").isin(".", "")
        rel = F.when(whole, F.col("file")).otherwise(F.col("file").substr(F.length("path") + 2, F.length("file")))
        found = d.where(globs.matches(rel, globs.DOCS_GLOBS)).select("package_id", "file")
        return anti(found, self.surface_files, ["package_id", "file"])

    @cached_property
    def vendored_files(self) -> DataFrame:
        return self._located.where(globs.matches(F.col("rel"), globs.VENDORED_GLOBS)).select("package_id", "file")

    @cached_property
    def generated_files(self) -> DataFrame:
        d = self.t["documents"]
        own = d.where(F.col("is_generated") | globs.matches(F.col("file"), globs.GENERATED_GLOBS)).select("package_id", "file")
        return self.vendored_files.unionByName(own).distinct()

    # --- owners -------------------------------------------------------------------------

    @cached_property
    def module_symbols(self) -> DataFrame:
        files = self.t["symbols"].where("kind = 'file'").select("symbol_id")
        return ids(self.t["documents"], "module_symbol_id").unionByName(files).distinct()

    @cached_property
    def ref_occurrences(self) -> DataFrame:
        return self.t["occurrences"].where((F.col("role").bitwiseAND(DEFINITION) == 0) & ~F.col("is_export_site")).drop("is_export_site")

    @cached_property
    def symbol_owners(self) -> DataFrame:
        s = self.t["symbols"]
        parents = s.where("parent_symbol_id is not null").select("symbol_id", F.col("parent_symbol_id").alias("owner_id"))
        inside = self.t["occurrences"].where((F.col("role").bitwiseAND(DEFINITION) == 1) & (F.col("enclosing_symbol_id") != F.col("symbol_id")))
        inside = inside.select("symbol_id", F.col("enclosing_symbol_id").alias("owner_id")).distinct()
        here = s.select("symbol_id", F.col("package_id").alias("p"))
        there = s.select(F.col("symbol_id").alias("owner_id"), F.col("package_id").alias("q"))
        inside = inside.join(here, "symbol_id").join(there, "owner_id").where("p = q").select("symbol_id", "owner_id")
        inside = anti(inside, self.module_symbols.select(F.col("symbol_id").alias("owner_id")), "owner_id")
        return materialize(parents.unionByName(inside).distinct())

    @cached_property
    def symbol_ancestors(self) -> DataFrame:
        owners = self.symbol_owners
        up = owners.select(F.col("symbol_id").alias("ancestor_id"), F.col("owner_id").alias("higher"))
        seed = owners.select("symbol_id", F.col("owner_id").alias("ancestor_id"))
        found = fixpoint(seed, lambda front: front.join(up, "ancestor_id").select("symbol_id", F.col("higher").alias("ancestor_id")))
        return materialize(found)

    @cached_property
    def owner_ref_occurrences(self) -> DataFrame:
        """References, each again for every owner of what it names (a bag: counts depend on it)."""
        shared = ["package_id", "file", "line", "col", "enclosing_symbol_id", "is_external"]
        refs = self.ref_occurrences
        own = refs.select("symbol_id", F.col("symbol_id").alias("member_symbol_id"), *shared)
        lifted = refs.join(self.symbol_ancestors, "symbol_id").select(F.col("ancestor_id").alias("symbol_id"), F.col("symbol_id").alias("member_symbol_id"), *shared)
        return own.unionByName(lifted)

    # --- references ---------------------------------------------------------------------

    @cached_property
    def test_support_symbols(self) -> DataFrame:
        name = globs.name_regex(globs.TEST_SUPPORT_NAMES)
        s = self.t["symbols"].select("symbol_id", "package_id", "file")
        p = self.t["packages"].select("package_id", F.col("name").alias("package_name"), package_base(F.col("path")).alias("base"))
        entry = self.t["symbol_exports"].select("symbol_id", "entry_file").distinct()
        first = stem(basename(F.col("entry_file")))
        called = F.when(first == "index", basename(dirname(F.col("entry_file")))).otherwise(first)
        by_entry = entry.where(called.rlike(name)).select("symbol_id")
        placed = s.join(p, "package_id").where(F.col("file").startswith(F.col("base")))
        by_dir = placed.where(after(F.col("file"), F.col("base")).rlike(globs.name_regex(globs.TEST_SUPPORT_DIRS))).select("symbol_id")
        slash = F.instr("package_name", F.lit("/"))
        local = F.when(slash > 0, F.col("package_name").substr(slash + 1, F.length("package_name"))).otherwise(F.col("package_name"))
        by_package = s.join(p.where(local.rlike(name)), "package_id").select("symbol_id")
        dart = self.surface_files.where(basename(F.col("file")).rlike(globs.name_regex(globs.TEST_SUPPORT_NAMES, ".dart")))
        by_file = semi(s, dart, ["package_id", "file"]).select("symbol_id")
        return by_entry.unionByName(by_dir).unionByName(by_package).unionByName(by_file).distinct()

    @cached_property
    def reexporting_packages(self) -> DataFrame:
        s = self.t["symbols"].select("symbol_id", F.col("package_id").alias("own"))
        p = self.t["packages"].select("package_id", "repo")
        x = self.t["symbol_exports"].select("symbol_id", F.col("entry_file").alias("file")).join(s, "symbol_id")
        x = x.join(p.select(F.col("package_id").alias("own"), F.col("repo").alias("own_repo")), "own")
        d = self.t["documents"].select(F.col("package_id").alias("exporter_package_id"), "file").join(p.select(F.col("package_id").alias("exporter_package_id"), "repo"), "exporter_package_id")
        return x.join(d, "file").where("exporter_package_id <> own and repo = own_repo").select("symbol_id", "exporter_package_id").distinct()

    @cached_property
    def external_ref_occurrences(self) -> DataFrame:
        key = ["package_id", "file"]
        refs = self.owner_ref_occurrences.where("is_external")
        refs = marked(marked(refs, self.test_files, key, "in_test"), self.doc_files, key, "in_docs")
        s = self.t["symbols"].select("symbol_id", F.col("package_id").alias("own"))
        p = self.t["packages"].select("package_id", "repo")
        refs = refs.join(s, "symbol_id", "left").join(p.select(F.col("package_id").alias("own"), F.col("repo").alias("own_repo")), "own", "left")
        promoted = semi(p, self.t["promoted_packages"], "package_id").withColumnRenamed("repo", "promoted_repo")
        refs = refs.join(promoted, "package_id", "left").withColumn("in_docs", F.col("in_docs") | F.coalesce(F.col("promoted_repo") == F.col("own_repo"), F.lit(False)))
        dev = self.t["package_deps"].where("dev and resolved_package_id is not null").select(F.col("resolved_package_id").alias("own"), F.col("consumer_package_id").alias("package_id"))
        refs = marked(refs, dev, ["own", "package_id"], "dev_direct")
        through = self.reexporting_packages.join(dev.withColumnRenamed("own", "exporter_package_id"), "exporter_package_id")
        refs = marked(refs, through, ["symbol_id", "package_id"], "dev_through")
        refs = marked(refs, self.test_support_symbols, ["symbol_id"], "test_support")
        return materialize(
            refs.select(
                "symbol_id", "member_symbol_id", F.col("package_id").alias("consumer_package_id"), "file", "line", "col", "in_test", "in_docs",
                (F.col("dev_direct") | F.col("dev_through")).alias("dev_dep"), "test_support",
            )
        )

    @cached_property
    def overlay_refs(self) -> DataFrame:
        overlay = self.t["edges"].where("source = 'overlay'").withColumn("is_external", F.col("from_package_id") != F.col("to_package_id"))
        own = overlay.select(F.col("to_symbol_id").alias("symbol_id"), "from_package_id", "is_external")
        lifted = own.join(self.symbol_ancestors, "symbol_id").select(F.col("ancestor_id").alias("symbol_id"), "from_package_id", "is_external")
        return own.unionByName(lifted)

    def _counted(self, tests: Column | bool = False) -> Column:
        """Does a reference count? Tests by policy or ``tests``, documentation by policy."""
        keep_test = ~F.col("in_test") | F.lit(self.policy.count_tests)
        if tests is not False:
            keep_test = keep_test | tests
        return keep_test & (~F.col("in_docs") | F.lit(self.policy.count_docs))

    @cached_property
    def external_refs(self) -> DataFrame:
        refs = self.external_ref_occurrences.where(self._counted(F.col("dev_dep") | F.col("test_support"))).select("symbol_id", "consumer_package_id")
        overlay = self.overlay_refs.where("is_external").select("symbol_id", F.col("from_package_id").alias("consumer_package_id"))
        return refs.unionByName(overlay).groupBy("symbol_id", "consumer_package_id").agg(F.count("*").alias("n"))

    @cached_property
    def internal_ref_occurrences(self) -> DataFrame:
        """References within the package, not from inside the symbol itself."""
        refs = self.owner_ref_occurrences.where(~F.col("is_external") & ~F.col("enclosing_symbol_id").eqNullSafe(F.col("symbol_id")))
        inside = self.symbol_ancestors.select(F.col("symbol_id").alias("enclosing_symbol_id"), F.col("ancestor_id").alias("symbol_id"))
        refs = anti(refs, inside, ["enclosing_symbol_id", "symbol_id"])
        key = ["package_id", "file"]
        refs = marked(marked(refs, self.test_files, key, "in_test"), self.doc_files, key, "in_docs")
        return materialize(refs.select("symbol_id", "member_symbol_id", "package_id", "file", "line", "col", "in_test", "in_docs"))

    @cached_property
    def internal_refs(self) -> DataFrame:
        refs = self.internal_ref_occurrences.where(self._counted()).select("symbol_id")
        overlay = self.overlay_refs.where("not is_external").select("symbol_id")
        return refs.unionByName(overlay).groupBy("symbol_id").agg(F.count("*").alias("n"))

    def _only(self, column: str, counted: bool, external: Column) -> DataFrame:
        if counted:
            return self.internal_refs.select("symbol_id").limit(0)
        outside = self.external_ref_occurrences.where(F.col(column) & external).select("symbol_id")
        within = self.internal_ref_occurrences.where(F.col(column)).select("symbol_id")
        return anti(outside.unionByName(within).distinct(), self.external_refs, "symbol_id")

    @cached_property
    def test_only_refs(self) -> DataFrame:
        return self._only("in_test", self.policy.count_tests, ~F.col("dev_dep") & ~F.col("test_support"))

    @cached_property
    def docs_only_refs(self) -> DataFrame:
        return self._only("in_docs", self.policy.count_docs, F.lit(True))

    # --- base verdicts ------------------------------------------------------------------

    @cached_property
    def symbol_age_ok(self) -> DataFrame:
        """Old enough. An unknown age passes only where the repository's history is not complete."""
        days, now = self.policy.min_age_days, self.policy.now
        s = self.t["symbols"].select("symbol_id", "package_id", "first_seen_at")
        if days == 0:
            return s.select("symbol_id")
        if days is None:
            return s.select("symbol_id").limit(0)
        full = self.t["packages"].join(self.t["repo_history"].where("history = 'full'"), "repo")
        known = marked(s, full, ["package_id"], "full")
        ok = F.col("first_seen_at").isNull() & ~F.col("full")
        if now is not None:
            ok = ok | F.coalesce(F.col("first_seen_at") <= F.lit(now - days * DAY), F.lit(False))
        return known.where(ok).select("symbol_id")

    @cached_property
    def kept_symbols(self) -> DataFrame:
        found = self.t["symbols"].join(self.t["keep_rules"], "package_id")
        return found.where((F.col("symbol_name") == "*") | (F.col("symbol_name") == F.col("name"))).select("symbol_id").distinct()

    @cached_property
    def runtime_entry_defaults(self) -> DataFrame:
        """Default exports of programs that nobody depends on."""
        x = self.t["symbol_exports"].where("exported_as = 'default'").select("symbol_id").distinct()
        s = x.join(self.t["symbols"].select("symbol_id", "package_id"), "symbol_id")
        s = semi(s, self.t["packages"].where("not is_library"), "package_id")
        used = self.t["package_deps"].where("resolved_package_id is not null").select(F.col("resolved_package_id").alias("package_id"))
        return anti(s, used, "package_id").select("symbol_id")

    @cached_property
    def base_verdicts(self) -> DataFrame:
        s = self.t["symbols"].where("is_exported").select("symbol_id", "package_id", "file")
        s = semi(s, self.symbol_age_ok, "symbol_id")
        for spared in (self.external_refs, self.kept_symbols, self.runtime_entry_defaults, self.t["entry_symbols"]):
            s = anti(s, spared.select("symbol_id"), "symbol_id")
        for files in (self.generated_files, self.script_files):
            s = anti(s, files, ["package_id", "file"])
        for relation, name in ((self.internal_refs, "internal"), (self.test_only_refs, "tests"), (self.docs_only_refs, "docs")):
            s = marked(s, relation, ["symbol_id"], name)
        s = marked(s, self.private_packages, ["package_id"], "private")
        blockers = self.verdict_blockers.select("package_id", F.concat_ws(":", "blocker_package_id", "flag").alias("b"))
        blockers = blockers.groupBy("package_id").agg(F.sort_array(F.collect_set("b")).alias("blocked_by"))
        s = s.join(blockers, "package_id", "left")
        calm = F.when(F.col("internal") & F.col("private"), "unexport_candidate").when(F.col("internal"), "deprecation_candidate").otherwise("needs_review")
        none = ~F.col("internal") & ~F.col("tests") & ~F.col("docs")
        blocked = F.col("blocked_by").isNotNull()
        reasons = F.array_compact(
            F.array(
                F.when(F.col("internal"), F.lit("internal_refs_only")),
                F.when(F.col("tests"), F.lit("only_test_refs")),
                F.when(F.col("docs"), F.lit("only_docs_refs")),
                F.when(none, F.lit("no_refs")),
                F.when(~blocked & ~F.col("internal"), F.lit("witness_pending")),
            )
        )
        empty = F.array().cast("array<string>")
        out = s.select("symbol_id", F.when(blocked, "blocked").otherwise(calm).alias("verdict"), reasons.alias("reasons"), F.coalesce("blocked_by", empty).alias("blocked_by"))
        return materialize(out)

    # --- reachability -------------------------------------------------------------------

    @cached_property
    def reach_edges(self) -> DataFrame:
        inner = self.t["edges"].where("from_package_id = to_package_id").select("from_symbol_id", "to_symbol_id")
        down = self.symbol_owners.select(F.col("owner_id").alias("from_symbol_id"), F.col("symbol_id").alias("to_symbol_id"))
        up = self.symbol_owners.select(F.col("symbol_id").alias("from_symbol_id"), F.col("owner_id").alias("to_symbol_id"))
        d = self.t["documents"].where("module_symbol_id is not null").select("package_id", "file", "module_symbol_id")
        module = self.t["symbols"].join(d, ["package_id", "file"]).where("symbol_id <> module_symbol_id")
        module = module.select(F.col("symbol_id").alias("from_symbol_id"), F.col("module_symbol_id").alias("to_symbol_id"))
        return materialize(inner.unionByName(down).unionByName(up).unionByName(module).distinct())

    @cached_property
    def reach_seeds_before(self) -> DataFrame:
        s, d = self.t["symbols"], self.t["documents"]
        key = ["package_id", "file"]
        parts = [
            s.where("is_exported").select("symbol_id"),
            self.t["entry_symbols"].select("symbol_id"),
            ids(d.where("is_entry"), "module_symbol_id"),
            ids(semi(d, self.script_files, key), "module_symbol_id"),
            ids(self.t["edges"].where("source = 'overlay'"), "from_symbol_id"),
        ]
        if self.policy.count_tests:
            parts.append(semi(s, self.test_files, key).select("symbol_id"))
        if self.policy.count_docs:
            parts.append(semi(s, self.doc_files, key).select("symbol_id"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.distinct()

    @cached_property
    def _package_edges(self) -> tuple[DataFrame, DataFrame | None]:
        """Edges by package (pkg, src, dst), and the packages that are too wide for one task."""
        of = self.t["symbols"].select(F.col("symbol_id").alias("from_symbol_id"), F.col("package_id").alias("pkg"))
        edges = materialize(self.reach_edges.join(of, "from_symbol_id").select("pkg", F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst")))
        return edges, wide_packages(edges)

    def _reach(self, seeds: DataFrame) -> DataFrame:
        """Edges never leave a package, so the closure is one shuffle by package."""
        edges, wide = self._package_edges
        start = seeds.join(self.t["symbols"].select("symbol_id", F.col("package_id").alias("pkg")), "symbol_id").select("pkg", F.col("symbol_id").alias("node"))
        return materialize(reach_by_package(edges, start, wide).select(F.col("node").alias("symbol_id")))

    @cached_property
    def reachable(self) -> DataFrame:
        return self._reach(self.reach_seeds_before)

    def candidates(self, findings: DataFrame) -> DataFrame:
        """symbol_id, package_id, name of symbols that may go."""
        going = F.col("verdict").isin(*CANDIDATES) | ((F.col("verdict") == "needs_review") & F.array_contains("reasons", "witness_pending"))
        return semi(self.t["symbols"], findings.where(going), "symbol_id").select("symbol_id", "package_id", "name")

    def reachable_after(self, findings: DataFrame) -> DataFrame:
        return self._reach(anti(self.reach_seeds_before, self.candidates(findings), "symbol_id"))

    @cached_property
    def reachable_after_base(self) -> DataFrame:
        return self.reachable_after(self.base_verdicts)

    # --- signatures and verdicts --------------------------------------------------------

    @cached_property
    def internal_only(self) -> DataFrame:
        return self.base_verdicts.where(F.array_contains("reasons", "internal_refs_only")).select("symbol_id")

    @cached_property
    def signature_refs(self) -> DataFrame:
        """symbol_id, api_symbol_id: symbols named in the signature of an exported declaration."""
        s = self.t["symbols"]
        exported = s.where("is_exported").select("symbol_id")
        own = exported.select(F.col("symbol_id").alias("decl_id"), F.col("symbol_id").alias("api_id"))
        lifted = self.symbol_ancestors.join(exported.withColumnRenamed("symbol_id", "ancestor_id"), "ancestor_id")
        api = own.unionByName(lifted.select(F.col("symbol_id").alias("decl_id"), F.col("ancestor_id").alias("api_id"))).distinct()
        named = s.select("symbol_id", F.col("package_id").alias("p"), F.col("symbol_str").endswith("#").alias("is_type"))
        decl = s.select(
            F.col("symbol_id").alias("decl_id"), F.col("package_id").alias("q"), F.col("name").alias("decl_name"), "kind",
            F.col("file").alias("decl_file"), F.col("line").alias("decl_line"), F.col("col").alias("decl_col"), F.col("symbol_str").endswith("#").alias("decl_type"),
        )
        npm = self.t["packages"].select(F.col("package_id").alias("p"), (F.col("manager") == "npm").alias("is_npm"))
        refs = semi(self.ref_occurrences.where("not is_external"), self.internal_only, "symbol_id")
        refs = refs.select("symbol_id", "file", "line", "col", "role", F.col("enclosing_symbol_id").alias("decl_id")).where("decl_id <> symbol_id")
        refs = refs.join(named, "symbol_id").join(decl, "decl_id").where("p = q").join(npm, "p", "left")
        inside = self.symbol_ancestors.select(F.col("symbol_id").alias("decl_id"), F.col("ancestor_id").alias("symbol_id"))
        refs = anti(refs, inside, ["decl_id", "symbol_id"])
        on_line = (F.col("file") == F.col("decl_file")) & (F.col("line") == F.col("decl_line"))
        before = F.col("kind").isin(*VALUE_KINDS) | (F.col("col") < F.col("decl_col")) | (F.col("is_type") & F.col("is_npm"))
        shown = F.col("kind").isin(*TYPE_KINDS) | F.col("decl_type") | (F.col("role").bitwiseAND(SIGNATURE) != 0) | (on_line & before)
        public = ~F.substring("decl_name", 1, 1).isin("_", "#")
        found = refs.where(shown & public).join(api, "decl_id").where("api_id <> symbol_id")
        return materialize(found.select("symbol_id", F.col("api_id").alias("api_symbol_id")).distinct())

    @cached_property
    def signature_pinned(self) -> DataFrame:
        refs = self.signature_refs
        public = anti(refs, self.internal_only.withColumnRenamed("symbol_id", "api_symbol_id"), "api_symbol_id").select("symbol_id")
        thrown = self.t["occurrences"].where((F.col("role").bitwiseAND(DEFINITION) != 0) & (F.col("role").bitwiseAND(ERROR_CLASS) != 0))
        seed = public.unionByName(semi(self.internal_only, thrown.select("symbol_id"), "symbol_id"))
        step = lambda front: front.select(F.col("symbol_id").alias("api_symbol_id")).join(refs, "api_symbol_id")
        return materialize(fixpoint(seed.distinct(), step))

    @cached_property
    def unexport_dropped(self) -> DataFrame:
        home = self.internal_only.join(self.t["symbols"].select("symbol_id", "package_id"), "symbol_id")
        return self.signature_pinned.unionByName(semi(home, self.unexport_exempt_packages, "package_id").select("symbol_id")).distinct()

    @cached_property
    def verdicts(self) -> DataFrame:
        v = marked(self.base_verdicts, self.reachable_after_base, ["symbol_id"], "alive")
        v = marked(v, self.unexport_dropped, ["symbol_id"], "dropped")
        v = v.where(~(F.col("dropped") & (F.col("alive") | (F.col("verdict") == "blocked"))))
        island = F.col("verdict").isin("unexport_candidate", "deprecation_candidate") & ~F.col("alive")
        grown = F.concat("reasons", F.array(F.lit("dead_island"), F.lit("witness_pending")))
        return materialize(v.select("symbol_id", F.when(island, "needs_review").otherwise(F.col("verdict")).alias("verdict"), F.when(island, grown).otherwise(F.col("reasons")).alias("reasons"), "blocked_by"))

    def reconcile_islands(self, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``findings`` (without the privately dead) after islands that are reachable again lost the mark, and what is reachable then.

        They turn into what their package allows, or go when dropped.
        """
        place = self.t["symbols"].select("symbol_id", "package_id")
        for _ in range(ISLAND_PASSES):
            alive = self.reachable_after(findings)
            f = marked(findings, alive, ["symbol_id"], "alive")
            kinds = F.col("verdict").isin("deletion_candidate", "deprecation_candidate", "needs_review")
            f, counts = materialize_counted(f.withColumn("island", kinds & F.array_contains("reasons", "dead_island") & F.col("alive")), islands=F.col("island"))
            if not counts["islands"]:
                return findings, alive
            f = marked(f.join(place, "symbol_id"), self.private_packages, ["package_id"], "private")
            f = marked(f, self.unexport_dropped, ["symbol_id"], "dropped")
            going = (F.col("verdict") != "needs_review") | F.array_contains("reasons", "witness_pending")
            f = f.where(~(F.col("island") & going & F.col("dropped")))
            verdict = F.when(F.col("island") & going, F.when(F.col("private"), "unexport_candidate").otherwise("deprecation_candidate")).otherwise(F.col("verdict"))
            cleaned = F.when(going, F.array_except("reasons", F.array(F.lit("dead_island"), F.lit("witness_pending")))).otherwise(F.array_except("reasons", F.array(F.lit("dead_island"))))
            findings = materialize(f.select("symbol_id", verdict.alias("verdict"), F.when(F.col("island"), cleaned).otherwise(F.col("reasons")).alias("reasons"), "blocked_by"))
        return findings, self.reachable_after(findings)

    # --- privately dead -----------------------------------------------------------------

    @cached_property
    def private_dead_scope(self) -> DataFrame:
        s = self.t["symbols"].where(~F.col("is_exported") & ~F.col("kind").eqNullSafe("anonymous-member") & ~F.col("kind").eqNullSafe("import-prefix"))
        for spared in (self.module_symbols, self.t["entry_symbols"].select("symbol_id"), self.kept_symbols):
            s = anti(s, spared, "symbol_id")
        for files in (self.test_files, self.generated_files, self.doc_files, self.script_files):
            s = anti(s, files, ["package_id", "file"])
        for packages in (self.opaque_packages, self.verdict_blockers.select("package_id")):
            s = anti(s, packages, "package_id")
        return s.select("symbol_id", "package_id")

    @cached_property
    def private_dead_packages(self) -> DataFrame:
        s, loads = self.t["symbols"], self.t["unindexed_loads"]
        entry = self.t["entry_symbols"].where("kind = 'runtime'").select("symbol_id").join(s.select("symbol_id", "package_id", "file"), "symbol_id")
        own = anti(entry, loads.where("resolved").select("package_id", F.col("module").alias("file")), ["package_id", "file"])
        known = s.where("is_exported").select("package_id").unionByName(self.t["documents"].where("is_entry").select("package_id")).unionByName(own.select("package_id"))
        return anti(known.distinct(), loads.where("not resolved").select("package_id"), "package_id")

    @cached_property
    def private_dead_eligible(self) -> DataFrame:
        return semi(self.private_dead_scope, self.private_dead_packages, "package_id").select("symbol_id")

    @cached_property
    def unreachable_before(self) -> DataFrame:
        return anti(self.private_dead_eligible, self.reachable, "symbol_id")

    @cached_property
    def private_dead_skipped(self) -> DataFrame:
        n = anti(anti(self.private_dead_scope, self.private_dead_packages, "package_id"), self.reachable, "symbol_id").groupBy("package_id").agg(F.count("*").alias("symbols"))
        gaps = self.t["unindexed_loads"].where("not resolved").groupBy("package_id").agg(F.count("*").alias("gaps"), F.min(F.struct("file", "module")).alias("first"))
        more = F.when(F.col("gaps") > 1, F.concat(F.lit(" (+"), F.col("gaps") - 1, F.lit(" more)"))).otherwise("")
        text = F.concat(F.lit("unresolved load: "), F.col("first.module"), F.lit(" in "), F.col("first.file"), more)
        out = n.join(gaps, "package_id", "left")
        return out.select("package_id", F.when(F.col("gaps").isNull(), "no known entry points").otherwise(text).alias("reason"), "symbols")

    def candidate_reach(self, findings: DataFrame, alive: DataFrame) -> DataFrame:
        """origin_id, symbol_id: what each candidate reaches among symbols that die with the candidates."""
        edges = self.reach_edges.select(F.col("from_symbol_id").alias("symbol_id"), F.col("to_symbol_id").alias("next"))
        edges = anti(edges, alive.select(F.col("symbol_id").alias("next")), "next")
        seed = self.candidates(findings).select(F.col("symbol_id").alias("origin_id"), "symbol_id")
        return fixpoint(seed, lambda front: front.join(edges, "symbol_id").select("origin_id", F.col("next").alias("symbol_id")))

    def private_dead_unlocked(self, findings: DataFrame, alive: DataFrame) -> DataFrame:
        names = self.candidates(findings).select(F.col("symbol_id").alias("origin_id"), "name")
        found = semi(semi(self.candidate_reach(findings, alive), self.private_dead_eligible, "symbol_id"), self.reachable, "symbol_id")
        found = anti(found, alive, "symbol_id").join(names, "origin_id").select("symbol_id", F.concat(F.lit("unlocked_by:"), "name").alias("reason"))
        return found.groupBy("symbol_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))

    def private_dead(self, findings: DataFrame, alive: DataFrame) -> DataFrame:
        """Unexported declarations that nothing ``alive`` (see ``reconcile_islands``) reaches, outermost ones only."""
        before = self.unreachable_before.select("symbol_id", F.array(F.lit("already_unreachable")).alias("reasons"))
        dead = materialize(before.unionByName(self.private_dead_unlocked(findings, alive)))
        gone = dead.select("symbol_id").unionByName(self.candidates(findings).select("symbol_id")).distinct().withColumnRenamed("symbol_id", "ancestor_id")
        inner = semi(self.symbol_ancestors, gone, "ancestor_id").select("symbol_id")
        empty = F.array().cast("array<string>")
        return anti(dead, inner, "symbol_id").select("symbol_id", F.lit("private_dead").alias("verdict"), "reasons", empty.alias("blocked_by"))

    @cached_property
    def findings(self) -> DataFrame:
        """The whole analysis: verdicts, reconciled, with the privately dead."""
        settled, alive = self.reconcile_islands(self.verdicts)
        return materialize(settled.unionByName(self.private_dead(settled, alive)))

    # --- unresolved references ----------------------------------------------------------

    @cached_property
    def unresolved_ref_classes(self) -> DataFrame:
        """Why a reference names nothing at the target's head; the first class that fits."""
        refs = self.t["unresolved_refs"].withColumn("dkey", descriptor_key(F.col("symbol_str")))
        s = semi(self.t["symbols"], refs.select(F.col("target_package_id").alias("package_id")), "package_id")
        head = s.select("symbol_id", F.col("package_id").alias("target_package_id"), descriptor_key(F.col("symbol_str")).alias("dkey"))
        keys = refs.select("target_package_id", "dkey").distinct()
        same = semi(keys.where("dkey <> ''"), head, ["target_package_id", "dkey"])
        cut = F.instr("dkey", F.lit("#"))
        members = keys.where((cut > 1) & (cut < F.length("dkey"))).withColumn("owner_key", F.col("dkey").substr(F.lit(1), cut))
        owners = members.join(head.withColumnRenamed("dkey", "owner_key"), ["target_package_id", "owner_key"]).select("target_package_id", "dkey", F.col("symbol_id").alias("type_id"))
        types = self.t["symbols"].where(F.col("parent_symbol_id").isNull() & F.col("symbol_str").endswith("#")).select(F.col("symbol_id").alias("next"))
        # only uses of types can lead up, so the others are not told apart
        up = semi(self.t["edges"].select(F.col("from_symbol_id").alias("type_id"), F.col("to_symbol_id").alias("next")), types, "next").distinct()
        supertypes = fixpoint(owners.distinct(), lambda f: f.join(up, "type_id").select("target_package_id", "dkey", F.col("next").alias("type_id")))
        mkey = descriptor_key(F.col("symbol_str"))
        tail = lambda k: k.substr(F.instr(k, F.lit("#")) + 1, F.length(k))
        held = self.t["symbols"].where("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("type_id"), tail(mkey).alias("member")).distinct()
        inherited = supertypes.withColumn("member", tail(F.col("dkey"))).join(held, ["type_id", "member"]).select("target_package_id", "dkey")
        moved = same.unionByName(inherited).distinct()
        p = self.t["packages"]
        consumer = p.select(F.col("package_id").alias("consumer_package_id"), F.col("repo").alias("consumer_repo"))
        target = p.select(F.col("package_id").alias("target_package_id"), F.col("repo").alias("target_repo"), F.col("version").alias("head"))
        pinned = self.t["package_deps"].where("resolved_package_id is not null").select("consumer_package_id", F.col("resolved_package_id").alias("target_package_id"), F.col("dep_constraint").alias("c")).join(target, "target_package_id")
        exact = F.col("c").rlike(r"^[0-9][0-9A-Za-z.+-]*$") & (F.col("c") != F.col("head"))
        caret = F.col("c").rlike(r"^[~^][0-9][0-9A-Za-z.+-]*$") & (F.substring_index(F.expr("substr(c, 2)"), ".", 1) != F.substring_index("head", ".", 1))
        other = pinned.where(F.col("head").isNotNull() & (exact | caret))
        out = refs.join(consumer, "consumer_package_id").join(target, "target_package_id")
        out = marked(out, other, ["consumer_package_id", "target_package_id"], "other_version")
        out = marked(out, self.opaque_packages.withColumnRenamed("package_id", "target_package_id"), ["target_package_id"], "opaque")
        out = marked(out, self.t["symbols"].where("is_exported").select(F.col("package_id").alias("target_package_id")), ["target_package_id"], "has_exports")
        out = marked(out, moved, ["target_package_id", "dkey"], "moved")
        unindexed = (F.col("symbol_str") == "*") | F.col("symbol_str").rlike(r"(?s)^.* .*\.json`/.*$")
        found = (
            F.when((F.col("consumer_repo") == F.col("target_repo")) & ~F.col("other_version"), "same_repo")
            .when(F.col("opaque") | ~F.col("has_exports"), "opaque_target")
            .when(unindexed, "unindexed_module")
            .when(F.col("moved"), "moved_at_head")
            .otherwise("version_skew")
        )
        return materialize(out.select("consumer_package_id", "target_package_id", "symbol_str", "file", "line", "col", found.alias("class")))
