"""From decoded indexes to relations: positions, owners, interning and references."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refloom.functions import globs
from refloom.functions.heads import heads_udf
from refloom.functions.scip import KIND_NAMES, NAMESPACE_KIND, normalize_version_udf, symbol_parts_udf
from refloom.functions.text import normalized_path
from refloom.operators.analysis import DEFINITION, ERROR_CLASS, SIGNATURE, anti, marked
from refloom.operators.unseen import USE, UnseenUses
from refloom.storage import materialize, refuse_clashes


def position(span: Column, name: str) -> Column:
    """Start and end of a range of three (one line) or four numbers."""
    one = F.size(span) == 3
    return F.when(
        span.isNotNull() & (F.size(span) >= 3),
        F.struct(span[0].alias("line"), span[1].alias("col"), F.when(one, span[0]).otherwise(span[2]).alias("end_line"), F.when(one, span[2]).otherwise(F.get(span, F.lit(3))).alias("end_col")),
    ).alias(name)


def index_occurrences(index: DataFrame) -> DataFrame:
    """package_id, file, symbol (version taken out), role, at and body of every occurrence."""
    d = index.select("package_id", F.explode("documents").alias("d"))
    o = d.select("package_id", F.col("d.relativePath").alias("file"), F.explode("d.occurrences").alias("o"))
    return o.select("package_id", "file", normalize_version_udf(F.col("o.symbol")).alias("symbol"), F.col("o.symbolRoles").alias("role"), position(F.col("o.range"), "at"), position(F.col("o.enclosingRange"), "body"))


def owning_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """repo, manager, file with the package that owns it: the longest path prefix, the index's own manager first.

    A file's ancestor folders become rows and meet package paths in an equi join, so no
    prefix is compared with every package.
    """
    parts = F.split("file", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    f = files.withColumn("folder", F.explode(folders))
    p = packages.select("repo", F.when(F.col("path") == ".", "").otherwise(F.col("path")).alias("folder"), F.col("manager").alias("owner_manager"), F.col("package_id").alias("owner_id"))
    best = F.max_by("owner_id", F.struct((F.col("owner_manager") == F.col("manager")).cast("int"), F.length("folder"), "owner_id"))
    return f.join(p, ["repo", "folder"]).groupBy("repo", "manager", "file").agg(best.alias("package_id"))


def chosen_documents(documents: DataFrame) -> DataFrame:
    """One document a (owner_id, file): the owner's own index, else the longest index path, else the first."""
    rank = F.row_number().over(Window.partitionBy("owner_id", "file").orderBy(F.desc((F.col("index_package_id") == F.col("owner_id")).cast("int")), F.desc(F.length("index_path")), "load_order"))
    return documents.withColumn("rank", rank).where("rank = 1").drop("rank")


def interned(definitions: DataFrame) -> DataFrame:
    """First definition of each (package_id, symbol): own-package rounds first, then load order."""
    first = F.min_by(F.struct(*[F.col(c) for c in definitions.columns if c not in ("package_id", "symbol")]), F.struct("round", "load_order"))
    return definitions.groupBy("package_id", "symbol").agg(first.alias("d")).select("package_id", "symbol", "d.*")


def nearest_defined(unresolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nearest defined ancestor of each unresolved symbol (ref_id, package_id, prefixes): its longest defined prefix."""
    p = unresolved.select("ref_id", "package_id", F.explode("prefixes").alias("symbol"))
    met = p.join(symbols.select("package_id", "symbol", "symbol_id"), ["package_id", "symbol"])
    return met.groupBy("ref_id").agg(F.max_by("symbol_id", F.length("symbol")).alias("ancestor_id"))


def exports_at(exports: DataFrame, definitions: DataFrame) -> DataFrame:
    """Sidecar exports matched to definitions by (package_id, file, line, col)."""
    return exports.join(definitions.select("package_id", "file", "line", "col", "symbol_id"), ["package_id", "file", "line", "col"])


def reference_edges(occurrences: DataFrame) -> DataFrame:
    """Distinct edges from what encloses a reference to what it names."""
    r = occurrences.where((F.col("role").bitwiseAND(DEFINITION) == 0) & ~F.col("is_export_site") & F.col("enclosing_symbol_id").isNotNull())
    return r.select(F.col("enclosing_symbol_id").alias("from_symbol_id"), F.col("symbol_id").alias("to_symbol_id"), F.lit("scip").alias("source"), F.col("package_id").alias("from_package_id"), F.col("def_package_id").alias("to_package_id")).distinct()


def status_reason(diagnostics: Column) -> Column:
    """First line of what explains a status: the last named cause, else the first error, else the first warning, else the first of all."""
    first = lambda mark: F.get(F.filter(diagnostics, lambda d: d.startswith(mark)), F.lit(0))
    causes = F.filter(diagnostics, lambda d: d.startswith("cause: "))
    cause = F.get(causes, F.size(causes) - 1)
    said = F.coalesce(cause.substr(F.lit(len("cause: ") + 1), F.length(cause)), first("error:"), first("warn:"), F.get(diagnostics, F.lit(0)))
    line = F.substring_index(said, "\n", 1)
    return F.when(line != "", line)


def status_flags(manifest: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Flags from index status: partial cannot be seen into, failed or missing failed, no sidecar cannot be seen into."""
    bad = manifest.where("status is null or status <> 'ok'")
    flag = F.when(F.col("status") == "partial", "opaque_consumer").otherwise("index_failed")
    plain = F.when(F.col("status").isNull(), "package missing from index.json").when(F.col("status") == "partial", "index partial").otherwise("index failed")
    a = bad.select("package_id", flag.alias("flag"), F.coalesce(status_reason(F.col("diagnostics")), plain).alias("reason"))
    b = anti(manifest.where("status in ('ok', 'partial')"), sidecars.select(F.col("packageId").alias("package_id")), "package_id").select("package_id", F.lit("opaque_consumer").alias("flag"), F.lit("no exports sidecar").alias("reason"))
    none = F.lit(None).cast("string")
    return a.unionByName(b).distinct().withColumns({"file": none, "target_package_id": none})


def symbol_ages(symbols: DataFrame, blame: DataFrame) -> DataFrame:
    """``symbols`` with first_seen_at from blame rows (repo, file, line, sha, author_time)."""
    b = blame.select("repo", "file", "line", F.col("author_time").alias("first_seen_at"), F.col("sha").alias("first_seen_sha"))
    return symbols.drop("first_seen_at", "first_seen_sha").join(b, ["repo", "file", "line"], "left")


# --- from indexes to relations ------------------------------------------------------------------

_UNNAMED = "_unnamed/"
#: What tells a document of an index.
_DOCUMENT = ["index_package_id", "load_order", "doc_pos"]
#: Symbols of which no declaration comes: only enclosing ones are kept.
_INNER = ("parameter", "type_parameter")


class Ingest(UnseenUses):
    """Relations of an organisation from decoded indexes and export surfaces.

    ``packages`` (package_id, repo, path, manager, name, entry_points; runtime_entry_points and
    runtime_entry_symbols where known), ``package_deps``, ``index`` (package_id, load_order,
    documents: see ``sources.readers.INDEX``), ``sidecars`` (see ``SIDECAR``), ``manifest``
    (package_id, status, diagnostics), ``files`` (repo, path, text: the checkouts, from which
    signatures and error classes are read; without them none is marked), ``extra_edges``
    (repo, from, to: uses that a repository's configuration declares) and ``surfaces`` (fields of
    sidecars that lie in tables of their own, by name: packageId and the field). Every relation is a plan
    over these; what several read is written once. Symbols get the hash of their key as id, so
    loads of parts of an organisation agree; two keys of one hash are an error.
    """

    def __init__(
        self, packages: DataFrame, package_deps: DataFrame, index: DataFrame, sidecars: DataFrame, manifest: DataFrame,
        files: DataFrame | None = None, extra_edges: DataFrame | None = None, surfaces: Mapping[str, DataFrame] | None = None,
    ):
        root = F.when(F.col("path").isin(".", "./"), "").otherwise(F.regexp_replace("path", "/$", ""))
        self.packages = packages.withColumn("path", root)
        for name in ("runtime_entry_points", "runtime_entry_symbols"):
            if name not in packages.columns:
                self.packages = self.packages.withColumn(name, F.array().cast("array<string>"))
        self.deps, self.index, self.manifest, self.files, self.extra_edges = package_deps, index, manifest, files, extra_edges
        self.apart = surfaces or {}
        self.sidecars = self._counted(sidecars)

    def _counted(self, sidecars: DataFrame) -> DataFrame:
        """Sidecars whose index is not given up, with their package's repo."""
        failed = self.invalid_indexes.select("package_id")
        return anti(sidecars.withColumnRenamed("packageId", "package_id"), failed, "package_id").join(self.packages.select("package_id", "repo"), "package_id")

    def _surfaces(self, field: str) -> DataFrame:
        """package_id, repo and a sidecar's ``field``, from its own table where there is one."""
        return self._counted(self.apart[field]) if field in self.apart else self.sidecars

    # --- documents and their occurrences

    @cached_property
    def _symbols_met(self) -> DataFrame:
        """sid (hash of the symbol as written), symbol and its parts p, each distinct symbol once: a document names few symbols many times."""
        met = self.index.select(F.explode("documents").alias("d")).select(F.explode("d.occurrences.symbol").alias("symbol")).distinct()
        out = materialize(met.select(F.xxhash64("symbol").alias("sid"), "symbol", symbol_parts_udf("symbol").alias("p")))
        refuse_clashes(out, "sid", "symbol")
        return out

    @cached_property
    def _read(self) -> DataFrame:
        """Every occurrence: index_package_id, load_order, doc_pos, occ_pos, sid, role, at, body. A plan, as reading again costs less than another copy."""
        d = self.index.select(F.col("package_id").alias("index_package_id"), "load_order", F.posexplode("documents").alias("doc_pos", "d"))
        # an occurrence leaves its document alone: a row never carries a document's arrays
        o = d.select(*_DOCUMENT, F.posexplode("d.occurrences").alias("occ_pos", "o"))
        return o.select(*_DOCUMENT, "occ_pos", F.xxhash64("o.symbol").alias("sid"), F.col("o.symbolRoles").alias("role"), position(F.col("o.range"), "at"), position(F.col("o.enclosingRange"), "body"))

    @cached_property
    def invalid_indexes(self) -> DataFrame:
        """package_id, reason of indexes that hold a symbol of an organisation package (or of none that can be told) which does not parse."""
        bad = self._read.join(materialize(self._symbols_met.where("not p.valid")), "sid").select(F.col("index_package_id").alias("package_id"), "symbol", F.col("p.manager").alias("manager"), F.col("p.name").alias("name"), F.struct("doc_pos", "occ_pos").alias("place"))
        named = self.packages.select("manager", "name").distinct()
        foreign = anti(bad.where("name is not null"), named, ["manager", "name"])
        own = bad.join(foreign.select("package_id", "symbol").distinct(), ["package_id", "symbol"], "left_anti")
        first = own.groupBy("package_id").agg(F.min_by("symbol", "place").alias("s"), F.countDistinct("symbol").alias("n"))
        more = F.when(F.col("n") > 1, F.concat(F.lit(" (+"), F.col("n") - 1, F.lit(" more)"))).otherwise("")
        return materialize(first.select("package_id", F.concat(F.lit('invalid symbol "'), "s", F.lit('"'), more).alias("reason")))

    @cached_property
    def _owned(self) -> DataFrame:
        """index_package_id, load_order, doc_pos of the chosen document of each (package_id, file), with repo, owner_path and doc_order."""
        d = self.index.select(F.col("package_id").alias("index_package_id"), "load_order", F.posexplode("documents").alias("doc_pos", "d")).select("index_package_id", "load_order", "doc_pos", F.col("d.relativePath").alias("path"))
        d = anti(d, self.invalid_indexes.select(F.col("package_id").alias("index_package_id")), "index_package_id")
        p = self.packages.select(F.col("package_id").alias("index_package_id"), "repo", "manager", F.col("path").alias("index_path"))
        d = d.join(p, "index_package_id").withColumn("file", normalized_path(F.concat_ws("/", "index_path", "path")))
        d = d.where(~F.col("path").startswith("/") & ~F.col("file").rlike(r"^\.\.(/|$)|(^|/)node_modules(/|$)"))
        owner = owning_package(d.select("repo", "manager", "file").distinct(), self.packages)
        d = d.join(owner.withColumnRenamed("package_id", "owner_id"), ["repo", "manager", "file"])
        order = F.struct("load_order", "doc_pos")
        d = d.withColumn("doc_order", F.min(order).over(Window.partitionBy("owner_id", "file"))).withColumn("load_order", order)
        d = chosen_documents(d).join(self.packages.select(F.col("package_id").alias("owner_id"), F.col("path").alias("owner_path")), "owner_id")
        return materialize(d.select("index_package_id", "load_order.doc_pos", F.col("load_order.load_order").alias("load_order"), F.col("owner_id").alias("package_id"), "file", "repo", "owner_path", "doc_order"))

    @cached_property
    def _met(self) -> DataFrame:
        """package_id, repo and sid of the symbols that can name a declaration, once for each package that writes them, with scheme, sym_manager, sym_name, tail and suffix (the last)."""
        sids = F.array_distinct(F.transform("d.occurrences", lambda o: F.xxhash64(o["symbol"])))
        d = self.index.select(F.col("package_id").alias("index_package_id"), "load_order", F.posexplode("documents").alias("doc_pos", "d"))
        met = d.select(*_DOCUMENT, F.explode(sids).alias("sid")).join(self._owned.select(*_DOCUMENT, "package_id", "repo"), _DOCUMENT).select("package_id", "repo", "sid").distinct()
        last = F.element_at("p.suffixes", -1)
        named = self._symbols_met.where("p.valid and p.tail is not null").where(~last.isin(*_INNER))
        parts = named.select("sid", F.col("p.scheme").alias("scheme"), F.col("p.manager").alias("sym_manager"), F.col("p.name").alias("sym_name"), F.col("p.tail").alias("tail"), last.alias("suffix"))
        return materialize(met.join(parts, "sid"))

    @cached_property
    def names(self) -> DataFrame:
        """package_id, sym_manager, sym_name, target_id, shared, candidates: which package another means by a name."""
        return materialize(self._named(self._met.where("sym_name <> ''").select("package_id", "repo", "sym_manager", "sym_name").distinct()))

    def _named(self, asked: DataFrame) -> DataFrame:
        """``asked`` (package_id, repo, sym_manager, sym_name) resolved: the own name, else the only candidate, else what the manifest's dependency of that name is, else ambiguous (target null, candidates given)."""
        own = self.packages.select("package_id", F.col("manager").alias("own_manager"), F.col("name").alias("own_name"))
        known = self.packages.select(F.col("manager").alias("sym_manager"), F.col("name").alias("sym_name"), F.col("package_id").alias("candidate"), F.col("repo").alias("candidate_repo"))
        asked = asked.join(own, "package_id")
        met = asked.join(known, ["sym_manager", "sym_name"])
        near = ~F.col("sym_name").startswith(_UNNAMED) | (F.col("repo") == F.col("candidate_repo"))
        key = ["package_id", "sym_manager", "sym_name"]
        found = met.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(near, F.col("candidate")))).alias("candidates"), F.count("*").alias("n"), F.max((F.col("own_manager") == F.col("sym_manager")) & (F.col("own_name") == F.col("sym_name"))).alias("is_own"))
        dep = self.deps.where("resolved_package_id is not null").groupBy(F.col("consumer_package_id").alias("package_id"), F.col("dep_manager").alias("sym_manager"), F.col("dep_name").alias("sym_name")).agg(F.min("resolved_package_id").alias("dep"))
        found = found.join(dep, key, "left")
        target = F.when(F.col("is_own"), F.col("package_id")).when(F.size("candidates") == 1, F.col("candidates")[0]).when(F.size("candidates") > 1, F.col("dep"))
        ambiguous = ~F.col("is_own") & (F.size("candidates") > 1) & F.col("dep").isNull()
        return found.select(*key, target.alias("target_id"), (F.col("n") > 1).alias("shared"), F.when(ambiguous, F.col("candidates")).alias("candidates"))

    @cached_property
    def _meant(self) -> DataFrame:
        """What a package means by a symbol that it writes: package_id, sid, suffix, sym_name, target_id, candidates, plain (version out), key."""
        own = self.packages.select("package_id", F.col("name").alias("own_name"))
        o = self._met.join(self.names, ["package_id", "sym_manager", "sym_name"], "left").join(own, "package_id")
        esc = lambda c: F.when(c == "", ".").otherwise(F.replace(c, F.lit(" "), F.lit("  ")))
        head = F.concat_ws(" ", esc(F.col("scheme")), esc(F.col("sym_manager")))
        full = lambda name, version: F.concat_ws(" ", head, name, version, F.col("tail"))
        nameless = F.col("sym_name") == ""
        plain = full(esc(F.col("sym_name")), F.lit("."))
        key = F.when(nameless, full(esc(F.col("own_name")), esc(F.col("package_id")))).when(F.col("shared") & F.col("target_id").isNotNull(), full(esc(F.col("sym_name")), esc(F.col("target_id")))).otherwise(plain)
        target = F.when(nameless, F.col("package_id")).otherwise(F.col("target_id"))
        return materialize(o.select("package_id", "sid", "suffix", "sym_name", target.alias("target_id"), "candidates", plain.alias("plain"), key.alias("key")))

    @cached_property
    def _of_documents(self) -> DataFrame:
        """Occurrences of chosen documents: package_id, file, repo, doc_order, index_package_id, load_order, doc_pos, occ_pos, sid, role, at, body."""
        return self._read.where("at is not null").join(self._owned.drop("owner_path"), _DOCUMENT)

    # --- definitions

    @cached_property
    def _definitions(self) -> DataFrame:
        """Definitions that no ambiguous name hides: package_id, file, repo, owner_path, order, role, at, body, kind, p, target_id, key."""
        o = self._read.where("at is not null").where(F.col("role").bitwiseAND(DEFINITION) == 1).join(self._owned, _DOCUMENT)
        o = o.join(self._meant.where("candidates is null").select("package_id", "sid", "target_id", "key"), ["package_id", "sid"])
        d = self.index.select(F.col("package_id").alias("index_package_id"), "load_order", F.posexplode("documents").alias("doc_pos", "d"))
        k = d.select(*_DOCUMENT, F.posexplode("d.symbols").alias("pos", "s")).where("s.symbol is not null")
        # of a symbol listed twice the later kind counts
        k = k.groupBy(*_DOCUMENT, F.xxhash64("s.symbol").alias("sid")).agg(F.max_by("s.kind", "pos").alias("kind"))
        o = o.join(k, [*_DOCUMENT, "sid"], "left").join(self._symbols_met.select("sid", "p"), "sid")
        return materialize(o.select("package_id", "file", "repo", "owner_path", F.struct("doc_order", "occ_pos").alias("order"), "role", "at", "body", "kind", "p", "target_id", "key"))

    @cached_property
    def interned(self) -> DataFrame:
        """symbol_id, symbol_str, package_id, file, line, col, kind, name, is_module and p: one row a key, the first definition's (own packages before others')."""
        d = self._definitions
        later = (F.col("target_id").isNotNull() & (F.col("target_id") != F.col("package_id"))).cast("int")
        first = d.groupBy("key").agg(F.min_by(F.struct("package_id", "file", "owner_path", "at", "kind", "p"), F.struct(later, F.col("order"))).alias("d")).select("key", "d.*")
        path = F.array_join("p.names", "/")
        relative = F.when(F.col("owner_path") == "", F.col("file")).otherwise(F.expr("substr(file, length(owner_path) + 2)"))
        spaces = F.forall("p.suffixes", lambda x: x == "namespace")
        is_module = spaces & (path != "") & ((path == relative) | (path == F.col("file")) | F.endswith(F.col("file"), F.concat(F.lit("/"), path)))
        first = first.withColumn("is_module", is_module)
        prefix = (F.col("p.scheme") == "scip-dart") & ~F.col("is_module") & ((F.coalesce("kind", F.lit(0)) == NAMESPACE_KIND) | (F.element_at("p.suffixes", -1) == "namespace"))
        kinds = F.array(*[F.lit("" if k == "-" else k) for k in KIND_NAMES])
        kind = F.when(F.exists("p.literal", lambda x: x), "anonymous-member").when(prefix, "import-prefix").otherwise(F.coalesce(F.get(kinds, F.coalesce("kind", F.lit(0)) - 1), F.lit("")))
        name = F.when(F.col("is_module"), F.col("file")).otherwise(F.element_at("p.names", -1))
        out = materialize(first.select(F.xxhash64("key").alias("symbol_id"), F.col("key").alias("symbol_str"), "package_id", "file", F.col("at.line").alias("line"), F.col("at.col").alias("col"), kind.alias("kind"), name.alias("name"), "is_module", "p"))
        refuse_clashes(out, "symbol_id", "symbol_str")
        return out

    @cached_property
    def documents(self) -> DataFrame:
        """package_id, file, module_symbol_id, is_entry, is_generated; a file without a module symbol of its own gets one."""
        d = self._owned.select("package_id", "file", "repo", "owner_path").distinct()
        own = self.interned.where("is_module").groupBy("package_id", "file").agg(F.min("symbol_id").alias("module_symbol_id"))
        entries = self.packages.select("package_id", F.explode(F.array_union("entry_points", F.coalesce("runtime_entry_points", F.array().cast("array<string>")))).alias("file")).distinct()
        d = marked(d.join(own, ["package_id", "file"], "left"), entries, ["package_id", "file"], "is_entry")
        listed = self.sidecars.select("repo", F.explode("generatedFiles").alias("file")).distinct()
        d = marked(d, listed, ["repo", "file"], "listed")
        below = F.when(F.col("owner_path") == "", F.col("file")).otherwise(F.expr("substr(file, length(owner_path) + 2)"))
        generated = F.col("listed") | globs.matches(F.col("file"), globs.GENERATED_GLOBS) | globs.matches(below, globs.VENDORED_GLOBS)
        return materialize(d.select("package_id", "file", F.coalesce("module_symbol_id", F.xxhash64(_file_symbol())).alias("module_symbol_id"), "is_entry", generated.alias("is_generated"), F.col("module_symbol_id").isNull().alias("made")))

    @cached_property
    def parents(self) -> DataFrame:
        """symbol_id, parent_symbol_id: the nearest enclosing declaration of the same package; above a namespace nothing is looked for."""
        n = F.size("p.texts")
        s = self.interned.select("symbol_id", "symbol_str", "package_id", "file", "p").where(n > 1)
        head = F.expr("substr(symbol_str, 1, length(symbol_str) - length(p.tail))")
        levels = s.select("symbol_id", "package_id", "file", head.alias("head"), "p", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
        space = lambda k: F.get(F.col("p.suffixes"), k - 1) == "namespace"
        above = F.exists(F.filter(F.sequence(F.col("k") + 1, F.greatest(F.size("p.texts") - 1, F.col("k") + 1)), lambda j: j <= F.size("p.texts") - 1), lambda j: space(j))
        levels = levels.where(~above).select("symbol_id", "package_id", "file", "k", space(F.col("k")).alias("space"), F.concat("head", F.array_join(F.slice("p.texts", F.lit(1), F.col("k")), "")).alias("symbol_str"))
        parent = self.interned.select("symbol_str", F.col("symbol_id").alias("parent_symbol_id"), F.col("package_id").alias("pp"), F.col("file").alias("pf"), F.col("kind").alias("pk"))
        met = levels.join(parent, "symbol_str").where("package_id = pp")
        modules = self.documents.select(F.col("module_symbol_id").alias("parent_symbol_id")).distinct()
        spaces = anti(met.where("space and file = pf and pk <> 'import-prefix'"), modules, "parent_symbol_id")
        best = met.where("not space").select("symbol_id", "k", "parent_symbol_id").unionByName(spaces.select("symbol_id", "k", "parent_symbol_id"))
        return materialize(best.groupBy("symbol_id").agg(F.max_by("parent_symbol_id", "k").alias("parent_symbol_id")))

    # --- references

    @cached_property
    def _resolved(self) -> DataFrame:
        """Which declaration a package means by a symbol (symbol_id null: none): the columns of ``_meant`` but for key and candidates, symbol_id and def_package_id.

        A reference to what no index defines goes to its nearest defined ancestor if the first
        missing part is an anonymous literal or an implicit constructor, or if any part is
        anonymous and the ancestor no file. (What a document defines has a declaration, so
        only references lack one.)
        """
        o = self._meant.where("candidates is null").drop("candidates", "sym_name")
        of = self.interned.select(F.col("symbol_str").alias("key"), "symbol_id", F.col("package_id").alias("def_package_id"))
        o = materialize(o.join(of, "key", "left"))
        lost = o.where("symbol_id is null").groupBy("key").agg(F.min("sid").alias("sid")).join(self._symbols_met.select("sid", "p"), "sid").where(F.size("p.texts") > 1)
        head = F.expr("substr(key, 1, length(key) - length(p.tail))")
        levels = lost.select("key", head.alias("head"), "p", F.explode(F.sequence(F.lit(1), F.size("p.texts") - 1)).alias("k"))
        first_literal = F.get("p.literal", F.col("k"))
        constructor = (F.get("p.suffixes", F.col("k")) == "method") & (F.get("p.names", F.col("k")) == "<constructor>") & (F.col("k") == F.size("p.texts") - 1)
        in_file = F.forall(F.slice("p.suffixes", F.lit(1), F.col("k")), lambda x: x == "namespace")
        taken = first_literal | constructor | (F.exists("p.literal", lambda x: x) & ~in_file)
        levels = levels.select(F.col("key").alias("missing"), "k", taken.alias("taken"), F.concat("head", F.array_join(F.slice("p.texts", F.lit(1), F.col("k")), "")).alias("key"))
        near = levels.join(of, "key").groupBy("missing").agg(F.max_by(F.struct("taken", "symbol_id", "def_package_id"), "k").alias("a")).where("a.taken")
        near = near.select(F.col("missing").alias("key"), F.col("a.symbol_id").alias("near_id"), F.col("a.def_package_id").alias("near_package_id"))
        o = o.join(near, "key", "left")
        own = F.col("symbol_id").isNotNull()
        return materialize(o.withColumns({"symbol_id": F.coalesce("symbol_id", "near_id"), "def_package_id": F.when(own, F.col("def_package_id")).otherwise(F.col("near_package_id"))}).drop("near_id", "near_package_id", "key"))

    @cached_property
    def _heads(self) -> DataFrame:
        """package_id, file, line, col of definitions with what their text shows: end_line, end_col of the signature, is_error."""
        last = F.element_at("p.suffixes", -1)
        kind = F.when(last == "method", "method").when(last == "type", "type").when((last == "term") & F.col("body").isNotNull() & ~F.col("file").endswith(".dart"), "term")
        named = self._definitions.withColumn("kind", kind).where("kind is not null").select("package_id", "repo", "file", F.col("at.line").alias("line"), F.col("at.col").alias("col"), "kind").distinct()
        # a file's names (bounded by the file) meet its text in one row, so that each text is read once
        by_file = named.groupBy("package_id", "repo", "file").agg(F.sort_array(F.collect_list(F.struct("line", "col", "kind"))).alias("named"))
        texts = self.files.select("repo", F.col("path").alias("file"), "text").where("text is not null")
        found = by_file.join(texts, ["repo", "file"]).select("package_id", "file", F.explode(heads_udf("text", "file", "named")).alias("h")).select("package_id", "file", "h.*")
        return materialize(found.groupBy("package_id", "file", "line", "col").agg(F.max("end_line").alias("end_line"), F.max("end_col").alias("end_col"), F.max("is_error").alias("is_error")))

    @cached_property
    def _spans(self) -> DataFrame:
        """What definitions enclose: package_id, file, symbol_id, start and end, span_order, and head (where the signature begins and ends) if the text tells."""
        spans = self._definitions.where("body is not null").join(self.interned.select(F.col("symbol_str").alias("key"), "symbol_id", F.col("package_id").alias("pp")), "key").where("package_id = pp")
        spans = spans.join(self.documents.select("package_id", "file", "module_symbol_id"), ["package_id", "file"]).where("symbol_id <> module_symbol_id")
        spans = spans.select("package_id", "file", "symbol_id", F.col("body.line").alias("start_line"), F.col("body.col").alias("start_col"), F.col("body.end_line").alias("end_line"), F.col("body.end_col").alias("end_col"), F.col("order.occ_pos").alias("span_order"), "at.line", "at.col")
        if self.files is not None:
            ends = self._heads.where("end_line is not null").select("package_id", "file", "line", "col", F.struct(F.struct("line", "col").alias("begins"), F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col")).alias("ends")).alias("head"))
            spans = spans.join(ends, ["package_id", "file", "line", "col"], "left")
        return materialize(spans.drop("line", "col"))

    @cached_property
    def _contexts(self) -> DataFrame:
        """Of each document what its occurrences meet: package_id, file, module_symbol_id, spans, sites and errors (arrays, bounded by the file)."""
        file = ["package_id", "file"]
        # ordered as the innermost is chosen: the deepest start, the first of equal ones
        head = [F.when(F.col("head").isNotNull(), F.struct(*[_place(F.col(f"head.{c}.line"), F.col(f"head.{c}.col")).alias(c) for c in ("begins", "ends")])).alias("head")] if "head" in self._spans.columns else []
        span = F.struct(_place(F.col("start_line"), F.col("start_col")).alias("start"), (-F.col("span_order")).alias("before"), _place(F.col("end_line"), F.col("end_col")).alias("end"), "symbol_id", *head)
        out = self.documents.select(*file, "module_symbol_id").join(self._spans.groupBy(*file).agg(F.collect_list(span).alias("spans")), file, "left")
        sites = self.sidecars.select("repo", F.explode("exports").alias("e")).select("repo", F.explode("e.sites").alias("s"))
        sites = sites.groupBy("repo", "s.file").agg(F.collect_set(_place(F.col("s.line"), F.col("s.col"))).alias("sites"))
        out = out.join(self.packages.select("package_id", "repo"), "package_id").join(sites, ["repo", "file"], "left").drop("repo")
        if self.files is not None:
            errors = self._heads.where("is_error").groupBy(*file).agg(F.collect_set(_place(F.col("line"), F.col("col"))).alias("errors"))
            out = out.join(errors, file, "left")
        return materialize(out)

    @cached_property
    def _indexed(self) -> DataFrame:
        """Occurrences that the indexes hold: the columns of ``occurrences``."""
        meant = self._resolved.where("symbol_id is not null").select("package_id", "sid", "symbol_id", "def_package_id", "suffix")
        r = self._of_documents.select("package_id", "file", "sid", "role", "at.line", "at.col").join(meant, ["package_id", "sid"]).drop("sid")
        is_def = F.col("role").bitwiseAND(DEFINITION) == 1
        out = r.join(self._contexts, ["package_id", "file"], "left")
        out = out.withColumn("at", _place(F.col("line"), F.col("col")))
        at = F.col("at")
        # a definition is not inside its own span
        inside = lambda s: (at >= s["start"]) & (at < s["end"]) & ~(is_def & (s["symbol_id"] == F.col("symbol_id")))
        here = lambda places: F.coalesce(F.array_contains(places, at), F.lit(False))
        out = out.withColumns({"inner": F.array_max(F.filter("spans", inside)), "is_export_site": here("sites")})
        if self.files is not None:
            in_head = F.coalesce((at > F.col("inner.head.begins")) & (at < F.col("inner.head.ends")), F.lit(False))
            bits = F.when(~is_def & ~F.col("is_export_site") & in_head, F.lit(SIGNATURE)).when(is_def & (F.col("suffix") == "type") & here("errors"), F.lit(ERROR_CLASS)).otherwise(F.lit(0))
            out = out.withColumn("role", F.col("role").bitwiseOR(bits))
        out = out.withColumn("enclosing_symbol_id", F.coalesce("inner.symbol_id", "module_symbol_id"))
        return materialize(out.select(*USE, (F.col("package_id") != F.col("def_package_id")).alias("is_external")))

    @cached_property
    def _referred(self) -> DataFrame:
        """Indexed occurrences, those that a type checker found beyond them, and references to anonymous default exports."""
        out = self._indexed.unionByName(self.checker_refs)
        # the parts are written; their union is read from them
        return out.unionByName(materialize(self._to_defaults(out)))

    def _to_defaults(self, uses: DataFrame) -> DataFrame:
        """References among ``uses`` to files with an anonymous default export, as references to that export."""
        made = self._anonymous_defaults.select("symbol_id", F.col("package_id").alias("home"), "module_symbol_id")
        seen = uses.where((F.col("role").bitwiseAND(DEFINITION) == 0) & ~F.col("is_export_site")).withColumnRenamed("symbol_id", "module_symbol_id").join(made, "module_symbol_id")
        return seen.withColumns({"def_package_id": F.col("home"), "is_external": F.col("package_id") != F.col("home")}).select(*uses.columns)

    @cached_property
    def marked_occurrences(self) -> DataFrame:
        """The ``occurrences`` whose role tells a signature or an error class.

        Only what the indexes hold is marked; references to anonymous default exports and those lent
        to alternatives take the marks along. A declaration lends to one of its own name in its
        repository, so where no marked one has such, what else is used need not be known.
        """
        found = materialize(self._indexed.where(F.col("role").bitwiseAND(SIGNATURE | ERROR_CLASS) != 0))
        found = found.unionByName(materialize(self._to_defaults(found)))
        lends = found.where((F.col("role").bitwiseAND(DEFINITION) == 0) & ~F.col("is_export_site")).select("symbol_id").distinct()
        named = self.interned.join(self.packages.select("package_id", "repo"), "package_id").select("symbol_id", "repo", F.element_at("p.names", -1).alias("last"))
        alike = named.join(named.join(lends, "symbol_id", "left_semi").select("repo", "last").distinct(), ["repo", "last"], "left_semi")
        if alike.groupBy("repo", "last").count().where("count > 1").isEmpty():
            return found
        return found.unionByName(self.conditional_uses.where(F.col("role").bitwiseAND(SIGNATURE | ERROR_CLASS) != 0))

    @cached_property
    def occurrences(self) -> DataFrame:
        """symbol_id, package_id, def_package_id, file, line, col, role, enclosing_symbol_id, is_export_site, is_external (a bag)."""
        return self._used.unionByName(self.conditional_uses)

    @cached_property
    def unresolved_refs(self) -> DataFrame:
        """References to another package's declarations that its index does not have (a bag); whole modules are left out."""
        lost = self._resolved.where("symbol_id is null and target_id is not null and target_id <> package_id").join(self._symbols_met.select("sid", "p.suffixes"), "sid").where(~F.forall("suffixes", lambda x: x == "namespace"))
        lost = self._of_documents.where(F.col("role").bitwiseAND(DEFINITION) == 0).join(lost.select("package_id", "sid", "target_id", "plain"), ["package_id", "sid"])
        lost = lost.select(F.col("package_id").alias("consumer_package_id"), F.col("target_id").alias("target_package_id"), F.col("plain").alias("symbol_str"), "file", F.col("at.line").alias("line"), F.col("at.col").alias("col"))
        return lost.unionByName(self._imports_gone)

    # --- export surface

    @cached_property
    def _positions(self) -> DataFrame:
        """repo, file, line, col, symbol_id of every definition whose symbol its own package holds."""
        d = self._definitions.join(self.interned.select(F.col("symbol_str").alias("key"), "symbol_id", F.col("package_id").alias("pp")), "key").where("package_id = pp")
        return d.groupBy("repo", "file", F.col("at.line").alias("line"), F.col("at.col").alias("col")).agg(F.max_by("symbol_id", "order").alias("symbol_id"))

    @cached_property
    def _exports(self) -> DataFrame:
        e = self.sidecars.select("package_id", "repo", F.explode("exports").alias("e")).select("package_id", "repo", "e.*")
        return e.join(self._positions, ["repo", "file", "line", "col"], "left")

    @cached_property
    def _anonymous_defaults(self) -> DataFrame:
        """package_id, file, repo, line, col, symbol_id, module_symbol_id: default exports without a symbol of their own."""
        e = self._exports.where("symbol_id is null and note = 'default-keyword'").groupBy("package_id", "repo", "file").agg(F.min(F.struct("line", "col")).alias("at"))
        e = e.join(self.documents.select("package_id", "file", "module_symbol_id"), ["package_id", "file"])
        return materialize(e.select("package_id", "file", "repo", "at.line", "at.col", F.xxhash64(F.concat_ws(" ", F.lit("default"), "package_id", "file")).alias("symbol_id"), "module_symbol_id"))

    @cached_property
    def _surface(self) -> DataFrame:
        """symbol_id, entry_file, exported_as of the entry points' exports."""
        e = self._exports
        made = self._anonymous_defaults.select("package_id", "file", F.col("symbol_id").alias("made_id"))
        e = e.join(made, ["package_id", "file"], "left").withColumn("symbol_id", F.coalesce("symbol_id", F.when(F.col("note") == "default-keyword", F.col("made_id"))))
        return materialize(e.where("symbol_id is not null").select("symbol_id", F.col("entry").alias("entry_file"), F.col("exportedAs").alias("exported_as")).distinct())

    @cached_property
    def _entries(self) -> DataFrame:
        e = self.sidecars.select("package_id", "repo", F.explode("entrySymbols").alias("e")).select("repo", "e.file", "e.line", "e.col", F.coalesce("e.kind", F.lit("runtime")).alias("kind"))
        d = self.documents.join(self.packages.select("package_id", "repo"), "package_id").select("repo", "file", "module_symbol_id", F.col("package_id").alias("home"))
        return e.join(self._positions, ["repo", "file", "line", "col"]).join(d, ["repo", "file"])

    @cached_property
    def symbol_exports(self) -> DataFrame:
        """symbol_id, entry_file, exported_as: of entry points, of modules that others import by path, of alternatives to what is exported."""
        return materialize(self._deep_surface.unionByName(self.conditional_exports).distinct())

    @cached_property
    def entry_symbols(self) -> DataFrame:
        """symbol_id, kind: runtime wins over ambient."""
        runtime = self.runtime_exports.unionByName(self.loaded_declarations).unionByName(self.conditional_entries)
        kinds = self._entries.select("symbol_id", "kind").unionByName(runtime.withColumn("kind", F.lit("runtime")))
        return materialize(kinds.groupBy("symbol_id").agg(F.max("kind").alias("kind")))

    @cached_property
    def symbol_names(self) -> DataFrame:
        """symbol_id, symbol_str of all that is declared: the names without what is known of them."""
        files = self.documents.where("made").select(F.col("module_symbol_id").alias("symbol_id"), _file_symbol().alias("symbol_str"))
        made = self._anonymous_defaults.select("symbol_id", F.concat_ws(" ", F.lit("default"), "package_id", "file").alias("symbol_str"))
        return self.interned.select("symbol_id", "symbol_str").unionByName(files).unionByName(made)

    @cached_property
    def _declared(self) -> DataFrame:
        """The table of symbols, with parents, before what is exported is marked."""
        none = F.lit(None).cast("long")
        own = self.interned.join(self.parents, "symbol_id", "left").select("symbol_id", "symbol_str", "package_id", "file", "line", "col", "kind", "name", "parent_symbol_id")
        files = self.documents.where("made").select(F.col("module_symbol_id").alias("symbol_id"), _file_symbol().alias("symbol_str"), "package_id", "file", F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("file").alias("kind"), F.col("file").alias("name"), none.alias("parent_symbol_id"))
        made = self._anonymous_defaults.select("symbol_id", F.concat_ws(" ", F.lit("default"), "package_id", "file").alias("symbol_str"), "package_id", "file", "line", "col", F.lit("").alias("kind"), F.lit("default").alias("name"), none.alias("parent_symbol_id"))
        return materialize(own.unionByName(files).unionByName(made))

    @cached_property
    def symbols(self) -> DataFrame:
        """The table of symbols, with parents and exported marks."""
        return materialize(marked(self._declared, self.symbol_exports, ["symbol_id"], "is_exported").withColumn("first_seen_at", F.lit(None).cast("long")))

    @cached_property
    def _edges(self) -> DataFrame:
        """References, declarations to their members, files to their entry symbols, anonymous defaults to their file, spreads to all that they hand out."""
        refs = reference_edges(self._used)
        p = self._declared.where("parent_symbol_id is not null")
        down = p.select(F.col("parent_symbol_id").alias("from_symbol_id"), F.col("symbol_id").alias("to_symbol_id"), F.lit("scip").alias("source"), F.col("package_id").alias("from_package_id"), F.col("package_id").alias("to_package_id"))
        of = self._declared.select("symbol_id", F.col("package_id").alias("to_package_id"))
        entry = self._entries.join(of, "symbol_id").select(F.col("module_symbol_id").alias("from_symbol_id"), F.col("symbol_id").alias("to_symbol_id"), F.lit("scip").alias("source"), F.col("home").alias("from_package_id"), "to_package_id")
        made = self._anonymous_defaults.select(F.col("symbol_id").alias("from_symbol_id"), F.col("module_symbol_id").alias("to_symbol_id"), F.lit("scip").alias("source"), F.col("package_id").alias("from_package_id"), F.col("package_id").alias("to_package_id"))
        return materialize(refs.unionByName(down).unionByName(entry).unionByName(made).unionByName(self.spread_edges).distinct())

    @cached_property
    def edges(self) -> DataFrame:
        """All edges: those of the indexes and surfaces, those lent to alternatives, those that configurations declare."""
        refs = reference_edges(self.conditional_uses)
        return materialize(self._edges.unionByName(refs).unionByName(self.conditional_edges).unionByName(self.overlay_edges).distinct())

    @cached_property
    def package_flags(self) -> DataFrame:
        """What is uncertain about a package: index status, invalid symbols, dynamic access, flags of its sidecar and names that several packages share."""
        none = F.lit(None).cast("string")
        # an index with invalid symbols is given up before its sidecar is looked for
        looked = self.sidecars.select(F.col("package_id").alias("packageId")).unionByName(self.invalid_indexes.select(F.col("package_id").alias("packageId")))
        out = status_flags(self.manifest, looked)
        bad = self.invalid_indexes.select("package_id", F.lit("index_failed").alias("flag"), "reason", none.alias("file"), none.alias("target_package_id"))
        dynamic = self.sidecars.select("package_id", F.explode("unresolved").alias("u")).select("package_id", F.lit("dynamic_access").alias("flag"), F.coalesce("u.reason", F.to_json("u")).alias("reason"), F.col("u.file").alias("file"), none.alias("target_package_id"))
        said = self._said_flags
        # a name that its file cannot attribute: every candidate may be meant
        several = materialize(self._meant.where("candidates is not null").select("package_id", "sid", "sym_name", "candidates"))
        met = self._of_documents.join(several, ["package_id", "sid"]).select("package_id", F.col("sym_name").alias("name"), "candidates", "file", F.lit(0).alias("rank"), F.struct("doc_order", "occ_pos").alias("order"))
        told = self.ambiguous_uses.select("package_id", "name", "candidates", "file", F.lit(1).alias("rank"), F.lit(None).cast(met.schema["order"].dataType).alias("order"))
        several = met.unionByName(told).groupBy("package_id", "name", "candidates").agg(F.min_by("file", F.struct("rank", "order", "file")).alias("file"))
        reason = F.concat(F.lit("uses of "), "name", F.lit(" match "), F.size("candidates"), F.lit(" packages: "), F.array_join("candidates", ", "))
        shared = several.select("package_id", F.lit("ambiguous_dep").alias("flag"), reason.alias("reason"), "file", F.explode(F.array_remove(F.col("candidates"), F.col("package_id"))).alias("target_package_id"))
        return out.unionByName(bad).unionByName(dynamic).unionByName(said).unionByName(shared).unionByName(self.unindexed_flags)

    @cached_property
    def _said_flags(self) -> DataFrame:
        """Flags of the sidecars, aimed at the packages that their target may mean (none: at no package)."""
        none = F.lit(None).cast("string")
        said = self.sidecars.select("package_id", "repo", F.explode("flags").alias("f")).select("package_id", "repo", "f.*")
        aimed = said.where("targetPackage is not null").select("package_id", "repo", F.lit("npm").alias("sym_manager"), F.col("targetPackage").alias("sym_name")).distinct()
        to = self._named(aimed).select("package_id", F.col("sym_name").alias("targetPackage"), F.coalesce(F.array_remove(F.col("candidates"), F.col("package_id")), F.array(F.when(F.col("target_id") != F.col("package_id"), F.col("target_id")))).alias("targets"))
        return materialize(said.join(to, ["package_id", "targetPackage"], "left").select("package_id", "flag", "reason", "file", F.explode(F.coalesce("targets", F.array(none))).alias("target_package_id")))

    def tables(self) -> dict[str, DataFrame]:
        """The relations that an analysis reads, by name (see ``refloom.schema``)."""
        return {"symbols": self.symbols, "documents": self.documents.drop("made"), "occurrences": self.occurrences, "edges": self.edges, "symbol_exports": self.symbol_exports, "entry_symbols": self.entry_symbols, "unresolved_refs": self.unresolved_refs, "package_flags": self.package_flags, "witness_files": self.witness_files, "unindexed_loads": self.unindexed_loads}


def _place(line: Column, col: Column) -> Column:
    """Line and column as one number."""
    return F.shiftleft(line.cast("long"), 32) + col.cast("long")


def _file_symbol() -> Column:
    return F.concat_ws(" ", F.lit("file"), "package_id", "file")
