"""Entry points of packages: manifests' nested maps walked to leaves, leaves met with the files they stand for.

A manifest names built files as often as sources. So each leaf becomes an ordered list of
candidate paths (itself, probed extensions, the source beside or behind a build folder), all
candidates meet the file list in one equi join, and the first that exists wins.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import dirname, normalized_path
from refloom.operators.analysis import anti
from refloom.storage import materialize, materialize_counted

# Fields that name entries, files looked for where none does, extensions by what they may stand for, folders of builds.
TOP_FIELDS, SOURCE_FIELDS = ("main", "module", "types", "typings"), ("source", "react-native")
FALLBACKS = ("index.ts", "index.tsx", "index.js", "index.mjs", "index.cjs", "src/index.ts", "src/index.tsx")
PROBED = (".ts", ".tsx", ".js", ".mjs", ".cjs", ".jsx")
TYPED, TYPED_FULL = (".ts", ".tsx"), (".ts", ".tsx", ".mts", ".cts")
LAID_OUT = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx")
ROOTED = (*LAID_OUT, ".mjs", ".cjs")
CODE, BUILT, DECLARATION = r"\.[cm]?[jt]sx?$", r"(?:\.d\.[cm]?ts|\.[cm]?js|\.jsx)$", r"\.d\.[cm]?ts$"
BUILD_FOLDER = r"^(?:dist|lib|build|out)/"
NAMED_FOLDER = r"^(?:(?:dist|build|out)-([\w.]+(?:-[\w.]+)*)|([\w.]+(?:-[\w.]+)*)-dist)/(.+)$"
INNER_FOLDER = r"^((?:[^/]+/)*?[^/]+)/(?:dist|build|out)/(.+)$"
FORMATS = ("esm", "cjs", "es", "umd", "mjs", "commonjs", "module", "typescript", "types")
FOLDER_INDEX = r"/index\.(?:[cm]?ts|tsx|jsx?)$"
OUTPUTS = ("dist", "build", "out")

_KEY = ["repo", "dir"]


def _none() -> Column:
    return F.array().cast("array<string>")


def _kind(v: Column) -> Column:
    """object, array, string or null of a variant."""
    shape = F.schema_of_variant(v)
    return F.when(shape == "STRING", "string").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")


def manifest_leaves(manifests: DataFrame) -> DataFrame:
    """repo, dir, field, key, target: every string that ``manifests`` (repo, dir, text) name as an entry.

    ``key`` is the subpath of ``exports`` (``.`` for a map without subpaths), the name of an import
    or null. Objects and arrays are opened round by round, all manifests at once, as deep as
    the deepest map; what is no JSON object has no leaves.
    """
    spark = manifests.sparkSession
    opened = lambda df: df.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).withColumn("found", F.col("value")).drop("v", "value", "pos")
    top = opened(manifests.select(*_KEY, F.expr("try_parse_json(text)").alias("v")).where("v is not null")).withColumnsRenamed({"key": "field", "found": "v"})
    top = top.where(F.col("field").isin(*TOP_FIELDS, *SOURCE_FIELDS, "browser", "bin", "exports", "imports")).withColumn("kind", _kind(F.col("v"))).where("kind is not null")
    plain = top.where(F.col("field").isin(*TOP_FIELDS, *SOURCE_FIELDS, "browser") & (F.col("kind") == "string"))
    names = F.json_object_keys(F.to_json("v"))
    mapped = top.where("field = 'exports' and kind = 'object'").withColumn("split", F.exists(names, lambda n: n.startswith(".")))
    by_key = opened(mapped.where("split").select(*_KEY, "field", "v")).where("key like '.%'").unionByName(opened(top.where("field = 'imports' and kind = 'object'").select(*_KEY, "field", "v")).where("key like '#%'")).withColumnRenamed("found", "v")
    whole = top.where("field = 'exports' and kind <> 'object'").select(*_KEY, "field", "v").unionByName(mapped.where("not split").select(*_KEY, "field", "v")).withColumn("key", F.lit("."))
    bins = top.where("field = 'bin'").select(*_KEY, "field", "v").withColumn("key", F.lit(None).cast("string"))
    columns = [*_KEY, "field", "key", "v"]
    todo = by_key.select(*columns).unionByName(whole.select(*columns)).unionByName(bins.select(*columns)).withColumn("kind", _kind(F.col("v"))).where("kind is not null")
    text = F.variant_get("v", "$", "string").alias("target")
    found = plain.select(*_KEY, "field", F.lit(None).cast("string").alias("key"), text)
    while True:
        todo, seen = materialize_counted(todo, inner=F.col("kind") != "string")
        found = found.unionByName(todo.where("kind = 'string'").select(*_KEY, "field", "key", text))
        if not seen.get("inner"):
            return materialize(found.distinct())
        inner = todo.where("kind <> 'string'").select(*_KEY, "field", F.col("key").alias("of"), "v")
        todo = opened(inner).drop("key").withColumnsRenamed({"of": "key", "found": "v"}).select(*columns).withColumn("kind", _kind(F.col("v"))).where("kind is not null")


def exports_map(leaves: DataFrame, manifests: DataFrame, packages: DataFrame) -> DataFrame:
    """package_id, key, target: what the witness asks of manifests: subpaths with their targets, ``.`` for what the bare name loads.

    A manifest that declares nothing has one row without a target; a package without rows has
    no readable manifest.
    """
    of = packages.select("package_id", "repo", F.when(F.col("path").isin(".", "./"), "").otherwise(F.col("path")).alias("dir"))
    said = leaves.where(F.col("field").isin(*TOP_FIELDS, "exports")).select(*_KEY, F.coalesce("key", F.lit(".")).alias("key"), "target")
    read = manifests.where(F.expr("try_parse_json(text)").isNotNull()).select(*_KEY, F.lit(".").alias("key"), F.lit(None).cast("string").alias("target"))
    return of.join(said.unionByName(read).distinct(), _KEY).select("package_id", "key", "target")


# --- candidates of a leaf ---------------------------------------------------------------------


def _with(stem: Column, extensions: tuple[str, ...]) -> Column:
    return F.array(*[F.concat(stem, F.lit(e)) for e in extensions])


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, BUILT, "")


def _sources(stem: Column, root: Column, declares: Column, extensions: tuple[str, ...]) -> list[Column]:
    """Groups (files, then folder indexes) that a stem under a source root may be; an index may also be its folder's module."""
    direct = F.concat(_with(stem, extensions), F.when(declares, F.array(F.concat(stem, F.lit(".d.ts")))).otherwise(_none()))
    is_index = (stem == "index") | stem.endswith("/index")
    folder = F.regexp_replace(stem, "/?index$", "")
    other = F.when(is_index, F.when((folder != root) & (folder != ""), _with(folder, TYPED)).otherwise(_none())).otherwise(_with(F.concat(stem, F.lit("/index")), TYPED))
    return [direct, other]


def _if(condition: Column, groups: list[Column]) -> list[Column]:
    return [F.when(condition, g).otherwise(_none()) for g in groups]


def _joined(*parts: Column) -> Column:
    return normalized_path(F.concat_ws("/", *parts))


def _behind_build(p: Column, out_dirs: Column, taken: Column, inner: bool) -> list[Column]:
    """Groups of sources that a built path may come from. ``out_dirs``: array of (out_dir, root_dir); ``taken``: names under ``src``; ``inner``: formats are already dropped."""
    declares, star = p.rlike(DECLARATION), p.contains("*")
    builds = p.rlike(BUILD_FOLDER)
    under = F.filter(out_dirs, lambda o: p.startswith(F.concat(o["out_dir"], F.lit("/"))))

    def configured(k: int) -> Column:
        """The k-th group of every compiler output folder that the path lies in, in order."""
        of = lambda o: _sources(_bare(_joined(o["root_dir"], p.substr(F.length(o["out_dir"]) + 2, F.length(p)))), o["root_dir"], declares, ROOTED)[k]
        return F.flatten(F.transform(under, of))

    groups = [configured(0), configured(1)]
    if not inner:
        name = F.concat(F.regexp_extract(p, NAMED_FOLDER, 1), F.regexp_extract(p, NAMED_FOLDER, 2))
        rest = _bare(F.regexp_extract(p, NAMED_FOLDER, 3))
        at = F.concat(F.lit("src/"), name)
        named = _sources(F.concat_ws("/", at, rest), at, declares, LAID_OUT) + _sources(F.concat_ws("/", name, rest), name, declares, LAID_OUT) + _sources(F.concat(F.lit("src/"), rest), F.lit("src"), declares, TYPED_FULL)
        groups += _if(p.rlike(NAMED_FOLDER) & ~star, named)
        beside = F.concat(F.regexp_extract(p, INNER_FOLDER, 1), F.lit("/src"))
        outside = p.rlike(INNER_FOLDER) & ~star & ~F.concat(F.lit("/"), F.regexp_extract(p, INNER_FOLDER, 1), F.lit("/")).contains("/node_modules/")
        groups += _if(outside, _sources(F.concat_ws("/", beside, _bare(F.regexp_extract(p, INNER_FOLDER, 2))), beside, declares, ROOTED))
    groups += _if(builds, _sources(_bare(F.regexp_replace(p, BUILD_FOLDER, "src/")), F.lit("src"), declares, TYPED))
    parts = F.split(p, "/")
    n = F.size(parts)
    is_index = F.element_at(parts, -1).startswith("index.")
    last = F.when(~is_index, n - 1).otherwise(n - 2 if inner else F.greatest(F.lit(2), n - 2))
    # leading folders go one by one, as long as the source root has nothing of their name
    upto = F.when(last >= 2, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>"))
    free = F.filter(upto, lambda k: ~F.exists(F.slice(parts, F.lit(2), k - 1), lambda s: F.array_contains(taken, s)))
    both = F.flatten(F.transform(free, lambda k: F.concat(*_sources(_bare(F.concat(F.lit("src/"), F.array_join(F.slice(parts, k + 1, n), "/"))), F.lit("src"), declares, TYPED_FULL))))
    groups += _if(builds & ~star, [both])
    # what follows some folders is a source path itself
    roots = F.array_distinct(F.concat(F.array(F.lit("src")), F.filter(F.transform(out_dirs, lambda o: o["root_dir"]), lambda r: r != "")))
    rests = F.transform(F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(parts, k + 1, n), "/"))
    inside = F.flatten(F.transform(rests, lambda r: F.flatten(F.transform(F.filter(roots, lambda s: r.startswith(F.concat(s, F.lit("/")))), lambda s: F.concat(*_sources(_bare(r), s, declares, ROOTED))))))
    groups += _if(builds & ~star, [inside])
    return _if(p.rlike(BUILT), groups)


def _without_formats(p: Column) -> Column:
    parts = F.split(p, "/")
    n = F.size(parts)
    middle = F.filter(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: ~s.isin(*FORMATS))
    return F.when(n < 3, p).otherwise(F.array_join(F.concat(F.slice(parts, 1, 1), middle, F.slice(parts, -1, 1)), "/"))


def source_groups(p: Column, out_dirs: Column, taken: Column, named: Column) -> list[Column]:
    """All groups behind a built path: by its folders, the same with format folders dropped, then a bundler's named input (array of (name, source))."""
    q = _without_formats(p)
    again = _if((q != p) & p.rlike(BUILD_FOLDER) & ~p.contains("*"), _behind_build(q, out_dirs, taken, True))
    stem = _bare(p)

    def fits(i: Column) -> Column:
        folder = F.slice(F.split(stem.substr(F.lit(1), F.length(stem) - F.length(i["name"]) - 1), "/"), F.lit(2), F.lit(1 << 20))
        return stem.endswith(F.concat(F.lit("/"), i["name"])) & (F.size(F.filter(folder, lambda s: ~s.isin(*FORMATS))) <= 1)

    inputs = _if(p.rlike(BUILT) & p.rlike(BUILD_FOLDER) & ~p.contains("*"), [F.transform(F.filter(named, fits), lambda i: i["source"])])
    return [*_behind_build(p, out_dirs, taken, False), *again, *inputs]


def _laid_out(p: Column, out_dirs: Column) -> Column:
    """(path, root) of sources of a manifest that is published from its build folder: the same path under a source root."""
    plain = (p != "") & ~p.contains("*") & ~p.rlike(BUILD_FOLDER) & ~F.exists(out_dirs, lambda o: p.startswith(F.concat(o["out_dir"], F.lit("/"))))
    bare = ~F.element_at(F.split(p, "/"), -1).rlike(r".\.")
    roots = F.array_distinct(F.concat(F.filter(F.transform(out_dirs, lambda o: o["root_dir"]), lambda r: r != ""), F.array(F.lit("src"))))
    roots = F.filter(roots, lambda r: ~p.startswith(F.concat(r, F.lit("/"))))
    stem = F.when(bare, p).otherwise(_bare(p))
    of = lambda r: F.transform(F.concat(*_sources(F.concat_ws("/", r, stem), r, p.rlike(DECLARATION), LAID_OUT)), lambda c: F.struct(c.alias("path"), r.alias("root")))
    none = F.array().cast("array<struct<path:string,root:string>>")
    return F.when(plain & (bare | p.rlike(BUILT)), F.flatten(F.transform(roots, of))).otherwise(none)


class Entries:
    """Entry points of packages from their manifests and the list of files.

    ``manifests`` (repo, dir, text: dir without a slash at its end, empty at the root), ``files``
    (repo, path), ``out_dirs`` (repo, dir, out_dir, root_dir: what compilers' settings say, the
    longest first by ``rank``) and ``named_inputs`` (repo, dir, name, source), both optional.
    """

    def __init__(self, manifests: DataFrame, files: DataFrame, out_dirs: DataFrame | None = None, named_inputs: DataFrame | None = None):
        spark = manifests.sparkSession
        self.manifests = manifests.select(*_KEY, "text")
        self.files = files.select("repo", "path").distinct()
        out_dirs = spark.createDataFrame([], "repo string, dir string, out_dir string, root_dir string") if out_dirs is None else out_dirs
        named_inputs = spark.createDataFrame([], "repo string, dir string, name string, source string") if named_inputs is None else named_inputs
        self.out_dirs = out_dirs.groupBy(*_KEY).agg(F.transform(F.sort_array(F.collect_set(F.struct((-F.length("out_dir")).alias("rank"), "out_dir", "root_dir"))), lambda o: F.struct(o["out_dir"].alias("out_dir"), o["root_dir"].alias("root_dir"))).alias("out_dirs"))
        self.named_inputs = named_inputs.groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct("name", "source"))).alias("named"))

    @cached_property
    def leaves(self) -> DataFrame:
        """The manifests' leaves with p, the path within the package (null where it leaves it)."""
        found = manifest_leaves(self.manifests)
        p = normalized_path(F.col("target"))
        away = F.replace(F.col("target"), F.lit("\\"), F.lit("/")).startswith("/") | (p == "..") | p.startswith("../")
        # imports of other packages and entries outside the package name no file of it
        return materialize(found.where("field <> 'imports' or target like './%'").withColumn("p", F.when(~away, p)))

    @cached_property
    def _taken(self) -> DataFrame:
        """repo, dir, name: what lies directly under a package's ``src``, up to any dot."""
        parts = F.split("path", "/")
        at = self.files.where("path like 'src/%' or path like '%/src/%'").select("repo", parts.alias("parts"), F.explode(F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.get(parts, i - 1) == "src")).alias("i"))
        name = F.get("parts", F.col("i"))
        dots = F.filter(F.sequence(F.lit(1), F.length(name)), lambda k: name.substr(k, F.lit(1)) == ".")
        names = F.concat(F.transform(dots, lambda k: name.substr(F.lit(1), k - 1)), F.when(F.size("parts") > F.col("i") + 1, F.array(name)).otherwise(_none()))
        return at.select("repo", F.array_join(F.slice("parts", F.lit(1), F.col("i") - 1), "/").alias("dir"), F.explode(names).alias("name")).distinct()

    @cached_property
    def _paths(self) -> DataFrame:
        """Distinct paths of leaves with what their resolution looks at: out_dirs, named, taken."""
        p = self.leaves.where("p is not null").select(*_KEY, "p").distinct()
        held = p.select(*_KEY, "p", F.explode(F.array_distinct(F.split("p", "/"))).alias("name")).join(self._taken, [*_KEY, "name"]).groupBy(*_KEY, "p").agg(F.collect_set("name").alias("taken"))
        p = p.join(self.out_dirs, _KEY, "left").join(self.named_inputs, _KEY, "left").join(held, [*_KEY, "p"], "left")
        some = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        return materialize(p.select(*_KEY, "p", some("out_dirs", "array<struct<out_dir:string,root_dir:string>>"), some("named", "array<struct<name:string,source:string>>"), some("taken", "array<string>")))

    @cached_property
    def resolved(self) -> DataFrame:
        """repo, dir, p, file, root: the file that each path without a star stands for; root where only the layout of a build folder led to it."""
        p = F.col("p")
        at = lambda e: F.concat(p, F.when(p == "", F.lit("")).otherwise(F.lit("/")), F.lit(f"index{e}"))
        nearest = F.concat(F.array(p), _with(p, PROBED), F.array(*[at(e) for e in PROBED]), F.when(p.rlike(BUILT), _with(_bare(p), TYPED_FULL)).otherwise(_none()))
        direct = F.concat(nearest, *source_groups(p, F.col("out_dirs"), F.col("taken"), F.col("named")))
        tried = F.concat(F.transform(direct, lambda c: F.struct(c.alias("path"), F.lit(None).cast("string").alias("root"))), _laid_out(p, F.col("out_dirs")))
        tried = self._paths.where("p not like '%*%'").select(*_KEY, "p", F.posexplode(tried).alias("rank", "c"))
        tried = tried.select(*_KEY, "p", "rank", "c.root", F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.col("c.path")).alias("file"))
        met = tried.join(self.files.withColumnRenamed("path", "file"), ["repo", "file"])
        return materialize(met.groupBy(*_KEY, "p").agg(F.min_by(F.struct("file", "root"), "rank").alias("best")).select(*_KEY, "p", "best.file", "best.root"))

    @cached_property
    def _published(self) -> DataFrame:
        """repo, dir, published: regular expressions of the paths that a package publishes (null: all)."""
        listed = self.manifests.select(*_KEY, F.from_json(F.get_json_object("text", "$.files"), "array<string>").alias("files")).where("size(files) > 0")
        entry = lambda e: F.regexp_replace(normalized_path(e), "/$", "")
        kept = F.filter(F.transform(F.filter("files", lambda e: e.isNotNull() & ~e.startswith("!")), entry), lambda e: (e != "") & ~e.startswith(".."))
        quoted = lambda e: F.regexp_replace(e, r"([\\^$.+?()|{}\[\]])", r"\\$1")
        glob = lambda e: F.regexp_replace(F.replace(F.replace(F.regexp_replace(quoted(e), r"\*\*/", "\u0001"), F.lit("**"), F.lit("\u0002")), F.lit("*"), F.lit("[^/]*")), "\u0001", "(?:.*/)?")
        starred = lambda e: F.concat(F.when(e.contains("/"), "^").otherwise("^(?:.*/)?"), F.replace(glob(e), F.lit("\u0002"), F.lit(".*")), F.lit("$"))
        regex = F.transform(kept, lambda e: F.when(e.contains("*"), starred(e)).otherwise(F.concat(F.lit("^"), quoted(e), F.lit("(?:/|$)"))))
        return listed.select(*_KEY, F.when(F.size(regex) > 0, regex).alias("published"))

    @cached_property
    def matched(self) -> DataFrame:
        """repo, dir, p, file: the files that a path with stars matches: as written, else the first group of sources behind it that has any."""
        p = F.col("p")
        groups = source_groups(p, F.col("out_dirs"), F.col("taken"), F.col("named"))
        tried = self._paths.where("p like '%*%'").select(*_KEY, "p", F.posexplode(F.array(F.array(p), *groups)).alias("rank", "group"))
        # configured output folders hold several groups one after the other; stars meet them as one
        tried = tried.select(*_KEY, "p", "rank", F.explode("group").alias("variant"))
        head = F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.substring_index("variant", "*", 1))
        pieces = F.split("variant", r"\*")
        quoted = F.transform(pieces, lambda s: F.concat(F.lit(r"\Q"), s, F.lit(r"\E")))
        regex = F.concat(F.lit("^"), quoted[0], F.lit("(.+)"), F.array_join(F.slice(quoted, F.lit(2), F.size(quoted)), r"\1"), F.lit("$"))
        tried = tried.withColumns({"folder": dirname(head), "regex": regex, "output": F.substring_index("variant", "/", 1)}).join(self._published, _KEY, "left")
        parts = F.split("path", "/")
        folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        code = self.files.where(F.col("path").rlike(CODE)).select("repo", "path", F.explode(folders).alias("folder"))
        met = tried.join(code, ["repo", "folder"])
        rel = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substr(path, length(dir) + 2)"))
        met = met.withColumn("rel", rel).where(F.regexp_like("rel", F.col("regex")))
        hidden = F.exists(F.split("rel", "/"), lambda s: s.startswith(".") | (s == "node_modules"))
        built = F.substring_index("rel", "/", 1).isin(*OUTPUTS) & F.col("rel").contains("/") & (F.substring_index("rel", "/", 1) != F.col("output"))
        shown = F.when(F.col("rank") == 0, F.col("rel")).otherwise(F.replace("p", F.lit("*"), F.lit("x")))
        allowed = F.col("published").isNull() | F.exists(F.coalesce("published", _none()), lambda r: F.regexp_like(shown, r))
        hits = materialize(met.where(~hidden & ~built & allowed).select(*_KEY, "p", "rank", F.col("path").alias("file")).distinct())
        first = hits.groupBy(*_KEY, "p").agg(F.min("rank").alias("rank"))
        return materialize(hits.join(materialize(first), [*_KEY, "p", "rank"]).select(*_KEY, "p", "file"))

    @cached_property
    def _outcome(self) -> DataFrame:
        """Leaves with each file they led to (null: none) and whether only the layout did."""
        hits = self.resolved.unionByName(self.matched.withColumn("root", F.lit(None).cast("string")))
        return materialize(self.leaves.join(hits, [*_KEY, "p"], "left"))

    @cached_property
    def found(self) -> DataFrame:
        """repo, dir, file, surface, runtime, fallback: every entry point once; surface is imported, runtime is run or loaded by name."""
        o = self._outcome.where("file is not null")
        name = F.substring_index("file", "/", -1)
        code = F.col("file").rlike(CODE) | ~name.rlike(r".\.")
        o = o.where(code)
        declared = o.where("field <> 'bin' and field <> 'imports'").select(*_KEY, "file", F.lit(True).alias("surface"))
        # a manifest published from its build folder: without an exports map, every folder's index under the source root is imported too
        mapped = self.leaves.where("field = 'exports'").select(*_KEY)
        roots = anti(o.where(F.col("field").isin(*TOP_FIELDS) & F.col("root").isNotNull()).select(*_KEY, "root").distinct(), mapped, _KEY)
        parts = F.split("path", "/")
        folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        indexes = self.files.where(F.col("path").rlike(FOLDER_INDEX) & F.col("path").rlike("/.*/")).select("repo", "path", F.explode(folders).alias("folder"))
        at = F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.col("root")).alias("folder")
        below = roots.select(*_KEY, at).join(indexes, ["repo", "folder"]).select(*_KEY, F.col("path").alias("file"), F.lit(True).alias("surface"))
        bins = o.where("field = 'bin'").select(*_KEY, "file")
        bare = anti(anti(self.manifests.select(*_KEY), declared.unionByName(below), _KEY), bins, _KEY)
        tried = bare.select(*_KEY, F.posexplode(F.array(*map(F.lit, FALLBACKS))).alias("rank", "name")).withColumn("file", F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), "name"))
        fallback = tried.join(self.files.withColumnRenamed("path", "file"), ["repo", "file"]).groupBy(*_KEY).agg(F.min_by("file", "rank").alias("file"))
        rows = declared.unionByName(below).withColumns({"runtime": F.lit(False), "fallback": F.lit(False)})
        rows = rows.unionByName(fallback.select(*_KEY, "file", F.lit(True).alias("surface"), F.lit(False).alias("runtime"), F.lit(True).alias("fallback")))
        loaded = bins.unionByName(o.where(F.col("field") == "imports").where(F.col("p").rlike(CODE)).select(*_KEY, "file"))
        rows = rows.unionByName(loaded.select(*_KEY, "file", F.lit(False).alias("surface"), F.lit(True).alias("runtime"), F.lit(False).alias("fallback")))
        one = rows.groupBy(*_KEY, "file").agg(*[F.bool_or(c).alias(c) for c in ("surface", "runtime", "fallback")])
        return materialize(one.withColumn("runtime", F.col("runtime") & ~F.col("surface")))

    @cached_property
    def unresolved(self) -> DataFrame:
        """repo, dir, target: leaves that look like code and lead to no file: top fields (unless a source field does), and entries none of whose conditions resolves."""
        o = self._outcome.where("p is not null").withColumn("code", F.col("p").rlike(CODE))
        fine = o.where("field = 'exports' and file is not null").select(*_KEY, "key").distinct()
        conditions = self.manifests.select(*_KEY, *[F.get_json_object("text", f"$.exports{at}['{c}']").isNotNull().alias(f"{c}{k}") for k, at in enumerate(("['.']", "")) for c in SOURCE_FIELDS])
        dotted = conditions.where(" or ".join(f"`{c}{k}`" for k in (0, 1) for c in SOURCE_FIELDS)).select(*_KEY).join(fine.where("key = '.'"), _KEY, "left_semi")
        sourced = o.where(F.col("field").isin(*SOURCE_FIELDS) & F.col("file").isNotNull()).select(*_KEY).unionByName(dotted)
        missed = o.where("code and file is null")
        top = anti(missed.where(F.col("field").isin(*TOP_FIELDS)), sourced, _KEY)
        mapped = anti(missed.where("field = 'exports'"), fine, [*_KEY, "key"])
        return top.select(*_KEY, "target").unionByName(mapped.select(*_KEY, "target")).distinct()
