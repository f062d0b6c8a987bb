"""Entries that no manifest field and no import names: what frameworks load by path, and what pages, bundlers, images and scripts start."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import globs
from refloom.functions.launches import READ, commands_udf, launches_udf
from refloom.functions.text import normalized_path
from refloom.operators.analysis import anti
from refloom.operators.entries import CODE, _KEY, Entries
from refloom.sources.manifests import npm_dependencies
from refloom.storage import materialize

# A convention's name, what must be there (files, dependencies, a script; all that are given, or any), and the files it loads.
CONVENTIONS: tuple[dict, ...] = (
    {"what": "Cloudflare Pages Functions", "any": True, "files": ("wrangler.toml", "wrangler.json", "wrangler.jsonc", "_routes.json", "public/_routes.json"), "deps": ("wrangler",), "scripts": r"\bwrangler\s+pages\b", "globs": ("functions/**",)},
    {"what": "HonoX", "deps": ("honox",), "globs": ("app/server.*", "app/client.*", "app/routes/**", "app/islands/**")},
    {"what": "Netlify Functions", "globs": ("netlify/functions/**", "netlify/edge-functions/**")},
    {"what": "Vercel Functions", "files": ("vercel.json",), "globs": ("api/**",)},
    {"what": "Next.js", "deps": ("next",), "globs": ("pages/**", "app/**", "src/pages/**", "src/app/**")},
    {"what": "SvelteKit / SolidStart", "deps": ("@sveltejs/kit", "@solidjs/start"), "globs": ("src/routes/**",)},
    {"what": "Nuxt", "deps": ("nuxt",), "globs": ("pages/**", "server/**")},
    {"what": "Nuxt app", "files": ("nuxt.config.*",), "globs": tuple("nuxt.config.* app.config.* app/** pages/** layouts/** middleware/** plugins/** server/** composables/** utils/** stores/** components/** modules/** shared/**".split())},
    {"what": "Docusaurus", "files": ("docusaurus.config.*",), "globs": tuple("docusaurus.config.* sidebars.* src/theme/** src/pages/** src/plugins/**".split())},
    {"what": "VitePress", "deps": ("vitepress",), "globs": tuple("**/.vitepress/config.* **/.vitepress/theme/** **/*.data.*".split())},
    {"what": "Astro", "files": ("astro.config.*",), "globs": tuple("astro.config.* src/pages/** src/middleware.* src/middleware/** src/actions/** src/content.config.* src/content/config.* src/live.config.*".split())},
)
# Where a bundler begins when its configuration does not tell.
WEBPACK_DEFAULTS = ("src/index.js", "src/index.ts", "src/index.jsx", "src/index.tsx")


def _any_glob(path: Column, patterns: tuple[str, ...]) -> Column:
    return path.rlike("|".join(globs.segment_glob_regex(g) for g in patterns))


class RuntimeEntries(Entries):
    """Runtime entries of packages: ``manifests`` and ``files`` as for ``Entries``, ``files`` with the text of configuration files and pages (null elsewhere)."""

    def __init__(self, manifests: DataFrame, files: DataFrame, out_dirs: DataFrame | None = None, named_inputs: DataFrame | None = None):
        super().__init__(manifests, files, out_dirs, named_inputs)
        self.texts = files.where("text is not null").select("repo", "path", "text")

    @cached_property
    def owned(self) -> DataFrame:
        """repo, dir, path, rel: every file with the nearest package folder above it."""
        parts = F.split("path", "/")
        folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        above = self.files.where("path is not null").select("repo", "path", F.explode(folders).alias("dir"))
        near = above.join(self.manifests.select(*_KEY).distinct(), _KEY).groupBy("repo", "path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
        return materialize(near.withColumn("rel", F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substr(path, length(dir) + 2)"))))

    @cached_property
    def _scripts(self) -> DataFrame:
        """repo, dir, command of every script of a manifest."""
        said = F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")
        return self.manifests.select(*_KEY, F.explode(said).alias("script", "command")).where("command is not null").select(*_KEY, "command")

    @cached_property
    def _facts(self) -> DataFrame:
        """repo, dir, and for each convention whether the package meets its conditions: each source is read once for all conventions."""
        rules = list(enumerate(CONVENTIONS))
        seen = lambda df, test: df.groupBy(*_KEY).agg(*[F.bool_or(test(c)).alias(f"x{i}") for i, c in rules])
        no = F.lit(False)
        files = seen(self.owned, lambda c: _any_glob(F.col("rel"), c["files"]) if "files" in c else no)
        deps = npm_dependencies(self.manifests.withColumnRenamed("dir", "path")).withColumnRenamed("path", "dir")
        deps = seen(deps, lambda c: F.col("dep_name").isin(*c["deps"]) if "deps" in c else no)
        scripts = seen(self._scripts, lambda c: F.col("command").rlike(c["scripts"]) if "scripts" in c else no)
        out = self.manifests.select(*_KEY).distinct()
        for kind, found in (("files", files), ("deps", deps), ("scripts", scripts)):
            out = out.join(found.withColumnsRenamed({f"x{i}": f"{kind}{i}" for i, _ in rules}), _KEY, "left")

        def met(i: int, c: dict) -> Column:
            given = [F.coalesce(f"{kind}{i}", no) for kind in ("files", "deps", "scripts") if kind in c]
            result = no if c.get("any") else F.lit(True)
            for g in given:
                result = result | g if c.get("any") else result & g
            return result

        return materialize(out.select(*_KEY, *[met(i, c).alias(f"met{i}") for i, c in rules]))

    @staticmethod
    def _loadable(path: Column, dotted: tuple[str, ...] = (".vitepress",)) -> Column:
        """Code that a runtime may load: no declarations, tests, dependencies or hidden folders."""
        hidden = F.exists(F.split(path, "/"), lambda s: (s.startswith(".") & ~s.isin(*dotted)) | (s == "node_modules"))
        return path.rlike(CODE) & ~path.rlike(r"\.d\.[cm]?ts$") & ~hidden & ~path.rlike(r"(?:^|/)\.vitepress/(?:cache|dist)/") & ~globs.matches(path, globs.TEST_GLOBS)

    @cached_property
    def conventional(self) -> DataFrame:
        """repo, dir, file, what: files that a convention loads, all conventions in one pass."""
        what = F.array_compact(F.array(*[F.when(F.col(f"met{i}") & _any_glob(F.col("rel"), c["globs"]), c["what"]) for i, c in enumerate(CONVENTIONS)]))
        return self.owned.where(self._loadable(F.col("rel"))).join(self._facts, _KEY).select(*_KEY, F.col("path").alias("file"), F.explode(what).alias("what"))

    @cached_property
    def leaves(self) -> DataFrame:
        """repo, dir, field (the rule's kind), key (a bundler's name for it), target, p: what texts and scripts name, within the package."""
        read = self.owned.where(F.col("rel").rlike(READ)).join(self.texts, ["repo", "path"])
        said = read.select(*_KEY, F.inline(launches_udf("rel", "text"))).select(*_KEY, F.col("kind").alias("field"), F.col("name").alias("key"), "target")
        said = materialize(said)
        configured = said.where("field = 'worker'").select(*_KEY).distinct().withColumn("configured", F.lit(True))
        run = self._scripts.join(configured, _KEY, "left").select(*_KEY, F.explode(commands_udf("command", F.col("configured").isNull())).alias("target"))
        said = said.unionByName(run.select(*_KEY, F.lit("script").alias("field"), F.lit(None).cast("string").alias("key"), "target"))
        # a bundler whose configuration names no entry that can be read begins at its default
        silent = anti(self.owned.where(r"rel rlike '^webpack(?:\\.[\\w-]+)*\\.config\\.[cm]?[jt]s$'").select(*_KEY).distinct(), said.where("field = 'webpack'"), _KEY)
        first = silent.join(self.owned, _KEY).where(F.col("rel").isin(*WEBPACK_DEFAULTS)).groupBy(*_KEY).agg(F.min_by("rel", F.array_position(F.array(*map(F.lit, WEBPACK_DEFAULTS)), F.col("rel"))).alias("target"))
        said = said.unionByName(first.select(*_KEY, F.lit("webpack").alias("field"), F.lit("main").alias("key"), "target"))
        p = normalized_path(F.col("target"))
        away = F.col("target").startswith("/") | (p == "..") | p.startswith("../") | (p == "")
        return materialize(said.distinct().withColumn("p", F.when(~away & ~p.contains("*"), p)))

    @cached_property
    def launched(self) -> DataFrame:
        """repo, dir, file, what (the rule's kind): files that are started, built paths led back to their sources."""
        o = self.leaves.where("p is not null").join(self.resolved, [*_KEY, "p"], "left").select(*_KEY, "field", "key", "p", "file")
        named = o.where("field = 'webpack' and file is not null").select(*_KEY, F.col("key").alias("name"), F.col("file").alias("built"))
        # a page's script that is no file and is called as a bundler's entry is that entry
        lost = o.where("field = 'page' and file is null").withColumn("name", F.regexp_extract("p", r"(?:^|/)([^/]+)\.[cm]?js$", 1)).join(named, [*_KEY, "name"])
        found = o.where("file is not null").select(*_KEY, "file", "field").unionByName(lost.select(*_KEY, F.col("built").alias("file"), "field"))
        rel = F.when(F.col("dir") == "", F.col("file")).otherwise(F.expr("substr(file, length(dir) + 2)"))
        client = F.col("field").isin("page", "bundler", "webpack")
        return found.where(F.when(client, rel.rlike(CODE)).otherwise(self._loadable(rel))).select(*_KEY, "file", F.col("field").alias("what")).distinct()

    @cached_property
    def runtime(self) -> DataFrame:
        """repo, dir, file, what: every runtime entry with what loads it."""
        return materialize(self.conventional.unionByName(self.launched).distinct())
