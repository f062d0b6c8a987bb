"""By which import specifiers a package's file can be loaded: addresses of files, forms of specifiers.

An address is (form, value): ``root`` the bare package name, ``path`` a whole subpath, ``tail`` a
subpath's last segment. A file has the addresses of its own place, and those under which its
package's exports map offers it. Map and source tree rarely name the same path, so both are
reduced to routes (no build or source folder, no extension, no index) and meet by the suffixes
of each other, as keys of equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.text import basename, dirname
from refloom.operators.analysis import anti, semi

# Code extensions, and the folders that a build or a source tree puts before a module's name.
EXTENSION = r"(?:\.d)?\.[cm]?[jt]sx?$"
FOLDERS = ("dist", "lib", "build", "out", "src", "esm", "cjs", "types", "es")
INDEX = "index"


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, EXTENSION, "")


def last_name(path: Column) -> Column:
    """The last segment up to its last dot (a leading one does not count)."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def route(path: Column) -> Column:
    """A path of a source tree or of an exports map, as both would name it."""
    parts = F.split(without_extension(F.regexp_replace(path, r"^\./", "")), "/")
    leading = F.coalesce(F.get(F.filter(F.transform(parts, lambda s, i: F.when(~s.isin(*FOLDERS) | (i == F.size(parts) - 1), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(0))
    rest = F.slice(parts, leading + 1, F.size(parts))
    rest = F.when(F.element_at(rest, -1) == INDEX, F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
    return F.array_join(rest, "/")


def suffixes(path: Column) -> Column:
    """A route from each of its segments on, itself first; of the empty one only itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def _named(form: str, value: Column) -> Column:
    return F.struct(F.lit(form).alias("form"), value.alias("value"))


def _places(files: DataFrame) -> DataFrame:
    """Addresses of files by where they lie; a file outside its package's folder may be anything the bare name loads."""
    name, folder = last_name(F.col("file")), basename(dirname(F.col("file")))
    inside, index = F.col("rel").isNotNull(), last_name(F.col("file")) == INDEX
    module = without_extension(F.regexp_replace("rel", "^src/", ""))
    found = F.array_compact(F.array(
        _named("tail", name), F.when(index & (folder != ""), _named("tail", folder)), F.when(~inside, _named("root", F.lit(""))),
        F.when(inside, _named("path", module)), F.when(inside & index, _named("path", F.regexp_replace(module, "(?:^|/)index$", ""))),
    ))
    return files.select("package_id", "file", F.inline(found))


def _met_by_suffix(files: DataFrame, maps: DataFrame) -> DataFrame:
    """Files and map rows of a package of which one's route ends with the other's whole route."""
    ends = maps.select("*", F.explode(suffixes(F.col("route"))).alias("meeting"))
    whole = files.withColumn("meeting", F.col("way")).join(ends, ["package_id", "meeting"])
    begins = files.select("*", F.explode(suffixes(F.col("way"))).alias("meeting"))
    other = begins.join(maps.where("route <> ''").withColumn("meeting", F.col("route")), ["package_id", "meeting"])
    columns = ["package_id", "file", "key"]
    return whole.select(*columns).unionByName(other.select(*columns)).distinct()


def _met_by_star(files: DataFrame, maps: DataFrame) -> DataFrame:
    """Files that fill the star of a map's target, with the key that has the same in place of its own.

    The folder before the star is the join's key: of a file's route, every run of segments that
    is as long as it. Of several runs the last counts.
    """
    m = maps.select("package_id", "key", F.substring_index("route", "*", 1).alias("before"), F.substring_index("route", "*", -1).alias("behind"))
    m = m.withColumns({"folder": dirname(F.concat("before", F.lit("x"))), "depth": F.size(F.split("before", "/")) - 1}).distinct()
    depths = m.select("package_id", "depth").distinct()
    f = files.select("package_id", "file", F.explode(suffixes(F.col("way"))).alias("run")).join(depths, "package_id")
    f = f.withColumn("folder", F.array_join(F.slice(F.split("run", "/"), F.lit(1), F.col("depth")), "/"))
    met = f.join(m, ["package_id", "depth", "folder"])
    room = F.length("run") - F.length("before") - F.length("behind")
    met = met.where((room > 0) & F.startswith("run", F.col("before")) & F.endswith("run", F.col("behind")))
    part = F.col("run").substr(F.length("before") + 1, F.length("run") - F.length("before") - F.length("behind"))
    last = met.groupBy("package_id", "file", "key", "before", "behind").agg(F.min_by(part, F.length("run")).alias("part"))
    return last.select("package_id", "file", F.replace("key", F.lit("*"), F.col("part")).alias("key"))


def addresses(entries: DataFrame, packages: DataFrame, maps: DataFrame | None) -> DataFrame:
    """symbol_id, form, value of specifiers that load one of a symbol's files.

    ``entries``: symbol_id, package_id, file; ``packages``: package_id, path; ``maps``: package_id,
    key, target of every leaf of a package's manifest (``operators.entries.exports_map``). A
    package without rows there has no readable manifest, so its bare name may load every file
    (fail closed); one that declares no entry loads its index file.
    """
    base = F.when(F.col("path") == ".", F.lit("")).otherwise(F.concat("path", F.lit("/")))
    files = entries.select("package_id", "file").distinct().join(packages.select("package_id", base.alias("base")), "package_id")
    files = files.withColumn("rel", F.when(F.col("base").isNotNull() & F.startswith("file", F.col("base")), F.expr("substr(file, length(base) + 1)")))
    found = _places(files)
    inside = files.where("rel is not null").select("package_id", "file", route(F.col("rel")).alias("way"))
    root = lambda f: f.select("package_id", "file", F.lit("root").alias("form"), F.lit("").alias("value"))
    if maps is None:
        found = found.unionByName(root(inside))
    else:
        named = maps.where("target is not null").select("package_id", "key", "target", route(F.col("target")).alias("route")).distinct()
        silent = anti(maps.select("package_id").distinct(), named.where("key = '.'"), "package_id")
        found = found.unionByName(root(anti(files, maps, "package_id"))).unionByName(root(semi(inside.where("way = ''"), silent, "package_id")))
        offered = _met_by_suffix(inside, named.where("key not like '%*%'")).unionByName(_met_by_star(inside, named.where("key like '%*%' and target like '%*%'")))
        subpath = without_extension(F.regexp_replace("key", r"^\./?", ""))
        found = found.unionByName(root(offered.where("key = '.'"))).unionByName(offered.where("key <> '.'").select("package_id", "file", F.lit("path").alias("form"), subpath.alias("value")))
    return entries.select("symbol_id", "package_id", "file").distinct().join(found.distinct(), ["package_id", "file"]).select("symbol_id", "form", "value").distinct()


def specifier_forms(imports: DataFrame) -> DataFrame:
    """``imports`` (with subpath, null for the bare name) with a row for each form that the specifier could be known by; one without a name in it may be any."""
    whole = F.array_join(F.filter(F.split("subpath", "/"), lambda s: s != ""), "/")
    known = F.array_distinct(F.array(_named("tail", last_name(whole)), _named("path", whole), _named("path", without_extension(whole))))
    forms = F.when(F.col("subpath").isNull(), F.array(_named("root", F.lit("")))).when(last_name(whole) == "", F.array(_named("any", F.lit("")))).otherwise(known)
    return imports.select("*", F.inline(forms))
