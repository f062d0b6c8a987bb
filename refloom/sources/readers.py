"""Readers of organisation inputs, each with an explicit schema (nothing is inferred)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.text import basename, dirname
from refloom.schema import TABLES

INDEX = (
    "package_id string, load_order long, documents array<struct<relativePath:string,symbols:array<struct<symbol:string,kind:int>>,"
    "occurrences:array<struct<symbol:string,symbolRoles:int,range:array<int>,enclosingRange:array<int>>>>>"
)
_AT = "entry:string,exportedAs:string,name:string,file:string,line:int,col:int"
_IN = "file:string,line:int,col:int"
_CHECKED = f"array<struct<{_IN},member:string,targetPackage:string,targetFile:string,targetLine:int,targetCol:int>>"
SIDECAR = (
    f"packageId string, entryPoints array<string>, missingEntryPoints array<string>, generatedFiles array<string>, exports array<struct<{_AT},sites:array<struct<{_IN}>>,note:string>>,"
    f"entrySymbols array<struct<{_IN},name:string,kind:string>>, unresolved array<struct<file:string,reason:string>>,"
    f"flags array<struct<flag:string,reason:string,file:string,targetPackage:string>>, unresolvedImports array<struct<module:string,name:string,{_IN}>>,"
    f"namespaceMemberRefs {_CHECKED}, shorthandRefs {_CHECKED}, namespaceSpreadRefs array<struct<{_IN},targetPackage:string,targetFile:string>>,"
    "unindexedImports array<struct<file:string,module:string,targetPackage:string,scope:string,relative:boolean,unresolved:boolean>>,"
    f"deepImportExports array<struct<targetPackage:string,file:string,name:string,entry:string,exportedAs:string>>,"
    f"conditionalImports array<struct<{_IN},target:string,alternatives:array<string>,directive:string>>"
)
INDEX_MANIFEST = "repo string, headSha string, status string, packages array<struct<packageId:string,indexer:string,indexerVersion:string,status:string,scip:string,exports:string,diagnostics:array<string>>>"
ORG = "org string, repos array<struct<name:string,default_branch:string>>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Nested Parquet of decoded indexes, one row a package."""
    return spark.read.schema(INDEX).parquet(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIDECAR).json(path, multiLine=True)


def read_index_manifests(spark: SparkSession, path: str) -> DataFrame:
    """repo, package_id, status, diagnostics of every indexed package."""
    m = spark.read.schema(INDEX_MANIFEST).json(path, multiLine=True)
    m = m.select("repo", F.explode("packages").alias("p"))
    return m.select("repo", F.col("p.packageId").alias("package_id"), F.col("p.status").alias("status"), F.col("p.diagnostics").alias("diagnostics"))


def read_org(spark: SparkSession, path: str) -> DataFrame:
    o = spark.read.schema(ORG).json(path, multiLine=True)
    return o.select("org", F.explode("repos").alias("r")).select("org", F.col("r.name").alias("repo"), F.col("r.default_branch").alias("default_branch"))


# Folders that never hold a package's sources; those that only git's listing can tell; files that make a folder a package.
NEVER_SOURCES = (".git", ".dart_tool", "node_modules", ".nx", ".turbo", ".cache", ".parcel-cache", ".yarn", ".pnpm-store")
UNLISTED_SKIPPED, OUTPUT_FOLDERS = ("vendor", "third_party"), ("build", "dist")
PACKAGE_FILES = ("package.json", "pubspec.yaml")


def _below(path: Column, folders: tuple[str, ...]) -> Column:
    return path.rlike("(^|/)(" + "|".join(re.escape(f) for f in folders) + ")/")


def source_files(files: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``files`` (repo, path, ...) that may be a package's sources.

    ``listed`` (repo, path) names the files that git tracks or would track, where a checkout
    has git; nothing else of its repositories counts, and build folders count if listed.
    Without git's word a build output folder is left out, unless it holds a manifest itself.
    """
    kept = files.where(~_below(F.col("path"), NEVER_SOURCES))
    if listed is None:
        return _walked(kept)
    known = listed.select("repo").distinct()
    tracked = kept.join(listed.select("repo", "path"), ["repo", "path"], "left_semi")
    return tracked.unionByName(_walked(kept.join(known, "repo", "left_anti")))


def _walked(files: DataFrame) -> DataFrame:
    kept = files.where(~_below(F.col("path"), UNLISTED_SKIPPED))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    named = "(^|/)(" + "|".join(OUTPUT_FOLDERS) + ")$"
    outputs = F.filter(F.slice(folders, 1, F.size(parts) - 1), lambda f: f.rlike(named))
    inside = kept.where(_below(F.col("path"), OUTPUT_FOLDERS)).select("repo", "path", F.explode(outputs).alias("folder"))
    own = files.where(basename(F.col("path")).isin(*PACKAGE_FILES)).select("repo", dirname(F.col("path")).alias("folder")).distinct()
    dropped = inside.join(own, ["repo", "folder"], "left_anti").select("repo", "path").distinct()
    return kept.join(dropped, ["repo", "path"], "left_anti")


def read_checkouts(spark: SparkSession, path: str, listed: DataFrame | None = None) -> DataFrame:
    """repo, path, text of all source files below ``path/<repo>/`` (one row a file; see ``source_files``)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path).withColumn("uri", F.input_file_name())
    rel = F.regexp_extract("uri", r"repos/(.+)$", 1)
    out = raw.select(F.substring_index(rel, "/", 1).alias("repo"), F.expr("regexp_replace(regexp_extract(uri, 'repos/(.+)$', 1), '^[^/]*/', '')").alias("path"), F.col("value").alias("text"))
    return source_files(out, listed)


def read_tables(spark: SparkSession, path: str, without: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All relations of an organisation (but for those ``without``) from Parquet folders named like the tables."""
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in TABLES.items() if name not in without}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A run directory: every relation as Parquet; publish by moving a pointer to it."""
    for name, df in tables.items():
        if name in TABLES:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
