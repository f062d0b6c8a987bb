"""Package manifests to relations: dependencies and visibility, in SQL over the JSON text; the
other manager's indented maps go through a small parser in batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dependency fields in order of precedence (a name counts once), public registries.
NPM_FIELDS = ("dependencies", "peerDependencies", "optionalDependencies", "devDependencies")
NPM_PUBLIC = ("registry.npmjs.org", "registry.yarnpkg.com")
PUB_PUBLIC = ("pub.dev", "pub.dartlang.org")
_MAP = T.MapType(T.StringType(), T.StringType())


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """``manifests`` (repo, path, text) to repo, path, dep_name, dep_constraint, dev: the first field that names a dependency wins."""
    fields = F.explode(
        F.array(*[F.struct(F.lit(k).alias("rank"), F.from_json(F.get_json_object("text", f"$.{f}"), _MAP).alias("deps")) for k, f in enumerate(NPM_FIELDS)])
    ).alias("field")
    rows = manifests.select("repo", "path", fields).select("repo", "path", F.col("field.rank").alias("rank"), F.explode("field.deps").alias("dep_name", "dep_constraint"))
    first = rows.groupBy("repo", "path", "dep_name").agg(F.min(F.struct("rank", "dep_constraint")).alias("d"))
    return first.select("repo", "path", "dep_name", F.col("d.dep_constraint").alias("dep_constraint"), (F.col("d.rank") == NPM_FIELDS.index("devDependencies")).alias("dev"))


def npm_visibility(text: Column) -> Column:
    """private by its flag; else by the registry it publishes to (an unreadable one counts as public: fail closed)."""
    registry = F.coalesce(F.get_json_object(text, "$.publishConfig.registry"), F.lit(""))
    host = F.lower(F.regexp_extract(registry, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    private = F.coalesce(F.get_json_object(text, "$.private"), F.lit("")) == "true"
    return F.when(private, "private").when((host == "") | host.isin(*NPM_PUBLIC), "published-public").otherwise("published-private")


def pub_visibility(publish_to: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(publish_to, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(publish_to.isNull() | host.isin(*PUB_PUBLIC), "published-public").when(publish_to == "none", "private").otherwise("published-private")


def _plain(value: str) -> str | None:
    """A scalar without its comment and quotes; None where it is empty."""
    value = value.strip()
    if value[:1] in ("'", '"'):
        end = value.find(value[0], 1)
        return value[1 : end if end > 0 else None]
    value = value.split(" #", 1)[0].strip()
    return None if value in ("", "~", "null") or value.startswith("#") else value


def parse_pubspec(text: str | None) -> dict:
    """Top-level scalars and the two dependency maps of a manifest of indented maps.

    A dependency with a map below it (path, git, sdk) has no version constraint unless the map names one.
    """
    out: dict = {"name": None, "version": None, "publish_to": None, "dependencies": {}, "dev_dependencies": {}}
    section = dep = None
    depth = 0
    for line in (text or "").splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#") or ":" not in bare:
            continue
        indent = len(line) - len(line.lstrip(" "))
        key, _, value = bare.partition(":")
        key, value = key.strip().strip("'\""), _plain(value)
        if indent == 0:
            section, dep, depth = (key if key.endswith("dependencies") else None), None, 0
            if key in ("name", "version", "publish_to"):
                out[key] = value
        elif section in ("dependencies", "dev_dependencies"):
            depth = depth or indent
            if indent == depth:
                dep = key
                out[section].setdefault(dep, value)
            elif dep is not None and key == "version" and out[section].get(dep) is None:
                out[section][dep] = value
    return out


PUBSPEC = T.StructType(
    [*[T.StructField(k, T.StringType()) for k in ("name", "version", "publish_to")], T.StructField("dependencies", _MAP), T.StructField("dev_dependencies", _MAP)]
)


@F.pandas_udf(PUBSPEC)
def parse_pubspec_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_pubspec(t) for t in texts], columns=PUBSPEC.names)


def select_repositories(repos: DataFrame, include: str | None = None, exclude: str | None = None, archived: bool = False, forks: bool = False, languages: tuple[str, ...] = ()) -> DataFrame:
    """``repos`` (repo, empty, disabled, archived, fork, template, language, n_manifests) with included and reason; the first rule that fits decides.

    ``include`` and ``exclude`` are regular expressions over names (see ``globs.segment_glob_regex``).
    """
    never = F.lit(False)
    named_in = F.col("repo").rlike(include) if include else never
    named_out = F.col("repo").rlike(exclude) if exclude else never
    wanted = F.lower("language").isin(*[x.lower() for x in languages]) if languages else F.lit(True)
    rules = (
        (named_in & F.col("empty"), False, "empty repository"), (named_in & F.col("disabled"), False, "disabled"), (named_in, True, "included by name"),
        (named_out, False, "excluded by name"), (F.col("empty"), False, "empty repository"), (F.col("disabled"), False, "disabled"),
        (F.col("archived") & F.lit(not archived), False, "archived"), (F.col("fork") & F.lit(not forks), False, "fork"), (F.col("template"), False, "template"),
        (F.coalesce(wanted, never), True, "language"), (F.coalesce(F.col("n_manifests") > 0, never), True, "has manifests"),
    )
    reason = included = None
    for condition, keep, why in rules:
        reason = F.when(condition, why) if reason is None else reason.when(condition, why)
        included = F.when(condition, keep) if included is None else included.when(condition, keep)
    return repos.withColumns({"included": included.otherwise(False), "reason": reason.otherwise("no wanted language and no manifest")})
