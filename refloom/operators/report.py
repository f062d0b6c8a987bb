"""Report relations: views, pivots, blockers, gaps, warnings and SARIF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refloom.functions.text import uri_path
from refloom.operators.analysis import Analysis, marked

# Views of the report, in their order.
VIEWS = ("delete", "deprecate", "org_dead", "unexport", "private_dead", "needs_review", "blocked", "version_skew")
# SARIF rule of a verdict and its level.
LEVELS = {"deletion_candidate": "warning", "deprecation_candidate": "warning", "unexport_candidate": "note", "private_dead": "warning", "needs_review": "note", "blocked": "none"}
TOP_BLOCKERS, TOP_GAPS, EXAMPLES = 10, 5, 3


def finding_rows(a: Analysis, findings: DataFrame) -> DataFrame:
    """Findings with their place (lines and columns from 1) and the view they belong to."""
    s = a.t["symbols"].select("symbol_id", F.col("name").alias("symbol"), "package_id", "file", (F.col("line") + 1).alias("line"), (F.col("col") + 1).alias("col"))
    f = findings.join(s, "symbol_id").join(a.t["packages"].select("package_id", "repo"), "package_id")
    f = marked(f, a.private_packages, ["package_id"], "private")
    internal = F.array_contains("reasons", "internal_refs_only")
    view = (
        F.when(F.col("verdict") == "deletion_candidate", "delete")
        .when((F.col("verdict") == "deprecation_candidate") & internal, "unexport")
        .when(F.col("verdict") == "deprecation_candidate", "deprecate")
        .when(F.col("verdict") == "unexport_candidate", "unexport")
        .when((F.col("verdict") == "private_dead") & ~F.col("private") & ~F.array_contains("reasons", "already_unreachable"), "org_dead")
        .otherwise(F.col("verdict"))
    )
    return f.withColumn("view", view)


def view_rows(rows: DataFrame) -> DataFrame:
    """One row a view and finding: deprecations are shown as dead in the organisation too."""
    both = F.when(F.col("view") == "deprecate", F.array(F.lit("deprecate"), F.lit("org_dead"))).otherwise(F.array("view"))
    return rows.withColumn("view", F.explode(both))


def package_counts(rows: DataFrame) -> DataFrame:
    """A row a package with the count of each view."""
    return view_rows(rows).groupBy("package_id").pivot("view", list(VIEWS)).count().na.fill(0)


def reason_counts(rows: DataFrame) -> DataFrame:
    """Findings by their most telling reason."""
    reason = None
    for name in ("dead_island", "only_test_refs", "only_docs_refs", "no_refs"):
        hit = F.array_contains("reasons", name)
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return rows.groupBy("verdict", reason.otherwise("other").alias("reason")).agg(F.count("*").alias("n"))


def blockers(a: Analysis, rows: DataFrame, top: int | None = TOP_BLOCKERS) -> DataFrame:
    """Blocking packages: findings and packages they hold back, and their flags."""
    held = rows.where("verdict = 'blocked'").select("symbol_id", "package_id", F.explode("blocked_by").alias("entry"))
    cut = F.length("entry") - F.length(F.substring_index("entry", ":", -1)) - 1
    held = held.select("symbol_id", "package_id", F.col("entry").substr(F.lit(1), cut).alias("blocker"), F.substring_index("entry", ":", -1).alias("flag"))
    out = held.groupBy("blocker").agg(F.countDistinct("symbol_id").alias("findings"), F.countDistinct("package_id").alias("packages"), F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"))
    return out.orderBy(F.desc("findings"), "blocker").limit(top) if top else out


def gap_names(a: Analysis) -> DataFrame:
    """Names that references could not resolve: per class and target the count and the three most frequent."""
    shown = F.when(F.col("symbol_str") == "*", "*").otherwise(F.substring_index("symbol_str", "/", -1))
    order = F.when(F.col("class") == "version_skew", 0).when(F.col("class") == "moved_at_head", 1).when(F.col("class") == "unindexed_module", 2).when(F.col("class") == "opaque_target", 3).otherwise(4)
    rows = a.unresolved_ref_classes.select("consumer_package_id", "target_package_id", shown.alias("name"), "file", "line", "col", "class", order.alias("o"))
    # the same reference in two classes stays in the first
    rows = rows.groupBy("consumer_package_id", "target_package_id", "name", "file", "line", "col").agg(F.min(F.struct("o", "class")).alias("c"))
    names = rows.groupBy(F.col("c.class").alias("class"), "target_package_id", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("class", "target_package_id").orderBy(F.desc("n"), "name"))
    total = names.groupBy("class", "target_package_id").agg(F.sum("n").alias("refs"))
    best = names.withColumn("r", rank).where(F.col("r") <= EXAMPLES).groupBy("class", "target_package_id").agg(F.sort_array(F.collect_list(F.struct("r", "name"))).alias("l"))
    return total.join(best, ["class", "target_package_id"]).select("class", "target_package_id", "refs", F.array_join(F.transform("l", lambda x: x["name"]), ",").alias("examples"))


def age_coverage(a: Analysis) -> DataFrame:
    """Exported symbols of each repository and how many have a known age."""
    s = a.t["symbols"].where("is_exported").join(a.t["packages"].select("package_id", "repo"), "package_id")
    known = s.groupBy("repo").agg(F.count("*").alias("symbols"), F.count("first_seen_at").alias("dated"))
    out = a.t["repos"].select("repo").join(known, "repo", "left").join(a.t["repo_history"], "repo", "left")
    return out.select("repo", F.coalesce("history", F.lit("none")).alias("history"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("dated", F.lit(0)).alias("dated"))


def dev_dependencies(a: Analysis) -> DataFrame:
    """Consumer and target pairs; dev when any declaration is."""
    d = a.t["package_deps"].where("resolved_package_id is not null")
    return d.groupBy("consumer_package_id", F.col("resolved_package_id").alias("target_package_id")).agg(F.bool_or("dev").alias("dev"))


def sarif_results(rows: DataFrame) -> DataFrame:
    """One row a result: rule, place, message and a fingerprint that repeats of a key number."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("verdict")]
    message = F.concat("symbol", F.lit(": "), F.array_join("reasons", ", "))
    r = rows.select("repo", F.col("verdict").alias("rule"), level.alias("level"), uri_path(F.col("file")).alias("uri"), "line", "col", "symbol", message.alias("message"), F.concat_ws("|", "package_id", "file", "symbol").alias("key"))
    nth = F.row_number().over(Window.partitionBy("repo", "rule", "key").orderBy("uri", "line", "col", "message"))
    suffix = F.when(F.col("nth") > 1, F.concat(F.lit("#"), F.col("nth"))).otherwise("")
    r = r.withColumn("nth", nth).withColumn("fingerprint", F.sha2(F.concat("rule", F.lit("|"), "key", suffix), 256))
    return r.drop("nth", "key")


def sarif_logs(a: Analysis, rows: DataFrame) -> DataFrame:
    """repo, sarif: one SARIF 2.1.0 log a repository, also where it has no result."""
    place = F.struct(
        F.struct(
            F.struct(F.col("uri")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region"),
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule").alias("ruleId"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary/v1")).alias("partialFingerprints"),
    )
    ordered = F.struct("rule", "uri", "line", "symbol", "message", result.alias("result"))
    grouped = sarif_results(rows).groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(ordered)), lambda x: x["result"]).alias("results"))
    per_repo = a.t["repos"].select("repo").join(grouped, "repo", "left")
    empty = F.array().cast(grouped.schema["results"].dataType)
    rules = F.array(*[F.struct(F.lit(v).alias("id")) for v in LEVELS])
    run = F.struct(F.struct(F.struct(F.lit("refloom").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.coalesce("results", empty).alias("results"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(run).alias("runs"))
    return per_repo.select("repo", F.to_json(log).alias("sarif"))


def warnings(a: Analysis) -> DataFrame:
    """kind, subject, text of what a reader should know: the age rule without ages, repositories that failed or were left out, dependency names that several packages share."""
    line = lambda kind, subject, text: [F.lit(kind).alias("kind"), subject.alias("subject"), text.alias("text")]
    days = a.policy.min_age_days
    cover = age_coverage(a).where((F.col("dated") < F.col("symbols")) & F.lit(bool(days)))
    age = cover.select(*line("age", F.col("repo"), F.concat("repo", F.lit(": "), F.col("symbols") - F.col("dated"), F.lit(" of "), "symbols", F.lit(" exported symbols have no known age and count as old enough"))))
    flags = a.t["package_flags"].where("target_package_id is null and flag in ('index_failed', 'opaque_consumer')").join(a.t["packages"].select("package_id", "repo"), "package_id")
    named = lambda flag: F.array_join(F.sort_array(F.collect_set(F.when(F.col("flag") == flag, F.col("package_id")))), ", ")
    by_repo = flags.groupBy("repo").agg(named("index_failed").alias("failed"), named("opaque_consumer").alias("partial"))
    said = F.array_join(F.array_compact(F.array(F.when(F.col("failed") != "", F.concat(F.lit("index failed for "), "failed")), F.when(F.col("partial") != "", F.concat(F.lit("index partial for "), "partial")))), "; ")
    unread = by_repo.select(*line("index", F.col("repo"), F.concat("repo", F.lit(": "), said, F.lit("; what they depend on gets no verdict"))))
    out = a.t["excluded_repos"].where("size(manifests) > 0").select(*line("excluded", F.col("repo"), F.concat("repo", F.lit(" was left out ("), "reason", F.lit("): what it uses is not seen"))))
    ignored = a.t["ignored_manifests"].select(*line("ignored", F.concat_ws("/", "repo", "manifest"), F.concat("repo", F.lit("/"), "manifest", F.lit(" is ignored by "), "glob")))
    deps = a.t["package_deps"]
    several = deps.where("ambiguous or resolution in ('same-repo', 'published', 'constraint')") if {"ambiguous", "resolution"} <= set(deps.columns) else deps.where("false").withColumn("resolution", F.lit(""))
    end = F.when(F.col("resolved_package_id").isNull(), F.lit("none could be preferred, so all of them are blocked")).otherwise(F.concat(F.lit("resolved to "), "resolved_package_id", F.lit(" ("), "resolution", F.lit(")")))
    shared = several.select(*line("dependency", F.col("consumer_package_id"), F.concat("consumer_package_id", F.lit(" depends on "), "dep_name", F.lit(", which names several packages; "), end)))
    none = a.t["repos"].sparkSession.createDataFrame([("age", "policy", "the minimum age is 0: symbols of any age can go")] if days == 0 else [], "kind string, subject string, text string")
    return none.unionByName(age).unionByName(unread).unionByName(out).unionByName(ignored).unionByName(shared)


def write_report(a: Analysis, findings: DataFrame, path: str) -> None:
    """Sections as datasets under ``path``; rows of a section in a total order."""
    rows = finding_rows(a, findings)
    order = ["package_id", "file", "line", "col", "symbol", "verdict"]
    view_rows(rows).orderBy("view", *order).write.mode("overwrite").partitionBy("view").parquet(f"{path}/findings")
    for name, df in (("packages", package_counts(rows)), ("blockers", blockers(a, rows, None)), ("gaps", gap_names(a)), ("age", age_coverage(a)), ("reasons", reason_counts(rows)), ("warnings", warnings(a).orderBy("kind", "subject", "text"))):
        df.write.mode("overwrite").json(f"{path}/{name}")
    sarif_logs(a, rows).write.mode("overwrite").json(f"{path}/sarif")


def format_table(df: DataFrame, limit: int = 20, width: int = 40) -> str:
    """A small frame as aligned text; cells are cut at ``width``."""
    rows = [df.columns, *[["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]]
    cut = [[c if len(c) <= width else c[: width - 1] + "…" for c in r] for r in rows]
    wide = [max(len(r[k]) for r in cut) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in cut)
