"""Uses between packages of two managers in one repository: code compiled from one language that the other calls by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions import globs
from refloom.functions.source_text import searched_text_udf
from refloom.operators.analysis import Analysis, marked
from refloom.storage import materialize

# What tells that Dart code calls JavaScript by name, and that it hands itself to JavaScript by name.
CALLS_JS = r"""@JS\s*\(|\b(?:import|export)\s+['"](?:dart:js|dart:html|package:js/)"""
GIVEN_TO_JS = r"@JSExport\b|\bcreateJSInteropWrapper\b|\bcreateDartExport\b"
SCRIPT, DART = r"\.[cm]?[jt]sx?$", r"\.dart$"


def crossing_hits(a: Analysis, names: DataFrame, files: DataFrame) -> DataFrame:
    """symbol_id, package_id, file, line of code in another manager's package of the same repository that names a symbol.

    ``names``: symbol_id, target_package_id, token; ``files``: package_id, file, text (null: could
    not be read, which counts as a use at line 0). No import tells such a use, so neither
    specifiers nor the index are asked: any whole identifier outside comments counts, in strings
    too. A Dart file counts only if it calls JavaScript; JavaScript counts only for symbols
    whose own file is handed to it (or cannot be read). Test files count for test support only.
    """
    p = a.t["packages"].select("package_id", "repo", "manager")
    place = a.t["symbols"].select("symbol_id", F.col("file").alias("own_file"))
    of = names.select("symbol_id", "target_package_id", "token").distinct().join(place, "symbol_id")
    of = of.join(p.select(F.col("package_id").alias("target_package_id"), "repo", F.col("manager").alias("target_manager")), "target_package_id")
    bare = searched_text_udf(F.coalesce("text", F.lit("")), "file", F.lit(False), F.lit(True))["text"]
    code = files.join(p, "package_id").where(F.when(F.col("manager") == "pub", F.col("file").rlike(DART)).otherwise(F.col("file").rlike(SCRIPT)))
    code = materialize(code.withColumn("text", F.when(F.col("text").isNotNull(), bare)))
    given = code.where((F.col("manager") == "pub") & (F.col("text").isNull() | F.col("text").rlike(GIVEN_TO_JS))).select(F.col("package_id").alias("target_package_id"), F.col("file").alias("own_file")).distinct()
    of = marked(of, given, ["target_package_id", "own_file"], "given").where("target_manager = 'npm' or given")
    of = materialize(marked(of, a.test_support_symbols, ["symbol_id"], "support"))
    tests = a.test_files.unionByName(code.where(globs.matches(F.col("file"), globs.TEST_GLOBS)).select("package_id", "file")).distinct()
    code = marked(code.where("text is null or manager <> 'pub' or text rlike '" + CALLS_JS.replace("\\", "\\\\").replace("'", "\\'") + "'"), tests, ["package_id", "file"], "in_test")
    words = code.where("text is not null").select("repo", "manager", "package_id", "file", "in_test", F.posexplode(F.split("text", "\n")).alias("at", "row"))
    words = words.select("repo", "manager", "package_id", "file", "in_test", (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("row", F.lit(r"([\w$]+)"), F.lit(1)))).alias("token"))
    across = F.col("manager") != F.col("target_manager")
    hits = words.join(of, ["repo", "token"]).where(across)
    unread = code.where("text is null").select("repo", "manager", "package_id", "file", "in_test", F.lit(0).alias("line")).join(of, "repo").where(across)
    columns = ["symbol_id", "package_id", "file", "line", "in_test", "support"]
    return hits.select(*columns).unionByName(unread.select(*columns)).where("not in_test or support").select("symbol_id", "package_id", "file", "line").distinct()
