"""Names that a package's own sources quote: in code that they generate, and in strings that may end up in such code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions import globs
from refloom.functions.literals import literals_udf
from refloom.operators.analysis import Analysis, anti
from refloom.storage import materialize

CODE_FILE = r"\.(?:[cm]?[jt]sx?|dart)$"


def quoted_hits(a: Analysis, names: DataFrame, files: DataFrame) -> DataFrame:
    """symbol_id, package_id (``self`` or ``self-string``), file, line of literals that quote a name of ``names`` (symbol_id, target_package_id, token).

    ``self``: generated code that names the package itself and, within it, the symbol.
    ``self-string``: a literal, no message, that has the name in an import clause, or anywhere
    if the package generates code at all; not on the line of the symbol's definition. Only the
    package's own code files that are no tests and not generated are read; each literal is
    indexed once by its words, which meet the names in equi joins.
    """
    p = a.t["packages"].select("package_id", "manager", "name")
    of = names.select(F.col("target_package_id").alias("package_id"), "symbol_id", "token").distinct()
    own = files.where(F.col("text").isNotNull() & F.col("file").rlike(CODE_FILE)).join(of.select("package_id").distinct(), "package_id", "left_semi")
    own = anti(anti(own, a.test_files, ["package_id", "file"]), a.generated_files, ["package_id", "file"]).where(~globs.matches(F.col("file"), globs.TEST_GLOBS))
    lits = own.select("package_id", "file", F.explode(literals_udf("text", "file")).alias("l")).select("package_id", "file", "l.*")
    lits = materialize(lits)
    # the package as a whole specifier, no part of a longer name
    quoted = F.concat(F.lit(r"\Q"), "name", F.lit(r"\E"))
    named = F.when(F.col("manager") == "pub", F.concat(F.lit("package:"), quoted, F.lit(r"(?!\w)"))).otherwise(F.concat(F.lit(r"(?<![\w@./-])"), quoted, F.lit(r"(?![\w.-])")))
    made = lits.where("generated").join(p, "package_id").where(F.regexp_like("text", named)).select("package_id", "file", F.inline("made"))
    hits = made.join(of, ["package_id", "token"]).select("symbol_id", F.lit("self").alias("package_id"), "file", "line")
    builds = lits.where("generated").select("package_id", F.lit(True).alias("builds")).distinct()
    words = lits.where("not message").select("package_id", "file", F.inline("quoted")).join(builds, "package_id", "left")
    words = words.withColumn("at", F.coalesce("clause_line", F.when(F.col("builds"), F.col("line")))).where("at is not null").drop("line")
    place = a.t["symbols"].select("symbol_id", F.col("file").alias("own_file"), (F.col("line") + 1).alias("own_line"))
    strings = words.join(of, ["package_id", "token"]).join(place, "symbol_id").where(~((F.col("file") == F.col("own_file")) & F.col("at").eqNullSafe(F.col("own_line"))))
    return hits.unionByName(strings.select("symbol_id", F.lit("self-string").alias("package_id"), "file", F.col("at").alias("line"))).distinct()
