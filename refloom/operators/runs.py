"""Runs over packages of which few change: results by input digest, a pointer that moves last.

Under ``root`` every run adds one folder to each result table (``<table>/run=<name>``) with the
rows of the packages that it computed, and one to ``packages``: for every package the digest of
its inputs and the run that holds its rows. ``pointer`` gets a row once all that stands. So a
run that fails leaves what was there, nothing is rewritten, and a package whose digest has not
changed is neither read nor computed again; its rows stay in the run that made them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_POINTER = "run string, moved long"
_PACKAGES = "package_id string, digest string, held_in string"


def package_digests(*inputs: DataFrame) -> DataFrame:
    """package_id, digest of the rows (in any order, repeats count) that each of ``inputs`` (with package_id) holds of a package.

    A table's rows are counted and two independent hashes of them added up, which combines before
    the shuffle, so a package of very many rows is a few numbers of each task.
    """
    parts = []
    for k, df in enumerate(inputs):
        row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != "package_id"]), {"ignoreNullFields": "false"})
        hashed = df.select("package_id", F.xxhash64(row).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(k), row).cast("decimal(38,0)").alias("b"))
        parts.append(hashed.groupBy("package_id").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("input", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    each = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("input", "n", "a", "b"))), lambda s: F.concat_ws(":", s["input"], s["n"], s["a"], s["b"])), "|")
    return out.groupBy("package_id").agg(F.sha2(each, 256).alias("digest"))


class Runs:
    """The results under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def current(self) -> str | None:
        """The run that the pointer shows."""
        last = self._read("pointer", _POINTER).orderBy(F.desc("moved"), F.desc("run")).first()
        return None if last is None else last["run"]

    def packages(self) -> DataFrame:
        """package_id, digest, held_in of the current run."""
        run = self.current
        return self.spark.createDataFrame([], _PACKAGES) if run is None else self.spark.read.schema(_PACKAGES).parquet(f"{self.root}/packages/run={run}")

    def read(self, name: str) -> DataFrame:
        """A result table of the current run: every package's rows from the run that computed them."""
        held = self.packages().select("package_id", F.col("held_in").alias("run"))
        return self.spark.read.parquet(f"{self.root}/{name}").join(held, ["package_id", "run"], "left_semi").drop("run")

    def update(self, digests: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
        """Moves to a run of the packages in ``digests``; returns package_id of those computed.

        ``build`` gets the packages (package_id) that are new or have changed, and returns result
        tables, each with package_id, of these alone. The run is named by the digest of all
        inputs and how often the pointer has moved; if the current one has these inputs nothing is done.
        """
        known = self.packages()
        whole = digests.agg(F.count("*").alias("n"), F.sum(F.xxhash64("package_id", "digest").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "package_id", "digest").cast("decimal(38,0)")).alias("b")).first()
        name_, current = hashlib.sha256(str(tuple(whole)).encode()).hexdigest()[:24], self.current
        moved = (self._read("pointer", _POINTER).agg(F.max("moved")).first()[0] or 0) + 1
        # earlier runs' folders may hold rows that are still in use: the same inputs after others get a folder of their own
        run = f"{name_}-{moved}"
        same = digests.join(known, ["package_id", "digest"])
        changed = digests.join(same.select("package_id"), "package_id", "left_anti").select("package_id")
        if current is not None and current.startswith(f"{name_}-"):
            return changed
        for name, table in build(changed).items():
            table.join(changed, "package_id", "left_semi").write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")
        listed = same.select("package_id", "digest", "held_in").unionByName(digests.join(changed, "package_id", "left_semi").select("package_id", "digest", F.lit(run).alias("held_in")))
        listed.write.mode("overwrite").parquet(f"{self.root}/packages/run={run}")
        self.spark.createDataFrame([(run, moved)], _POINTER).write.mode("append").parquet(f"{self.root}/pointer")
        return self.spark.read.schema(_PACKAGES).parquet(f"{self.root}/packages/run={run}").where(F.col("held_in") == run).select("package_id")
