"""The stages that a user runs, each from a folder of tables to a folder of tables.

A stage refuses to run before its predecessor: an analysis needs symbols, a witness a
marked analysis. What a stage writes is a new version beside its inputs, so a stage that
fails leaves what was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators import invariants, report, witness
from refloom.operators.analysis import Analysis, Policy
from refloom.operators.ingest import Ingest
from refloom.schema import TABLES
from refloom.sources.readers import read_tables

MARK = "run_params"


class StageOrder(RuntimeError):
    """A stage was run before the one it builds on."""


def ingest(spark: SparkSession, found: Ingest, others: dict[str, DataFrame], path: str) -> None:
    """Write the relations of ``found`` and the ``others`` (packages, dependencies, rules, ...) to ``path``; tables that nobody gives are empty."""
    tables = {name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items() if name != "findings"} | others | found.tables()
    for name, df in tables.items():
        if name in TABLES:
            wanted = spark.createDataFrame([], TABLES[name]).schema
            have = set(df.columns)
            df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]).write.mode("overwrite").parquet(f"{path}/{name}")


def _tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    tables = read_tables(spark, path, without=("findings",))
    if tables["symbols"].isEmpty():
        raise StageOrder(f"{path} holds no symbols: run the ingest first")
    return tables


def analyze(spark: SparkSession, path: str, policy: Policy) -> DataFrame:
    """Findings of the tables in ``path``, written to ``findings`` there and marked as analysed; returns counts by verdict."""
    a = Analysis(_tables(spark, path), policy)
    broken = invariants.violations(a, a.findings)
    if not broken.isEmpty():
        raise ValueError(f"integrity rules broken: {[tuple(r) for r in broken.limit(5).collect()]}")
    a.findings.write.mode("overwrite").parquet(f"{path}/findings")
    spark.createDataFrame([("analyzed_at", policy.now)], "key string, value long").write.mode("overwrite").parquet(f"{path}/{MARK}")
    return spark.read.parquet(f"{path}/findings").groupBy("verdict").agg(F.count("*").alias("n"))


def _analyzed(spark: SparkSession, path: str) -> None:
    try:
        marked = not spark.read.parquet(f"{path}/{MARK}").where("key = 'analyzed_at'").isEmpty()
    except Exception as missing:  # noqa: BLE001  Spark has one kind of error for a path that is not there
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        marked = False
    if not marked:
        raise StageOrder(f"{path} was not analysed: run the analysis first")


def check_by_text(spark: SparkSession, path: str, policy: Policy, files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """The text witness over an analysed folder: findings after it, written to ``witnessed`` and ``witness_ok`` there; returns counts by verdict."""
    tables = _tables(spark, path)
    _analyzed(spark, path)
    a = Analysis(tables, policy)
    findings, ok = witness.apply_witness(a, spark.read.schema(TABLES["findings"]).parquet(f"{path}/findings"), files, manifests)
    witness.propagate(a, findings).write.mode("overwrite").parquet(f"{path}/witnessed")
    ok.write.mode("overwrite").parquet(f"{path}/witness_checked")
    return spark.read.parquet(f"{path}/witnessed").groupBy("verdict").agg(F.count("*").alias("n"))


def write_report(spark: SparkSession, path: str, policy: Policy, out: str, source: str = "witnessed") -> None:
    """The report's datasets from ``source`` (``witnessed`` or ``findings``) of an analysed folder."""
    tables = _tables(spark, path)
    _analyzed(spark, path)
    report.write_report(Analysis(tables, policy), spark.read.schema(TABLES["findings"]).parquet(f"{path}/{source}"), out)
