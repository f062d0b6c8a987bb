"""Materialised relations: Parquet in the shared folder that the session names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="refloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read back: recursion results are used by many relations and must not be recomputed."""
    path = f"{shared_dir(df.sparkSession)}/rel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialize`` and how many rows met each condition (``rows``: all), counted while they are written."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in conditions.items())]
    out = materialize(df.observe(seen, *counts))
    return out, seen.get


def refuse_clashes(df: DataFrame, hashed: str, text: str) -> None:
    """An error where two values of ``text`` share a hash."""
    clash = df.groupBy(hashed).agg(F.count("*").alias("n"), F.min(text).alias("a"), F.max(text).alias("b")).where("n > 1").first()
    if clash is not None:
        raise ValueError(f"two keys have one id: {clash['a']} and {clash['b']}")
