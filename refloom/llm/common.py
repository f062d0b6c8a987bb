"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refloom.storage import shared_dir

#: White space between words, as a regular-expression class body and as characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"

#: Null ids sort after every real id.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stages written since the outermost ``spent_stages`` began: schema and path.
_made: list[list[tuple[StructType, str]]] = []


def stage(df: DataFrame, file_rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs only the tasks it ran; the columnar copy also gives
    the planner true sizes and pruned reads. Readers hold up to 4096 rows of a file at once, so
    where a row is large ``file_rows`` bounds the rows of a file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    (df.write if file_rows is None else df.write.option("maxRecordsPerFile", file_rows)).parquet(path)
    for made in _made:
        made.append((df.schema, path))
    return spark.read.schema(df.schema).parquet(path)


def counted_stage(df: DataFrame) -> tuple[DataFrame, int]:
    """``stage`` and the number of rows written, counted while they are written (a task that runs again may count twice; none stays none)."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


@contextlib.contextmanager
def spent_stages(spark: SparkSession):
    """Empties, on leaving, the stages written inside but for the last one (the result)."""
    _made.append([])
    try:
        yield
    finally:
        for schema, path in _made.pop()[:-1]:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of at most ``size`` for Python: long texts would make the default's 64 MB of each task too much.

    Holds for what is run inside; the caller's setting returns on leaving.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def id_key(column: str) -> Column:
    """The id as a long that is never null (null ids sort last)."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, grown until no column of ``df`` begins with it (names compare without case)."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix
