"""Incremental analysis: index files that arrive rebuild only the packages they touch.

Reachability never leaves a package, so replacing a package's rows and recomputing from
the replaced tables is sound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from refloom.operators.analysis import anti


def replace_packages(current: DataFrame, arrived: DataFrame, key: str = "package_id") -> DataFrame:
    """Rows of packages that arrived replace the rows those packages had."""
    return anti(current, arrived.select(key).distinct(), key).unionByName(arrived, allowMissingColumns=True)


def watch(spark: SparkSession, path: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``apply(batch, batch_id)`` for index files as they arrive; restarts go on where the checkpoint stands."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
