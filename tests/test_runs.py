"""Runs that recompute what changed and move a pointer last."""

import pytest
from pyspark.sql import functions as F

from refloom.operators.runs import Runs, package_digests

SCHEMA = "package_id string, x int, t string"


def test_digests_tell_contents_and_not_order(spark):
    a = spark.createDataFrame([("p", 1, "a"), ("p", 2, None), ("q", 1, "")], SCHEMA)
    base = {r["package_id"]: r["digest"] for r in package_digests(a, a).collect()}
    other = lambda rows: {r["package_id"]: r["digest"] for r in package_digests(spark.createDataFrame(rows, SCHEMA).repartition(3), a).collect()}
    assert other([("q", 1, ""), ("p", 2, None), ("p", 1, "a")]) == base
    for rows in ([("p", 1, "a"), ("q", 1, "")], [("p", 1, "a"), ("p", 2, None), ("p", 2, None), ("q", 1, "")], [("p", 1, "a"), ("p", 2, ""), ("q", 1, "")]):
        got = other(rows)
        assert got["p"] != base["p"] and got["q"] == base["q"]


def test_only_changed_packages_are_read_and_a_failed_run_leaves_the_old(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "out"))
    assert runs.current is None and runs.packages().count() == 0
    read = []

    def step(rows, fail=False):
        df = spark.createDataFrame(rows, SCHEMA)

        def build(changed):
            mine = df.join(changed, "package_id", "left_semi")
            read.append(sorted(r["package_id"] for r in changed.collect()))
            if fail:
                mine = mine.withColumn("x", F.expr("raise_error('stopped')").cast("int"))
            return {"sums": mine.groupBy("package_id").agg(F.sum("x").alias("s")), "rows": mine}

        return sorted(r["package_id"] for r in runs.update(package_digests(df), build).collect())

    sums = lambda: {r["package_id"]: r["s"] for r in runs.read("sums").collect()}
    first = [("p", 1, "a"), ("p", 2, "b"), ("q", 5, "c"), ("r", 7, "d")]
    assert step(first) == ["p", "q", "r"] and sums() == {"p": 3, "q": 5, "r": 7}
    one = runs.current
    assert step(first) == [] and runs.current == one and len(read) == 1  # the same inputs are the same run
    with pytest.raises(Exception, match="stopped"):
        step([*first[:2], ("q", 6, "c"), first[3]], fail=True)
    assert runs.current == one and sums() == {"p": 3, "q": 5, "r": 7}
    assert step([*first[:2], ("q", 6, "c"), ("s", 1, "e")]) == ["q", "s"] and read[-1] == ["q", "s"]  # r is gone
    assert sums() == {"p": 3, "q": 6, "s": 1} and runs.read("rows").count() == 4
    assert step(first) == ["q", "r"] and runs.current != one and sums() == {"p": 3, "q": 5, "r": 7}  # back to what was
    assert runs.current.split("-")[0] == one.split("-")[0] and {r["package_id"] for r in runs.packages().where(F.col("held_in") == one).collect()} == {"p"}
