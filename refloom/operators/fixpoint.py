"""Recursive relations with set semantics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.storage import materialize, materialize_counted

#: A package with more edges than this is walked by distributed rounds instead of in one task.
PACKAGE_EDGES = 500_000


#: Written parts of equal age that are merged into one.
MERGED = 4


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Least set that holds ``seed`` and is closed under ``step`` (semi-naive rounds).

    Each round joins only the rows that the last one added, drops what is known by an anti
    join and writes the rest. What is known lies in parts; as soon as MERGED parts have taken in
    equally many rounds they are written as one. So after n rounds the anti join reads some
    log n tables, each row is rewritten some log n times, and plans and lineage do not grow
    with the rounds. Cycles end because nothing new appears.
    """
    columns = seed.columns
    frontier, counts = materialize_counted(seed.distinct())
    parts = [(0, frontier)]
    while counts["rows"]:
        new = step(frontier).select(*columns).distinct().join(_union(parts), columns, "left_anti")
        frontier, counts = materialize_counted(new)
        parts.append((0, frontier))
        while len(parts) >= MERGED and len({age for age, _ in parts[-MERGED:]}) == 1:
            parts[-MERGED:] = [(parts[-1][0] + 1, materialize(_union(parts[-MERGED:])))]
    return _union(parts)


def _union(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df for _, df in parts))


def _walk(src: np.ndarray, dst: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Nodes that breadth-first search reaches from the seeds."""
    nodes, index = np.unique(np.concatenate((src, dst, seeds)), return_inverse=True)
    a, b, start = np.split(index, (len(src), len(src) + len(dst)))
    order = np.argsort(a, kind="stable")
    b, first = b[order], np.searchsorted(a[order], np.arange(len(nodes) + 1))
    seen = np.zeros(len(nodes), bool)
    seen[start] = True
    front = np.unique(start)
    while len(front):
        counts = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        front = np.unique(b[at])
        front = front[~seen[front]]
        seen[front] = True
    return nodes[seen]


def wide_packages(edges: DataFrame) -> DataFrame | None:
    """pkg of packages with more than PACKAGE_EDGES edges; None if there are none."""
    found, counts = materialize_counted(edges.groupBy("pkg").agg(F.count("*").alias("n")).where(F.col("n") > PACKAGE_EDGES).select("pkg"))
    return found if counts["rows"] else None


def reach_by_package(edges: DataFrame, seeds: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """node long reached from ``seeds`` (pkg, node) over ``edges`` (pkg, src, dst) that never leave their package.

    One shuffle and no rounds, but for the packages in ``wide`` (see ``wide_packages``): those
    (a package may hold a third of all rows) take the distributed rounds of ``fixpoint``.
    """

    def reach(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = _walk(left["src"].to_numpy(), left["dst"].to_numpy(), right["node"].to_numpy()) if len(right) else np.zeros(0, np.int64)
        return pa.table({"node": pa.array(found, pa.int64())})

    small_edges = edges if wide is None else edges.join(wide, "pkg", "left_anti")
    small_seeds = seeds if wide is None else seeds.join(wide, "pkg", "left_anti")
    columns = ["pkg", "src", "dst"]
    out = small_edges.select(*columns).groupBy("pkg").cogroup(small_seeds.select("pkg", "node").groupBy("pkg")).applyInArrow(reach, "node long")
    if wide is not None:
        big = edges.join(wide, "pkg", "left_semi")
        rounds = fixpoint(
            seeds.join(wide, "pkg", "left_semi").select("node"),
            lambda front: front.join(big, front["node"] == big["src"]).select(F.col("dst").alias("node")),
        )
        out = out.unionByName(rounds)
    return out.distinct()
