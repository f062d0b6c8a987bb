"""Approximate nearest neighbours by inner product: a hash-prefix forest.

A tree is a sorted array of long hash strings (signs of random projections). A query
descends every tree to its longest matching prefix and then ascends all trees together,
one prefix length at a time, taking in the rows that share the shorter prefix, until the
chance that a row better than the k-th best found is still missing in every tree falls
under a limit. Rows in a dense neighbourhood stop early; rows without near neighbours
ascend far, up to the root (every row) if need be.

Rows are dealt into shards of bounded size by a hash of their id; every shard has its own
forest and answers every block of queries, which stream past it; the shards' best merge by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refloom.llm.common import table

K = 20
QUERY_EVERY = 20
TREES, BITS = 64, 24
#: Chance, under the projections' model, that a row as near as the k-th best found is still unseen.
MISS = 0.12
#: Rows of a shard, queries of a block, and queries answered at once (shards stay near their size by hashing).
SHARD_ROWS, BLOCK_QUERIES, CHUNK = 32_768, 2_048, 1_024
#: Shards times blocks at most: with more shards a block holds more queries, since each block builds its shards' forests.
TASKS = 20_000
SEED = 5


class Forest:
    """TREES sorted arrays over distinct vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = SEED):
        self.vectors = vectors
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.largest = float(norms.max()) if len(norms) else 1.0
        # one more coordinate makes all rows equally long, so angles rank by inner product
        rest = np.sqrt(np.maximum(0.0, 1.0 - (norms / self.largest) ** 2))
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, TREES * BITS)).astype(np.float32)
        hashes = self.hash(np.column_stack((vectors / self.largest, rest)))
        self.order = np.argsort(hashes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(hashes, self.order, 1)

    def hash(self, points: np.ndarray) -> np.ndarray:
        """BITS-bit strings as numbers, a row of them for each tree."""
        out = np.zeros((TREES, len(points)), dtype=np.int64)
        for a in range(0, len(points), 2048):
            signs = (points[a : a + 2048].astype(np.float32) @ self.planes > 0).reshape(-1, TREES, BITS)
            for b in range(BITS):
                out[:, a : a + 2048] = out[:, a : a + 2048] << 1 | signs[:, :, b].T
        return out

    def ranges(self, points: np.ndarray) -> np.ndarray:
        """Where the rows with each query's prefix lie: (query, prefix length, tree, first or one past last)."""
        hashes = self.hash(points)
        out = np.empty((len(points), BITS + 1, TREES, 2), dtype=np.int32)
        for t in range(TREES):
            for length in range(BITS + 1):
                first = hashes[t] >> (BITS - length) << (BITS - length)
                out[:, length, t, 0] = np.searchsorted(self.sorted[t], first)
                out[:, length, t, 1] = np.searchsorted(self.sorted[t], first + (1 << (BITS - length)))
        return out

    def search(self, query: np.ndarray, ranges: np.ndarray, need: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows found and their inner products; ``held`` says how many ids each row stands for."""
        n, norm = len(self.vectors), float(np.sqrt(query @ query))
        seen, old = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        entries = (ranges[:, :, 1] - ranges[:, :, 0]).sum(axis=1)
        low, high, taken = ranges[BITS, :, 0].tolist(), ranges[BITS, :, 0].tolist(), 0
        for length in range(BITS, -1, -1):
            if length and entries[length] < max(need, 1.2 * taken):
                continue  # nothing or little new: ascend further before looking
            taken = int(entries[length])
            bounds = ranges[length].tolist()
            for t in range(TREES):
                (a, b), order = bounds[t], self.order[t]
                if a < low[t]:
                    seen[order[a : low[t]]] = True
                if b > high[t]:
                    seen[order[high[t] : b]] = True
                low[t], high[t] = min(a, low[t]), max(b, high[t])
            new = np.flatnonzero(seen & ~old)
            old[new] = True
            rows = np.concatenate((rows, new))
            scores = np.concatenate((scores, self.vectors[new] @ query))
            if len(rows) == n:
                break
            if len(rows) >= need:
                kth = np.partition(scores, len(scores) - need)[len(scores) - need]
            elif int(held[rows].sum()) >= need:
                kth = scores.min()
            else:
                continue
            same = 1 - math.acos(max(-1.0, min(1.0, kth / (norm * self.largest)))) / math.pi
            if (1 - same**length) ** TREES <= MISS:
                break
        return rows, scores


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Double-precision inner products, each row summed alike wherever it lies."""
    return np.array([math.fsum(x) for x in (vectors * query).tolist()])


def _matrix(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = part.column("id").to_numpy()
    flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def _distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct vector, and which one each row is."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, which = np.unique(raw, return_index=True, return_inverse=True)
    return first, which


class Shard:
    """A shard's forest and the ids that each distinct vector stands for (the k + 1 smallest)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seed: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order] + 0.0  # no negative zeros
        first, which = _distinct(vectors)
        members = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[members], np.arange(len(first) + 1))
        self.k = k
        self.owned = [np.unique(ids[members[a:b]])[: k + 1] for a, b in zip(ends, ends[1:])]
        self.held = np.array([len(o) for o in self.owned])
        self.forest = Forest(vectors[first], seed)

    def answers(self, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        """query_id, vec_id, score of each query's k best here."""
        first, which = _distinct(vectors + 0.0)
        points, need = vectors[first], self.k + 1
        lengths = np.sqrt((points * points).sum(axis=1, keepdims=True))
        ranges = self.forest.ranges(np.column_stack((points / lengths, np.zeros(len(points)))))
        best = []
        for i in range(len(points)):
            found, scores = self.forest.search(points[i], ranges[i], need, self.held)
            if len(found) > need:  # the exact sums decide among all that rounding may have swapped
                cut = np.partition(scores, len(scores) - need)[len(scores) - need]
                found = found[scores >= cut - 1e-9 * max(1.0, abs(float(cut)))]
            exact = _exact(self.forest.vectors[found], points[i])
            best.append(sorted((-s, int(o)) for s, f in zip(exact, found) for o in self.owned[f])[:need])
        out = [(int(q), v, -s) for q, w in zip(ids, which) for s, v in [p for p in best[w] if p[1] != q][: self.k]]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, _FOUND)], schema=_FOUND)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(column: str) -> F.Column:
    """Not null, not zero, only finite components."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, trees_seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of largest inner product found, itself left out.

    Defined cases: vectors that are null, zero or not finite take no part, nor do null ids;
    vectors of different length are never compared; fewer rows than k give all; ties go to
    the smaller id; rows with equal id and vector count once; an empty table gives an empty
    table. A vector that a third of all rows repeat is one entry of its shard, standing for
    its k + 1 smallest ids, which no exact answer can exceed.
    """
    as_double = F.transform(vector_col, lambda x: x.cast("double"))
    shape = [F.size("v").alias("d"), "id", "v"]
    good = rows.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), as_double.alias("v"))
    asked = queries.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), as_double.alias("v"))
    n, m = good.count(), asked.count()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    blocks = max(1, min(math.ceil(m / BLOCK_QUERIES), TASKS // shards))
    every = lambda upto: F.explode(F.sequence(F.lit(0), F.lit(upto - 1)))
    left = good.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), F.lit(0).alias("kind"), *shape)
    right = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), *shape)
    group = ["shard", "block", "d"]
    dealt = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in (*group, "kind")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *own, kind = marks[:, a].tolist()
                if own != key:
                    key, held, shard = own, [], None
                part = batch.slice(a, b - a)
                if not kind:
                    held.append(part)
                elif held:
                    if shard is None:
                        shard, held = Shard(*_matrix(pa.Table.from_batches(held)), k, trees_seed), held[:1]
                    for c in range(0, len(part), CHUNK):
                        yield shard.answers(*_matrix(pa.Table.from_batches([part.slice(c, CHUNK)])))

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))
