"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows with all their terms; inverse document
frequencies count all documents, and a term weighs more the better it tells the classes
apart (by 1 + chi-square, so none weighs nothing). Each term has a posting list in blocks of examples that know
their largest weight, so a block whose best possible cosine cannot reach a text's k-th best is
skipped without losing exactness. Votes weigh by similarity and undo the sample's class
balance; the nearest examples are the evidence.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import table
from refloom.llm.quality_classifier import fold

#: Examples of each class at most (the smallest by a hash of the id), examples in a block, neighbours.
MAX_EXAMPLES, BLOCK, K = 2_000, 32, 8
#: Rows of example texts at most (ids may repeat with other texts), the first by a hash of the id, then by contents.
EXAMPLE_ROWS = 4 * MAX_EXAMPLES
#: Blocks scored before any is skipped. Terms that one example in so many has are rows of a matrix instead of posting lists.
FIRST, DENSE = 4, 8
#: A vote weighs the cosine to this power; votes of the base rate, in neighbours.
POWER, PRIOR = 3, 0.5
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def count_terms(vocabulary: dict[str, int], text: str | None) -> Counter:
    return Counter(k for k in map(vocabulary.get, words(text)) if k is not None)


def _pair(counts) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their counts as arrays, from a dictionary or as they are."""
    if isinstance(counts, tuple):
        return counts
    return np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a[0], ..., b[0] - 1, a[1], ..."""
    n = b - a
    ends = np.cumsum(n)
    return np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Unit TF-IDF vectors of the examples as posting lists in blocks, with each block's largest weights.

    Lists of very common terms would be nearly as long as the examples, so those are rows of a
    matrix, multiplied for many queries at once; a block's bound adds up what the matrix gives its
    examples exactly and the lists' largest weights.
    """

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, counts: list, weights: tuple[float, float]):
        self.vocabulary, self.idf = vocabulary, idf
        found = [self.unit(c) for c in counts]
        full = np.array([len(t) > 0 for t, _ in found], bool)
        label_weight = np.where(labels == 1, weights[1], weights[0])
        none = ~full
        toxic = float((label_weight * labels).sum())
        #: Rate among all examples and among those without any term.
        self.rate = toxic / max(float(label_weight.sum()), 1e-9) if len(labels) else 0.0
        self.bare_rate = (float((label_weight * labels)[none].sum()) + self.rate) / (float(label_weight[none].sum()) + 1.0)
        found, ids, labels, label_weight = [v for v in found if len(v[0])], ids[full], labels[full], label_weight[full]
        order = np.lexsort((ids, labels, np.array([t[w.argmax()] for t, w in found], np.int64)))
        self.ids, self.labels, self.weight = ids[order], labels[order], label_weight[order]
        found = [found[k] for k in order]
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in found)])
        owner = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        values = np.concatenate([np.zeros(0), *(w for _, w in found)])
        common = np.flatnonzero(np.bincount(terms, minlength=len(idf)) * DENSE > len(found))
        #: Row of each common term in the matrix (-1: it has posting lists).
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        held = self.row[terms] >= 0
        self.matrix = np.zeros((len(common), len(found)))
        self.matrix[self.row[terms[held]], owner[held]] = values[held]
        terms, owner, values = terms[~held], owner[~held], values[~held]
        o = np.lexsort((owner, terms))
        terms, block = terms[o], owner[o] // BLOCK
        self.owner, self.value = owner[o].astype(np.int32), values[o]
        new = np.ones(len(o), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        #: Of each term's part in a block: its postings, block and largest weight; of each term: its parts.
        self.starts, self.block = np.append(at, len(o)), block[at]
        self.best = np.maximum.reduceat(self.value, at) if len(at) else np.zeros(0)
        self.parts = np.searchsorted(terms[at], np.arange(len(idf) + 1))
        self.blocks = -(-len(found) // BLOCK)

    def unit(self, counts) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of length 1."""
        at, n = _pair(counts)
        w = (1 + np.log(n)) * self.idf[at]
        return at, w / np.sqrt((w * w).sum()) if len(w) else w

    def vector(self, counts) -> np.ndarray:
        out = np.zeros(len(self.idf))
        at, w = self.unit(counts)
        out[at] = w
        return out

    @property
    def vectors(self) -> np.ndarray:
        """The examples as a full matrix (for small indexes)."""
        out = np.zeros((len(self.ids), len(self.idf)))
        part = np.repeat(np.arange(len(self.idf)), np.diff(self.parts))
        out[self.owner, np.repeat(part, np.diff(self.starts))] = self.value
        out[:, np.flatnonzero(self.row >= 0)] = self.matrix.T
        return out

    def _cosines(self, terms: np.ndarray, weights: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Cosines with the examples, of which ``common`` is the common terms' part; exact where they can be among the K largest, else 0."""
        listed = self.row[terms] < 0
        terms, weights = terms[listed], weights[listed]
        a, b = self.parts[terms], self.parts[terms + 1]
        part, q = _ranges(a, b), np.repeat(weights, b - a)
        block = self.block[part]
        bound = np.bincount(block, self.best[part] * q, minlength=self.blocks) + np.maximum.reduceat(common, np.arange(0, len(common), BLOCK))

        def scored(chosen: np.ndarray) -> np.ndarray:
            held = chosen[block]
            a, b = self.starts[part[held]], self.starts[part[held] + 1]
            at = _ranges(a, b)
            lists = np.bincount(self.owner[at], self.value[at] * np.repeat(q[held], b - a), minlength=len(self.ids))
            return np.where(np.repeat(chosen, BLOCK)[: len(self.ids)], lists + common, 0.0)

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[:FIRST]] = True
        out = scored(first)
        least = np.partition(out, -K)[-K] if len(out) >= K else 0.0
        rest = ~first & (bound > 0) & (bound > least - 1e-9)
        return out + scored(rest) if rest.any() else out

    def nearest(self, queries) -> tuple[np.ndarray, np.ndarray]:
        """The K largest cosines of each unit query (terms and weights, or a row of a matrix) and their examples (-1: none), exactly."""
        n = len(queries)
        cosines, found = np.zeros((n, K)), np.full((n, K), -1)
        if not self.blocks:
            return cosines, found
        queries = [q if isinstance(q, tuple) else (np.flatnonzero(q), q[np.flatnonzero(q)]) for q in queries]
        weights = np.zeros((n, len(self.matrix)))
        for i, (terms, w) in enumerate(queries):
            row = self.row[terms]
            weights[i, row[row >= 0]] = w[row >= 0]
        common = weights @ self.matrix
        for i, query in enumerate(queries):
            all_ = self._cosines(*query, common[i])
            least = np.partition(all_, -K)[-K] if len(all_) >= K else 0.0
            near = np.flatnonzero((all_ >= least) & (all_ > 1e-12))
            near = near[np.argsort(-all_[near], kind="stable")[:K]]
            cosines[i, : len(near)], found[i, : len(near)] = all_[near], near
        return cosines, found

    def score(self, batch: list[dict[int, int]]) -> tuple[np.ndarray, list[list[int]]]:
        """Scores and the ids of up to three nearest examples as evidence."""
        scores, evidence = np.full(len(batch), self.bare_rate), [[] for _ in batch]
        rows = [i for i, c in enumerate(batch) if c]
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            cosines, found = self.nearest([self.unit(batch[i]) for i in part])
            hit = found >= 0
            vote = np.where(hit, cosines**POWER * self.weight[found], 0.0) if len(self.weight) else np.zeros_like(cosines)
            yes = np.where(hit, self.labels[found], 0) if len(self.labels) else np.zeros_like(vote)
            total = vote.sum(axis=1)
            scores[part] = np.where(hit.any(axis=1), ((vote * yes).sum(axis=1) + PRIOR * self.rate * self.rate) / (total + PRIOR * self.rate), self.bare_rate)
            for i, ids in zip(part, found[:, :3]):
                evidence[i] = [int(self.ids[k]) for k in ids if k >= 0]
        return np.clip(scores, 0.0, 1.0), evidence


def build(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Index:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT))
    known = known.select(F.col(id_col).alias("tx_id"), F.col(label_col).cast("int").alias("tx_y"))
    sizes = {r["tx_y"]: r["n"] for r in known.groupBy("tx_y").agg(F.count("*").alias("n")).where("tx_y in (0, 1)").collect()}
    parts = [known.where(F.col("tx_y") == y).orderBy(F.xxhash64("tx_id"), "tx_id").limit(MAX_EXAMPLES) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("tx_doc"), F.col(text_col).cast("string").alias("tx_text"))
    # the sample's bound is proven: twice MAX_EXAMPLES ids
    examples = texts.join(F.broadcast(sample), F.col("tx_doc") == F.col("tx_id")).select(F.col("tx_id").cast("long").alias("tx_id"), "tx_y", "tx_text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words(t)) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                names=["i", "y", "w", "c"],
            )

    # bounded by EXAMPLE_ROWS, in a fixed order: the distinct words of the sampled examples, kept as Arrow columns
    held = examples.mapInArrow(counted, "i long, y int, w array<string>, c array<long>")
    held = held.orderBy(F.xxhash64("i"), "i", "y", "w", "c").limit(EXAMPLE_ROWS).toArrow().combine_chunks()
    ids, ys = (held.column(c).to_numpy().astype(np.int64) for c in ("i", "y"))
    sizes_ = pc.list_value_length(held.column("w")).to_numpy().astype(np.int64)
    flat = pc.list_flatten(held.column("w")).combine_chunks().dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    order = pc.sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    terms, n = rank[flat.indices.to_numpy()], pc.list_flatten(held.column("c")).to_numpy().astype(np.float64)
    vocabulary = {w: k for k, w in enumerate(flat.dictionary.take(pa.array(order)).to_pylist())}
    ends = np.cumsum(sizes_)
    counts = [(terms[b - z : b], n[b - z : b]) for b, z in zip(ends, sizes_)]
    at = np.lexsort((ys, ids))
    n0, n1 = (float(min(sizes.get(y, 0), MAX_EXAMPLES)) for y in (0, 1))
    weights = tuple(sizes.get(y, 0) / max(1.0, n) for y, n in ((0, n0), (1, n1)))
    term_weights = _idf(texts, vocabulary) * (1 + _chi_square(counts, ys, len(vocabulary)))
    return Index(vocabulary, term_weights, ids[at], ys[at], [counts[k] for k in at], weights)


def _chi_square(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int) -> np.ndarray:
    """Of each term's presence in the examples with their class (0 where only one class is there)."""
    held = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for (t, _), l in zip(counts, labels) if l == y)]), minlength=size).astype(float) for y in (0, 1)]
    n0, n1 = (float((labels == y).sum()) for y in (0, 1))
    both = held[0] + held[1]
    under = n0 * n1 * both * (n0 + n1 - both)
    return np.where(under > 0, (n0 + n1) * (held[1] * (n0 - held[0]) - held[0] * (n1 - held[1])) ** 2 / np.maximum(under, 1.0), 0.0)


def _idf(texts: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """Inverse document frequencies of the vocabulary over all ``texts``."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, n = shared.value, 0, Counter()
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                n.update(own.keys() & set(words(text)))
        at, counts = [own[w] for w in n], list(n.values())
        yield pa.record_batch([pa.array([*at, -1], pa.int64()), pa.array([*counts, rows], pa.int64())], names=["k", "n"])

    found = texts.select("tx_text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = (found.column(c).to_numpy().astype(np.int64) for c in ("k", "n"))
    held = np.zeros(len(vocabulary))
    held[k[k >= 0]] = n[k >= 0]
    return np.log(1 + float(n[k < 0].sum()) / (1 + held))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of nearest examples) per row of ``docs``.

    Whole texts are read. Labels of held-out ids never become examples.

    Defined cases: a text without any index term (null and empty ones too) scores the rate
    of such examples; a null id is not held out; null labels teach nothing; without labels
    all scores are 0; an empty table gives an empty table; rows with equal id are scored each for itself.
    """
    index = build(docs, labels, id_col, text_col, label_col)
    # bounded: the terms of twice MAX_EXAMPLES texts; pickled by value, for executors have no copy of the package
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            counts = [count_terms(own.vocabulary, t) for t in batch.column(2).to_pylist()]
            score, evidence = own.score(counts)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    held = F.coalesce(fold(id_col, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
