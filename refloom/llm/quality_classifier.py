"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in the JVM within each row; trees are trained on a bounded sample
of labelled rows and flattened into arrays that numpy walks for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import table
from refloom.llm.quality_rules import MORE_STATS, STATS, document_stats

#: The classifier is fitted on at most so many labelled rows (the smallest by a hash of the id).
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_LEAF = 60, 4, 64, 0.15, 1.0, 20
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

COUNTS = (*STATS, *MORE_STATS)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row a document: sizes on a log scale and ratios."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_text_lines"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.column_stack(
        [
            np.log1p(c["n_words"]),
            np.log1p(c["n_text_lines"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_unique"] / words,
            c["n_upper"] / letters,
            (c["n_upper"] + c["n_lower"]) / np.maximum(c["word_chars"], 1),
            c["n_bangs"] / words,
            c["n_words"] / lines,
        ]
    )


class Forest:
    """Complete binary trees as arrays: node i has children 2i+1 and 2i+2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        margin = self.base + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosting on the logistic loss; splits are found on histograms of gradients."""
    n, width = x.shape if x.ndim == 2 else (0, 0)
    inner, none = 2**DEPTH - 1, np.zeros((0, 2**DEPTH - 1))
    rate = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(rate / (1 - rate)))
    if n < 2 * MIN_LEAF or y.min() == y.max():
        return Forest(base, none.astype(np.int64), none, np.zeros((0, 2**DEPTH)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    margin = np.full(n, base)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            at = node - first
            best = np.full(wide, 1e-9)
            total_g, total_h = np.bincount(at, g, wide), np.bincount(at, h, wide)
            for j in range(width):
                key = at * BINS + binned[:, j]
                hg, hh, hn = (np.bincount(key, w, wide * BINS).reshape(wide, BINS).cumsum(axis=1) for w in (g, h, np.ones(n)))
                rg, rh = total_g[:, None] - hg, total_h[:, None] - hh
                gain = hg**2 / (hh + L2) + rg**2 / (rh + L2) - (total_g**2 / (total_h + L2))[:, None]
                gain[(hn < MIN_LEAF) | (hn[:, -1:] - hn < MIN_LEAF)] = 0
                gain = gain[:, : len(cuts[j])]
                if not gain.size:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(wide), k]
                for i in np.flatnonzero(top > best):
                    best[i], feature[t, first + i], cut[t, first + i] = top[i], j, cuts[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        margin += leaf[t][at]
    return Forest(base, feature, cut, leaf)


def fold(id_col: str, folds: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``.

    Labels of held-out ids (crc32 of the id modulo FOLDS) are never read for training.

    Defined cases: null text scores as the empty text; a null id is not held out; null labels
    and labels of absent ids teach nothing; at most MAX_TRAIN labels and twice as many texts
    of them are read for training; with no labels every score is one half; an empty
    table gives an empty table; rows with equal id are scored each for itself.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, FOLDS) != HELD_OUT))
    sample = known.select(F.col(id_col).alias("qc_id"), F.col(label_col).cast("int").alias("qc_y")).orderBy(F.xxhash64("qc_id"), "qc_id").limit(MAX_TRAIN)
    # the sample's bound is proven: MAX_TRAIN ids and labels
    texts = docs.select(F.col(id_col).alias("qc_doc"), F.col(text_col).cast("string").alias("qc_text"))
    rows = texts.join(F.broadcast(sample), F.col("qc_doc") == F.col("qc_id")).select("qc_text", "qc_y", F.xxhash64("qc_id").alias("qc_at"), "qc_id", F.xxhash64("qc_text").alias("qc_of"))
    # a label whose id repeats teaches with each of its texts; their order is fixed, so runs agree
    train = document_stats(rows, "qc_text").select(*COUNTS, "qc_y", "qc_at", "qc_id", "qc_of").orderBy("qc_at", "qc_id", "qc_of").limit(2 * MAX_TRAIN).toPandas()
    forest = fit(features({c: train[c].to_numpy() for c in COUNTS}), train["qc_y"].to_numpy(dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(2 + k).to_numpy(zero_copy_only=False) for k, c in enumerate(COUNTS)}
            score = forest.score(features(counts))
            predicted = pa.array((score >= THRESHOLD).astype(np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), predicted], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold("qc_doc", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    stats = document_stats(texts.withColumn("qc_text", F.coalesce("qc_text", F.lit(""))), "qc_text").select(F.col("qc_doc").cast("long"), held, *COUNTS)
    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
