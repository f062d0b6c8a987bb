"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Two fingerprints differ in at most ``2 * HALF`` bits exactly if some value lies within ``HALF``
bits of both. So every distinct fingerprint emits all its variants within half the radius, equal
variants meet, and whatever meets is linked. Variants are emitted in two steps, so that they are
not shuffled one by one: the leading bits' variants are rows of the shuffle (a block is one value
of those bits, and a row tells how many flips it has left), the other bits' variants are made and
sorted inside the block's task, in pieces of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import NO_ID, counted_stage, id_key, small_batches, stage, table
from refloom.llm.components import components

#: Words of a shingle, seed of its hash.
WIDTH, SEED = 4, 42
#: Flips of each fingerprint: half of the radius.
HALF = 2
BITS = 64
#: Variants that a block makes on average, and at most before it is split by further bits.
BLOCK, MOST = 1 << 22, 1 << 25
#: Leading bits of the first blocks; bits of each further split; beyond LAST a block holds at most
#: 409,000 fingerprints, as no more exist.
FEWEST, WIDEST, STEP, LAST = 4, 24, 8, 56
#: Variants sorted at once in a task (some 40 bytes each).
CHUNK = 1 << 20
#: Bytes of a text split into words at once, hashes counted at once.
PIECE, COUNTED = 1 << 20, 1 << 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of ``text``, repeats included, piece by piece (a longer text takes no more memory)."""
    at, carry, any_ = 0, [], False
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        words = carry + text[at:end].lower().split()  # both know ASCII only, and exactly these six spaces
        if len(words) >= WIDTH:
            any_ = True
            shingles = map(b" ".join, zip(*(words[k:] for k in range(WIDTH)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - WIDTH + 1)
        carry, at = words[-(WIDTH - 1) :], end
    if carry and not any_:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit."""
    bits = lambda part: np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return sum((bits(hashes[i : i + COUNTED]).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), COUNTED)), np.zeros(BITS, np.int64))


def fingerprint(text: bytes) -> int:
    """Bits that over half of the text's shingle hashes have (as a signed long)."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text):
        ones += _set_bits(hashes)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0]) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        found = [fingerprint(x.as_buffer().to_pybytes()) for x in texts]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc", "fp"])


def _masks(bits: int, most: int = HALF) -> list[int]:
    """Values of ``bits`` bits of which at most ``most`` are set."""
    out = [0] + [1 << i for i in range(bits)] * (most >= 1)
    return out + [1 << i | 1 << j for i in range(bits) for j in range(i)] * (most >= 2)


def _ball(bits: int, left: int) -> int:
    """Variants of ``bits`` bits with at most ``left`` flips."""
    return sum(math.comb(bits, k) for k in range(left + 1))


def _spread(rows: DataFrame, depth: int, bits: int) -> DataFrame:
    """block, fp, left: each row of a block of ``depth`` leading bits in all blocks of ``bits`` bits more that it reaches."""
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("cost")) for m in _masks(bits)])
    reached = rows.select("block", "fp", "left", F.explode(F.filter(masks, lambda m: m["cost"] <= F.col("left"))).alias("m"))
    own = F.shiftrightunsigned("fp", BITS - depth - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    block = F.shiftleft("block", bits).bitwiseOR(own.bitwiseXOR(F.col("m.mask")))
    return reached.select(block.alias("block"), "fp", (F.col("left") - F.col("m.cost")).alias("left"))


def _blocks(fps: DataFrame, n: int) -> DataFrame:
    """depth, block, fp, left: blocks of bounded work, of as many leading bits as they need."""
    depth = min(WIDEST, max(FEWEST, math.ceil(math.log2(max(1, n) * _ball(BITS, HALF) / BLOCK))))
    open_ = fps.select(F.lit(0).cast("long").alias("block"), "fp", F.lit(HALF).alias("left"))
    rows, done = stage(_spread(open_, 0, depth)), None
    while True:
        work = F.sum(sum(F.when(F.col("left") == k, F.lit(_ball(BITS - depth, k))).otherwise(F.lit(0)) for k in range(HALF + 1)))
        big, n_big = counted_stage(rows.groupBy("block").agg(work.alias("work")).where(F.col("work") > MOST).select("block"))
        ready = rows.join(big, "block", "left_anti") if n_big and depth < LAST else rows
        ready = ready.select(F.lit(depth).alias("depth"), "block", "fp", "left")
        done = ready if done is None else done.unionByName(ready)
        if not n_big or depth >= LAST:
            return done
        step = min(STEP, LAST - depth)
        rows, depth = stage(_spread(rows.join(big, "block", "left_semi"), depth, step)), depth + step


def variants(rest: np.ndarray, left: np.ndarray, owner: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Variants of ``rest`` (values of ``bits`` bits with so many flips ``left``) and whose they are; equal ones come at once."""
    sizes = np.array([_ball(bits, k) for k in range(HALF + 1)])[left]
    if sizes.sum() > CHUNK and bits:
        step = min(4, bits)
        head, tail = rest >> np.uint64(bits - step), rest & np.uint64((1 << (bits - step)) - 1)
        for value in range(1 << step):
            after = left - np.bitwise_count(head ^ np.uint64(value)).astype(np.int64)
            near = after >= 0
            if near.any():
                yield from variants(tail[near], after[near], owner[near], bits - step)
        return
    made, of = [], []
    for k in np.unique(left).tolist():
        masks, which = np.array(_masks(bits, k), np.uint64), left == k
        made.append((rest[which][:, None] ^ masks).ravel())
        of.append(np.repeat(owner[which], len(masks)))
    yield np.concatenate(made), np.concatenate(of)


def joined_labels(fps: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """For each fingerprint of a block the least position that colliding variants connect its own with."""
    label = np.arange(len(fps))
    rest = fps & np.uint64((1 << (BITS - depth)) - 1)
    for values, owner in variants(rest, left, label.copy(), BITS - depth):
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.concatenate(([True], values[1:] != values[:-1]))
        first = owner[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        pairs = np.unique(np.stack((first, owner), axis=1)[label[first] != label[owner]], axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * HALF
        a, b = a[near], b[near]
        while (open_ := label[a] != label[b]).any():
            a, b = a[open_], b[open_]
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != label[label]).any():
                label = label[label]
    return label


def _block_links(group: pa.Table) -> pa.Table:
    """a, b: fingerprints of a block (depth, block, fp, left) and the one that stands for what they are connected with there."""
    pa.default_memory_pool().release_unused()
    fps, left = group.column("fp").to_numpy(), group.column("left").to_numpy().astype(np.int64)
    label = joined_labels(fps.view(np.uint64), left, group.column("depth")[0].as_py())
    moved = label != np.arange(len(label))
    return pa.table({"a": pa.array(fps[label[moved]], pa.int64()), "b": pa.array(fps[moved], pa.int64())})


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id per row of ``docs``.

    A-Z are lower-cased; a bit of the fingerprint is 1 if over half of the 64-bit hashes of the
    text's shingles (``WIDTH`` words, or all if it has fewer) have it. Fingerprints of at most
    ``2 * HALF`` different bits link; component_id is the smallest doc_id that links reach.

    Defined cases: null text and text without words have fingerprint zero, which links like any
    other; rows with equal ids are linked each by its own text; a null id sorts last and stays
    null where its component has no other; an empty table gives an empty table; other columns
    are not carried.

    Copies are one fingerprint before anything is emitted, so groups of copies cost nothing. A
    value that many fingerprints reach links each with the least of them: pairs grow with the
    group's size, and all pairs of the group are links, since each is within HALF bits of the
    value. Blocks beyond MOST variants are split by further bits until none is, so neither a
    task's memory nor its time grows with a group of near copies.
    """
    with small_batches(docs.sparkSession):
        rows = stage(docs.select(id_key(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc long, fp long"))
    fps, n = counted_stage(rows.groupBy("fp").agg(F.min("doc").alias("doc")))
    found = stage(_blocks(fps, n or 0).groupBy("depth", "block").applyInArrow(_block_links, "a long, b long").distinct())
    comps = components(found).withColumnRenamed("node", "fp")
    joined = stage(comps.join(fps, "fp"))
    # written first: a join with an aggregate's own partitions could not be split at run time
    least = stage(joined.groupBy("comp").agg(F.min("doc").alias("least")))
    known = stage(joined.join(least, "comp").select("fp", "least"))
    by_fp = stage(fps.join(known, "fp", "left").select("fp", F.coalesce("least", "doc").alias("least")))
    named = lambda c: F.when(F.col(c) == NO_ID, F.lit(None)).otherwise(F.col(c))
    return rows.join(by_fp, "fp").select(named("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named("least").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
