"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import math
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refloom.llm.common import stage, table

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of one length are numbered in buckets of about this many rows.
BUCKET_ROWS = 20_000


class WordTokenizer:
    """Ids of whole texts, by looking words up.

    The vocabulary's tokenizer lower-cases, splits at white space and then into runs of
    letters, single digits and runs of other signs, and merges within such a run. So a
    text's ids are its words' ids in order, and a word's are its runs'. Words and runs seen
    are kept in bounded dictionaries of two generations; an unseen run goes through the
    tokenizer's own model. Texts that hold special-token strings, the four separators that
    only some engines take for white space, or characters that composition would change go
    through the tokenizer whole.
    """

    #: The vocabulary's own splitting pattern.
    RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    #: Outside these blocks libraries differ in their Unicode versions; U+0130 and U+03A3 lower-case by context.
    RARE = regex.compile("[^\x00-\u012f\u0131-\u024f\u0391-\u03a1\u03a4-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
    KEEP = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # printable bytes stand for themselves in a byte-level vocabulary, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.runs: list[dict[str, bytes]] = [{}, {}]

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _put(self, memo: list[dict[str, bytes]], key: str, ids: bytes) -> bytes:
        if len(memo[0]) >= self.KEEP:
            memo[1], memo[0] = memo[0], {}
        memo[0][key] = ids
        return ids

    def _run(self, run: str) -> bytes:
        ids = self.runs[0].get(run)
        if ids is not None:
            return ids
        ids = self.runs[1].get(run)
        if ids is None:
            as_letters = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.model.tokenize(as_letters)]
            ids = struct.pack(f"<{len(found)}I", *found)
        return self._put(self.runs, run, ids)

    def _word(self, word: str) -> bytes:
        ids = self.words[1].get(word)
        if ids is None:
            ids = self._run(word) if word.isalpha() else b"".join(map(self._run, self.RUN.findall(word)))
        return self._put(self.words, word, ids)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text."""
        if any(x in text for x in self.ODD):
            return self._ids(text)
        if text.isascii() or self._western(text):
            words = text.lower().split()
        else:
            return self._ids(text)
        ids = list(map(self.words[0].get, words))
        if None in ids:
            ids = [self._word(w) if x is None else x for w, x in zip(words, ids)]
        return b"".join(ids)

    @staticmethod
    def _western(text: str) -> bool:
        """Composed already, and every character lower-cases alone to one character."""
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return WordTokenizer.RARE.search(text) is None and unicodedata.is_normalized("NFC", text)


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece of each text: id, piece, start, length, ids_crc32 (and the ids). Null text is empty; every text ends with END_ID."""
    schema = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("row_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + ([("ids", pa.binary())] if with_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            if tokens is None:
                tokens = WordTokenizer(path)
            ids, keys, texts = (batch.column(k).to_pylist() for k in range(3))
            rows = []
            for doc, key, text in zip(ids, keys, texts):
                data = tokens.encode(text or "") + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, key, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    # rows with equal ids stay apart by a key of their text
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row_key"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, schema)


class SumIndex:
    """Sums of one, two and three available lengths, by sum.

    A sum's entry is the largest member of its combinations (for three: of those whose other
    two are no longer). Lengths are only ever used up, so an entry can only fall: it is
    repaired when a look-up finds its combination gone.
    """

    def __init__(self, left: np.ndarray):
        self.left, self.top = left, len(left) - 1
        self.have = left > 0
        self.pair = np.zeros(len(left), dtype=np.int64)
        self.triple = np.zeros(len(left), dtype=np.int64)
        sums = np.zeros(len(left), dtype=bool)  # of two lengths up to the present one
        lengths = np.flatnonzero(self.have)
        for a in lengths.tolist():
            others = lengths[: np.searchsorted(lengths, min(a, self.top - a), "right")]
            sums[a + others] = True
            self.pair[a + others] = a
            self.triple[a + np.flatnonzero(sums[: self.top - a + 1])] = a

    def used_up(self, lengths: np.ndarray) -> None:
        self.have[lengths] = self.left[lengths] > 0

    def _two(self, gap: int, most: int, held: list[int]) -> list[int] | None:
        """Two lengths of this sum, none above ``most`` and none that the bin in hand holds to the last."""
        a = min(int(self.pair[gap]), most)
        while 2 * a >= gap and a:
            b = gap - a
            if self.left[a] > held.count(a) and self.left[b] > held.count(b) + (a == b):
                return [a, b]
            low = (gap + 1) // 2
            both = self.have[low:a] & self.have[gap - a + 1 : gap - low + 1][::-1]
            lower = int(low + np.flatnonzero(both)[-1]) if both.any() else 0
            if a == self.pair[gap] and not (self.left[a] and self.left[b] > (a == b)):
                self.pair[gap] = lower
            a = lower
        return None

    def fill(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three available lengths whose sum is the gap, longest first."""
        if self.left[gap] > held.count(gap):
            return [gap]
        found = self._two(gap, gap, held)
        if found:
            return found
        a = int(self.triple[gap])
        while 3 * a >= gap and a:
            if self.left[a] > held.count(a):
                found = self._two(gap - a, a, [*held, a])
                if found:
                    return [a, *found]
            lower = np.flatnonzero(self.have[:a] & (self.pair[gap : gap - a : -1] > 0))
            lower = int(lower[-1]) if len(lower) else 0
            if a == self.triple[gap] and not held:
                self.triple[gap] = lower
            a = lower
        return None


class Plan:
    """Bins over a histogram of lengths.

    A bin opens with the longest length left. Its gap is closed exactly by one, two or
    three available lengths where the index of their sums has it; otherwise the longest
    length that fits goes in and the smaller gap is looked up again. A bin's pattern is used
    as often as the counts allow, so the work follows the number of lengths, not of pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] += n
        #: (lengths from longest, times)
        self.patterns: list[tuple[list[int], int]] = []

    def run(self) -> Plan:
        left, index = self.left, SumIndex(self.left)
        top = self.capacity
        while True:
            while top > 0 and left[top] == 0:
                top -= 1
            if top == 0:
                return self
            bin_, gap = [top], self.capacity - top
            while gap:
                found = index.fill(gap, bin_)
                if found:
                    bin_ += found
                    break
                fits = np.flatnonzero(index.have[: gap + 1])
                fit = next((x for x in fits[::-1].tolist() if left[x] > bin_.count(x)), 0)
                if not fit:
                    break
                bin_.append(fit)
                gap -= fit
            need, uses = np.unique(bin_, return_counts=True)
            times = int((left[need] // uses).min())
            left[need] -= uses * times
            index.used_up(need)
            self.patterns.append((bin_, times))

    def slots(self) -> list[tuple[int, int, int, int, int]]:
        """Rows (length, first rank, one past the last rank, first sequence, offset)."""
        rows, rank, sequence = [], np.zeros(self.capacity + 1, dtype=np.int64), 0
        for bin_, times in self.patterns:
            at = 0
            for length in bin_:
                rows.append((length, int(rank[length]), int(rank[length]) + times, sequence, at))
                rank[length] += times
                at += length
            sequence += times
        return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with ``length``, ``doc_id``, ``row_key``, ``piece``) plus ``sequence_id`` and ``offset``.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver. Pieces are
    numbered within their length in buckets, so a length that a third of all pieces has is
    no single task's work; the plan's slots (a few per length) join by length and bucket.
    """
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Plan(histogram, capacity).run().slots()
    # at most `capacity` rows: each length and how many buckets its pieces take
    shares = spark.createDataFrame([(k, math.ceil(n / BUCKET_ROWS)) for k, n in histogram.items()], "length long, pk_buckets long")
    bucketed = parts.join(F.broadcast(shares), "length")
    bucketed = bucketed.withColumn("pk_bucket", F.pmod(F.xxhash64("doc_id", "row_key", "piece", "pk_n"), F.col("pk_buckets"))).drop("pk_buckets")
    sizes = bucketed.groupBy("length", "pk_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("pk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("pk_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # a bucket's ranks meet only the slots that they reach
    table_ = spark.createDataFrame(slots or [], "length long, a long, b long, s long, o long")
    reached = starts.join(table_, "length").where((F.col("a") < F.col("pk_before") + F.col("n")) & (F.col("b") > F.col("pk_before")))
    reached = reached.groupBy("length", "pk_bucket", "pk_before").agg(F.sort_array(F.collect_list(F.struct("a", "b", "s", "o"))).alias("pk_slots"))
    inside = Window.partitionBy("length", "pk_bucket").orderBy("doc_id", "row_key", "piece", "pk_n")
    ranked = bucketed.withColumn("pk_in", F.row_number().over(inside) - 1).join(reached, ["length", "pk_bucket"])
    ranked = ranked.withColumn("pk_rank", F.col("pk_before") + F.col("pk_in"))
    placed = ranked.withColumn("pk_hit", F.expr("filter(pk_slots, x -> x.a <= pk_rank AND pk_rank < x.b)[0]"))
    out = placed.withColumns({"sequence_id": F.col("pk_hit.s") + F.col("pk_rank") - F.col("pk_hit.a"), "offset": F.col("pk_hit.o")})
    return out.drop("pk_bucket", "pk_before", "pk_in", "pk_rank", "pk_slots", "pk_hit")


def best_fit_packing(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents placed in sequences of at most ``capacity`` tokens.

    Defined cases: null or empty text is the end id alone; a null id stays null and is
    placed like any other; rows with equal ids and texts are placed each for itself; an
    empty table gives an empty table; other columns are not carried.
    """
    found = pieces(docs, path, id_col, text_col, capacity).withColumn("pk_n", F.monotonically_increasing_id())
    parts = stage(found)
    return pack(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
