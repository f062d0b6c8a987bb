"""Suffix-array dedup: bytes covered by strings of SPAN bytes that start at two places or more.

A column-wise construction over many strings at once: every round adds one symbol of
each string, re-sorts the strings stably by it (the round's column of the collection's
transform) and updates how far neighbours agree. Run over all documents as they stand it
would rewrite the whole collection once for each column of the longest text. So strings
are first lined up by anchors: in every window of SPAN bytes the GRAM-byte string of
smallest hash. Equal windows hold the same anchor at the same place, so only the
surroundings of anchors that occur twice take part, lined up at the anchor, and a bucket of
equal anchors needs one pass of a fixed number of columns. Where the rounds' files would
be, the engine's own shuffle files hold the buckets.

A bucket larger than HOT rows (some 60 MB of columns) is cut into chunks; what is single in its chunk meets the
other chunks' windows by hash, one row for each distinct window and chunk.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import id_key, small_batches, stage, table, text_of
from refloom.llm.shingles import mix

SPAN = 400
GRAM = 64
LEFT = SPAN - GRAM
WIDE = LEFT + SPAN
HOT = 30_000
#: Strings of a pass: whole buckets are gathered up to this many.
PASS = 6_000
#: Bytes looked at at once when anchors are chosen; positions within take the low bits of a key.
SEGMENT, POSITION_BITS = 1 << 17, 18

_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, 2**k, 2**64) | 1) for k in range(6)]
_LOW = np.uint64((1 << POSITION_BITS) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position (the last GRAM - 1 positions have none)."""
    h, wide = _SYMBOL[data], 1
    for step in _STEP:
        h = h[:-wide] * step + h[wide:]
        wide *= 2
    return mix(h)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are smallest in some window of SPAN bytes (the last of equal ones)."""
    n = len(text)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    places, hashes = [], []
    for a in range(0, n - SPAN + 1, SEGMENT):
        part = data[a : a + SEGMENT + SPAN - 1]
        h = gram_hashes(part)
        key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        windows, wide, least = len(part) - SPAN + 1, 1, key
        per = SPAN - GRAM + 1
        while 2 * wide <= per:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        least = np.minimum(least[:windows], least[per - wide : per - wide + windows])
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        at = (_LOW - (least & _LOW)).astype(np.int64)
        at = np.unique(at)
        places.append(at + a)
        hashes.append(h[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, h[first].view(np.int64)


def column_wise(rows: list[bytes], begin: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of each string another string of its bucket has, and which are their bucket's first.

    ``rows``: bytes from column ``begin`` on, lined up so that the anchor is at column LEFT;
    ``bucket``: ascending numbers. Returns two (string, window start) tables.
    """
    n = len(rows)
    symbols = np.full((WIDE, n), 256, dtype=np.int16)
    for k, (row, b) in enumerate(zip(rows, begin)):
        symbols[b : b + len(row), k] = np.frombuffer(row, np.uint8)
    twice = np.zeros((WIDE - SPAN + 1, n), dtype=bool)
    first = np.zeros((WIDE - SPAN + 1, n), dtype=bool)
    order = np.arange(n)
    base = bucket.astype(np.int64) * 512
    # since[i]: first column from which strings order[i - 1] and order[i] agree up to now
    since = np.where(np.concatenate(([True], bucket[1:] != bucket[:-1])), WIDE + 1, 0)
    for j in range(WIDE):
        symbol = symbols[j][order]
        key = base[order] + symbol
        if (key[1:] >= key[:-1]).all():
            same = np.concatenate(([False], key[1:] == key[:-1])) & (symbol < 256)
            new = np.where(same, since, j + 1)
        else:
            moved = np.argsort(key, kind="stable")
            key, order = key[moved], order[moved]
            same = np.concatenate(([False], key[1:] == key[:-1])) & (symbol[moved] < 256)
            new = np.full(n, j + 1)
            q = np.flatnonzero(same)
            lo, hi = moved[q - 1] + 1, moved[q]
            gap = hi - lo + 1
            near = gap == 1
            new[q[near]] = since[hi[near]]
            if not near.all():  # the weakest agreement between the two in the old order
                lo, hi, gap, q = lo[~near], hi[~near], gap[~near], q[~near]
                level = np.frexp(gap)[1] - 1
                best, table_, wide = np.zeros(len(q), np.int64), since, 1
                for k in range(int(level.max()) + 1):
                    at = level == k
                    best[at] = np.maximum(table_[lo[at]], table_[hi[at] - wide + 1])
                    if k < level.max():
                        table_ = np.maximum(table_[:-wide], table_[wide:])
                        wide *= 2
                new[q] = best
        since = new
        if j >= SPAN - 1:
            i = j - SPAN + 1
            again = since <= i
            hit = again.copy()
            hit[:-1] |= again[1:]
            twice[i, order] = hit
            first[i, order] = ~again
    inside = np.zeros_like(twice)
    for k, (row, b) in enumerate(zip(rows, begin)):
        if len(row) >= SPAN:
            inside[b : b + len(row) - SPAN + 1, k] = True
    return (twice & inside).T, (first & inside).T


def window_hashes(row: bytes, begin: int, gram: int) -> np.ndarray:
    """64-bit hashes of the SPAN-byte windows of a string from column ``begin`` on.

    The gram and the window's column take part: a window lies in a bucket for each anchor
    it holds, and only windows that hold the anchor at the same place are compared.
    """
    h = _SYMBOL[np.frombuffer(row, np.uint8)]
    power = np.full(WIDE, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[::-1][: len(h)])))
    # scaled to one power, so equal windows at different places agree
    own = mix(np.array([gram], np.int64).view(np.uint64) + np.arange(begin, begin + len(h) - SPAN + 1, dtype=np.uint64))
    return mix(mix((sums[SPAN:] - sums[:-SPAN]) * power[: len(h) - SPAN + 1]) ^ own).view(np.int64)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


_OUT = pa.schema([("cls", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("window", pa.int64())])


def _bucket_rows(batches):
    """Finds repeated windows in rows sorted by bucket: intervals to remove (window null), and distinct windows of chunks (see the module)."""
    held: list[tuple] = []

    def flush(rows):
        texts, begin = [r[4] for r in rows], np.array([r[5] for r in rows])
        keys = [(r[0], r[1]) for r in rows]
        bucket = np.cumsum([0] + [a != b for a, b in zip(keys[1:], keys)])
        twice, first = column_wise(texts, begin, bucket)
        cls, start, end, window = [], [], [], []

        def put(c, s, e, w=None):
            cls.append(c)
            start.append(s)
            end.append(e)
            window.append(w)

        for k, (gram, _, parts, c, text, b, places) in enumerate(rows):
            # a context that its own text repeats is repeated in full
            flags = twice[k] if len(places) == 1 else np.zeros(WIDE - SPAN + 1, bool)
            if len(places) > 1 and len(text) >= SPAN:
                flags[b : b + len(text) - SPAN + 1] = True
            for s, e in runs(flags):
                for p in places:
                    put(c, p - LEFT + s, p - LEFT + e - 1 + SPAN)
            if parts > 1 and len(text) >= SPAN:
                hashes = window_hashes(text, b, gram)
                for i in np.flatnonzero(first[k]).tolist():
                    owner = bool(flags[i])
                    put(None if owner else c, places[0] - LEFT + i, places[0] - LEFT + i + SPAN, int(hashes[i - b]))
        return pa.record_batch([pa.array(x, f.type) for x, f in zip((cls, start, end, window), _OUT)], schema=_OUT)

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if len(held) >= PASS and (row[0], row[1]) != (held[-1][0], held[-1][1]):
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def _anchor_rows(batches):
    """cls, gram, place of every anchor; equal texts in a task once."""
    seen = set()
    for batch in batches:
        cls, gram, place = [], [], []
        for c, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if c in seen:
                continue
            if len(seen) < 200_000:
                seen.add(c)
            at, h = anchors(text.as_buffer().to_pybytes())
            cls += [c] * len(at)
            gram.append(h)
            place.append(at)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, place)]
        yield pa.record_batch([pa.array(cls, pa.binary()), *map(pa.array, columns)], names=["cls", "gram", "place"])


_CONTEXT = pa.schema([("gram", pa.int64()), ("chunk", pa.int64()), ("parts", pa.int64()), ("cls", pa.binary()), ("text", pa.binary()), ("begin", pa.int64()), ("places", pa.list_(pa.int64()))])


def _context_rows(batches):
    """Surroundings of a text's repeated anchors, equal ones once with all their places."""
    for batch in batches:
        out = []
        for c, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data, alike = text.as_buffer().to_pybytes(), {}
            for a in sorted(found, key=lambda x: x["place"]):
                p = a["place"]
                left = max(0, p - LEFT)
                alike.setdefault((a["gram"], data[left : p + SPAN], LEFT - (p - left)), [a["parts"], []])[1].append(p)
            for (gram, context, begin), (parts, places) in alike.items():
                chunk = int.from_bytes(hashlib.blake2b(context, digest_size=6).digest(), "little") ^ int.from_bytes(c[:4], "little")
                out.append((gram, chunk % parts, parts, c, context, begin, places))
            if len(out) >= 4096:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), _CONTEXT)], schema=_CONTEXT)
                out = []
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), _CONTEXT)], schema=_CONTEXT)


def _cut(batches):
    """Removes the intervals from each text."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        rows = []
        for doc, text, copies, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            data = text.as_buffer().to_pybytes()
            spans = sorted((s["start"], s["end"]) for s in spans or ())
            if copies > 1 and len(data) >= SPAN:
                spans = [(0, len(data))]
            kept, at, n = [], 0, 0
            for s, e in spans:
                if s > at or (n == 0 and s == at):
                    kept.append(data[at:s])
                    n += 1
                at = max(at, e)
            kept.append(data[at:])
            left = b"".join(kept)
            rows.append((doc, len(data), len(data) - len(left), n, left))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=names)


def _tidy(spark: SparkSession) -> None:
    """Let finished steps' shuffle files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _found(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """What the passes over all buckets find (see ``_bucket_rows``)."""
    found = stage(rows.where(F.octet_length("text") >= SPAN).select("cls", "text").mapInArrow(_anchor_rows, "cls binary, gram long, place long"))
    # at least two different places; copies of a text in several tasks name the same place again
    one = F.struct("cls", "place")
    sizes = found.groupBy("gram").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.count("*").alias("n")).where("lo < hi")
    # written first, so that the join may split a gram that very many places have
    sizes = stage(sizes.select("gram", F.ceil(F.col("n") / F.lit(float(HOT))).cast("long").alias("parts")))
    repeated = found.join(sizes, "gram").groupBy("cls").agg(F.collect_set(F.struct("place", "gram", "parts")).alias("found"))
    # one row of each text is enough: the one of smallest id, so copies are spread by their ids, not gathered
    wanted = repeated.join(copies, "cls").select("cls", F.col("first").alias("key"), "found")
    firsts = rows.where(F.octet_length("text") >= SPAN).withColumn("key", id_key("doc_id")).join(wanted, ["cls", "key"])
    firsts = firsts.dropDuplicates(["cls", "key"]).select("cls", "text", "found")
    contexts = firsts.mapInArrow(_context_rows, "gram long, chunk long, parts long, cls binary, text binary, begin long, places array<long>")
    dealt = contexts.repartition("gram", "chunk").sortWithinPartitions("gram", "chunk")
    return stage(dealt.mapInArrow(_bucket_rows, "cls binary, start long, end long, window long"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: what is left) per row of ``docs``.

    Texts are told apart by 128 bits.

    Defined cases: null text is empty; texts shorter than SPAN bytes stay whole; rows with
    equal texts (repeated rows and equal ids too) are copies of each other and go in full from SPAN bytes
    on; a null id stays null; an empty table gives an empty table; other columns are not carried.
    """
    with small_batches(docs.sparkSession):
        return _cut_repeats(docs, id_col, text_col)


def _cut_repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("cls"), text.cast("binary").alias("text"))
    copies = stage(rows.groupBy("cls").agg(F.count("*").alias("copies"), F.min(id_key("doc_id")).alias("first")))

    result = _found(rows, copies)
    _tidy(spark)  # the texts that were shuffled for it are done with
    direct = result.where("window is null").select("cls", "start", "end")
    windows = result.where("window is not null")
    # a window that two chunks have: each chunk sends it once, with its owner where it is single there
    met = windows.groupBy("window").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("cls", "start", "end"))).alias("owners"))
    across = met.where("n > 1").select(F.inline("owners"))
    spans = direct.unionByName(across).groupBy("cls").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    flags = stage(copies.select("cls", "copies").join(spans, "cls", "left"))
    _tidy(spark)
    joined = rows.join(flags, "cls").select("doc_id", "text", "copies", "spans")
    # batches of the last pass are bounded by rows: the caller's session may hand on larger ones
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and what is left as text (U+FFFD where a cut went through a character)."""
    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), left.alias("text"))
