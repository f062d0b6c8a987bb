"""N-gram Jaccard self-join of documents by a blocked sparse product.

The product of the document-by-shingle incidence with its transpose is never formed
whole. Columns are hashed into blocks; of each row only the entries that a partner with
enough overlap must share take part (its smallest in one global order, common shingles
last). Each row meets one hub under each shingle, overlap counts add up per pair, and pairs
whose count is below the bound that their sizes imply are dropped.

Rows (classes of equal sets) that surviving pairs connect are dealt into units of bounded
size, each row once. A unit is one block of the product over whole rows: overlap counts
accumulate column by column and decide every link between components, so no pair is
written, and a row is multiplied only with rows outside its component. The next round turns
to other hubs; the last one meets whatever still crosses both components and units.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from refloom.llm.common import NO_ID, counted_stage, id_key, small_batches, stage, table
from refloom.llm.components import merged
from refloom.llm.shingles import shingle_sets

#: A shingle in more classes' rows than this comes last in the order ...
COMMON = 24
#: ... if it is among this many most frequent ones: the proven bound of the one broadcast (4 bytes each).
MAX_COMMON = 2_000_000
#: Shingles gathered in a task before they are counted and sent on (8 bytes each).
FLUSH = 750_000
#: Bytes of text for a block of columns.
BLOCK_BYTES = 8 << 20
#: Rounds that meet hubs at most (they end when one meets under a tenth of the first's pairs), and hubs of a shingle in each but the first. From the second round on, a shingle that more
#: rows have than CROWDED sends them to its hub's group whether or not they share enough with the hub.
HUB_ROUNDS, HUBS, CROWDED = 6, 4, 64
#: Rows and entries (8 bytes each) of a unit at most, on average.
UNIT_ROWS, UNIT_ENTRIES = 4_096, 2_000_000
#: Classes of one component under one shingle that meet in one task.
SALT = 256
#: Bits of a set's key that its class takes; classes that may share them.
CLASS_BITS, MOST_MIXED = 64, 100_000
#: Ids (16 bytes each) that may be broadcast; their number is checked first.
BROADCAST_ROWS = 500_000


def prefix_length(n: np.ndarray | int):
    """Entries of which at least one is shared with any partner of 75 % similarity or more."""
    return n - (3 * n + 3) // 4 + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_key(found: np.ndarray) -> bytes:
    """What tells a set of shingles apart: 128 bits."""
    return xxhash.xxh3_128_digest(found.tobytes())


def _class_of(found: np.ndarray, crowded: frozenset[int] = frozenset(), turn: int = 0) -> int:
    """The class of a set as a long: half of its key, or for ``crowded`` halves, which several keys have, another hash of the whole key."""
    key = set_key(found)
    h = int.from_bytes(key[8:], "little") & ((1 << CLASS_BITS) - 1)
    if h in crowded:
        h = xxhash.xxh3_64_intdigest(key, turn)
    return h - (1 << 64) if h >= 1 << 63 else h


def _classes(docs: DataFrame, crowded: frozenset[int], turn: int) -> DataFrame:
    """doc, key (null without shingles), cls (likewise), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([_class_of(s, crowded, turn) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                ],
                names=["doc", "key", "cls", "n"],
            )

    return docs.mapInArrow(run, "doc long, key binary, cls long, n long")


def _told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int], int]:
    """Classes of ``docs`` (written), one row a class (cls, doc, n: its first document and size), and what ``_class_of`` needs to tell all keys apart.

    Halves of keys that several keys share are a handful even of 10^10 texts; they are collected
    and hashed again until every class has one key.
    """
    crowded, turn = frozenset(), 0
    while True:
        classes = stage(_classes(docs, crowded, turn))
        reps = stage(classes.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.min("key").alias("key"), F.max("key").alias("other")))
        mixed = [r["cls"] for r in reps.where("key <> other").select("cls").limit(MOST_MIXED + 1).collect()]
        if not mixed:
            return classes, reps.select("cls", "doc", "n"), crowded, turn
        if len(mixed) > MOST_MIXED:
            raise ValueError("more classes of texts collide than 64-bit hashes of texts can explain")
        crowded, turn = crowded | {x % (1 << 64) for x in mixed}, turn + 1


def with_key(docs: DataFrame, text_col: str = "text", name: str = "key") -> DataFrame:
    """``docs`` and the key of each row's text (see ``set_key``) in a further column ``name`` (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            found = pa.array([set_key(s) if len(s) else None for s in shingle_sets(texts)], pa.binary())
            yield pa.record_batch([*kept, found], names=[*batch.schema.names[:-1], name])

    rows = docs.withColumn(name, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def _gathered(batches: Iterator[pa.RecordBatch], column: int, emit) -> Iterator[pa.RecordBatch]:
    """Hands lists of sets with FLUSH shingles or more to ``emit``."""
    held, size = [], 0
    for batch in batches:
        for found in shingle_sets(batch.column(column)):
            if len(found):
                held.append(found)
                size += len(found)
                if size >= FLUSH:
                    yield from emit(held)
                    held, size = [], 0
    if held:
        yield from emit(held)
    pa.default_memory_pool().release_unused()


def _common(docs: DataFrame, blocks: int) -> np.ndarray:
    """Sorted upper halves of the hashes of the most frequent shingles.

    Tasks count what they hold before they send it, so a very common shingle is a few
    numbers from each; the counts of a block meet as packed arrays.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held):
            keys, n = np.unique((np.concatenate(held) >> np.uint64(32)).astype(np.uint32), return_counts=True)
            block = (keys.astype(np.uint64) * np.uint64(blocks)) >> np.uint64(32)
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            rows = [(b, keys[i:j].tobytes(), np.minimum(n[i:j], 2**31).astype(np.uint32).tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["block", "keys", "counts"])

        yield from _gathered(batches, 1, emit)

    def add(group: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what earlier groups of this worker took
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("counts")])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total, keys = np.add.reduceat(counts, at), keys[at]
        big = total > COMMON
        return pa.table({"key": pa.array(keys[big].astype(np.int64)), "n": pa.array(total[big])})

    counted = docs.mapInArrow(count, "block int, keys binary, counts binary").groupBy("block").applyInArrow(add, "key long, n long")
    top = counted.orderBy(F.desc("n"), "key").limit(MAX_COMMON).select("key").toPandas()["key"].to_numpy(dtype=np.uint32)
    return np.sort(top)


def _postings(docs: DataFrame, common: np.ndarray, blocks: int, class_of) -> DataFrame:
    """token, cls, n: prefix entries whose shingle at least two classes have in their prefixes, and all common ones."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()

        def emit(held):
            tokens, owners, sizes = [], [], []
            for s in held:
                cls = class_of(s)
                if cls in seen:
                    continue
                if len(seen) < 200_000:  # copies within a task; other copies meet later
                    seen.add(cls)
                k = prefix_length(len(s))
                if len(often):
                    upper = (s >> np.uint64(32)).astype(np.uint32)
                    at = np.searchsorted(often, upper)
                    hit = often[np.minimum(at, len(often) - 1)] == upper
                    if hit.any():
                        rare = s[~hit]
                        s_ = np.concatenate((rare[:k], s[hit][: max(0, k - len(rare))]))
                    else:
                        s_ = s[:k]
                else:
                    s_ = s[:k]
                tokens.append(s_)
                owners.append(np.full(len(s_), cls, np.int64))
                sizes.append(np.full(len(s_), len(s), np.uint32))
            if not tokens:
                return
            tokens, owners, sizes = map(np.concatenate, (tokens, owners, sizes))
            upper = (tokens >> np.uint64(32)).astype(np.uint32)
            hot = np.isin(upper, often)
            order = np.argsort(tokens)
            order = order[~hot[order]]
            block = (tokens[order] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            rows = []
            for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if j > i:
                    o = order[i:j]
                    rows.append((b, tokens[o].tobytes(), owners[o].tobytes(), sizes[o].tobytes()))
            # common shingles leave their block: they are dealt again by their own hash and their class
            if hot.any():
                t, o, z = tokens[hot], owners[hot], sizes[hot]
                for i in range(0, len(t), 50_000):
                    rows.append((-1 - int(o[i]) % blocks, t[i : i + 50_000].tobytes(), o[i : i + 50_000].tobytes(), z[i : i + 50_000].tobytes()))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "tokens", "owners", "sizes"])

        yield from _gathered(batches, 1, emit)

    def several(group: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        block = group.column("block")[0].as_py()
        tokens, owners, sizes = (np.concatenate([np.frombuffer(x.as_py(), t) for x in group.column(c)]) for c, t in (("tokens", np.uint64), ("owners", np.int64), ("sizes", np.uint32)))
        if block >= 0:
            order = np.lexsort((owners, tokens))
            tokens, owners, sizes = tokens[order], owners[order], sizes[order]
            new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])))
            tokens, owners, sizes = tokens[new], owners[new], sizes[new]
            same = tokens[1:] == tokens[:-1]
            keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
            tokens, owners, sizes = tokens[keep], owners[keep], sizes[keep]
        return pa.table({"token": pa.array(_signed(tokens)), "cls": pa.array(owners), "n": pa.array(sizes.astype(np.int64))})

    packed = docs.mapInArrow(prefixes, "block int, tokens binary, owners binary, sizes binary")
    return packed.groupBy("block").applyInArrow(several, "token long, cls long, n long")


def _loaded(docs: DataFrame, first: DataFrame, class_of) -> DataFrame:
    """cls, shingles (sorted little-endian uint64) of the classes that ``first`` (doc, want) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for want, found in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0))):
                # rows with equal ids can differ in text: the class decides
                if len(found) and class_of(found) == want:
                    out.append((want, found.tobytes()))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary()))], names=["cls", "shingles"])

    return docs.join(first, "doc").select("text", "want").mapInArrow(run, "cls long, shingles binary").dropDuplicates(["cls"])


def joined_components(rows: list[np.ndarray], component: np.ndarray) -> np.ndarray:
    """For each row (sorted distinct hashes) the least component number that links of similarity 75 % or more join its component with.

    A row's overlaps with all rows outside what is reached so far are counted at once, by its
    columns' postings; what links is reached with its whole component. So every pair of
    different components is decided, by its count, unless links found before already join them.
    """
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    entries, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    _, column, n = np.unique(entries, return_inverse=True, return_counts=True)
    column, owner = column[n[column] > 1], owner[n[column] > 1]  # of the rest no pair has any
    at = np.searchsorted(owner, np.arange(len(rows) + 1))
    by_component = np.argsort(component, kind="stable")
    first = np.searchsorted(component[by_component], np.arange(component.max() + 2))
    open_ = np.ones(len(rows), dtype=bool)
    joined = component.copy()

    def postings():
        """Rows still open of each column."""
        held = open_[owner]
        order = np.argsort(column[held], kind="stable")
        return owner[held][order], np.searchsorted(column[held][order], np.arange(len(n) + 1)), int(open_.sum())

    def reach(c: int) -> list[int]:
        found = by_component[first[c] : first[c + 1]].tolist()
        open_[found] = False
        return found

    posted, starts, indexed = postings()
    for seed in np.argsort(at[:-1] - at[1:], kind="stable").tolist():
        if not open_[seed]:
            continue
        reached = [int(component[seed])]
        queue = reach(reached[0])
        while queue:
            left = int(open_.sum())
            if not left:
                break
            if 2 * left < indexed:
                posted, starts, indexed = postings()
            row = queue.pop()
            own = column[at[row] : at[row + 1]]
            lengths = starts[own + 1] - starts[own]
            total = int(lengths.sum())
            if not total:
                continue
            where = np.repeat(starts[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(total)
            counts = np.bincount(posted[where], minlength=len(rows))
            hit = open_ & (100 * counts >= 75 * (sizes[row] + sizes - counts))
            for c in np.unique(component[hit]).tolist():
                reached.append(c)
                queue += reach(c)
        if len(reached) > 1:
            joined[np.isin(component, reached)] = min(reached)
    return joined


def _unit_links(group: pa.Table) -> pa.Table:
    """a, b: components (least first) that links among a unit's rows (unit, cls, comp, shingles) join."""
    pa.default_memory_pool().release_unused()
    label, comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)
    joined = comp
    if len(label) > 1:
        joined = joined_components([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")], comp)
    pairs = np.unique(np.stack((joined, comp), axis=1)[joined != comp], axis=0)
    return pa.table({"a": pa.array(label[pairs[:, 0]], pa.int64()), "b": pa.array(label[pairs[:, 1]], pa.int64())})


def _sets(docs: DataFrame, named: DataFrame, rows: int, class_of) -> DataFrame:
    """cls, shingles of the classes in ``named`` (cls, doc: its first document), which has so many ``rows``."""
    first = named.select("doc", F.col("cls").alias("want")).distinct()
    # texts stay where they are while the wanted ids are few; beyond the bound both sides are shuffled
    return _loaded(docs, F.broadcast(first) if rows <= BROADCAST_ROWS else first, class_of)


def _parts(group_rows, group_entries):
    return F.ceil(F.greatest(group_rows / F.lit(float(UNIT_ROWS)), group_entries / F.lit(float(UNIT_ENTRIES)))).cast("int")


def _grouped(groups: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """cls, group: each class of ``pairs`` (a, b) goes to the group of its hub b; any grouping is right, close texts together save work."""
    if groups is None:
        # hubs of the first round are larger than what they meet, so their own hubs lead on without a cycle
        step = pairs.select(F.col("a").alias("b"), F.col("b").alias("up"))
        hop = pairs.join(step, "b", "left").select("a", F.coalesce("up", "b").alias("b"))
        hop = hop.join(step, "b", "left").select(F.col("a").alias("cls"), F.coalesce("up", "b").alias("group"))
        known = hop
    else:
        hub = groups.select(F.col("cls").alias("b"), "group")
        known = pairs.join(hub, "b", "left").select(F.col("a").alias("cls"), F.coalesce("group", "b").alias("group"))
        known = known.unionByName(groups.join(known, "cls", "left_anti"))
    # a hub that no group holds yet is in its own
    roots = known.select(F.col("group").alias("cls"), "group").distinct()
    return known.unionByName(roots.join(known, "cls", "left_anti"))


def _dealt(groups: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """unit, cls, doc, cell: groups cut into units of bounded size, each class once; a cell is a unit."""
    dealt = groups.join(reps, "cls")
    # written first: a join with an aggregate's own partitions could not be split at run time
    parts = stage(dealt.groupBy("group").agg(_parts(F.count("*"), F.sum("n")).alias("parts")))
    unit = F.xxhash64("group", F.pmod(F.xxhash64("cls"), F.col("parts")))
    return dealt.join(parts, "group").select(unit.alias("unit"), "cls", "doc").withColumn("cell", F.col("unit"))


def _covered(groups: DataFrame, pairs: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame:
    """unit, cls, doc, cell: units of bounded size that hold every pair of different components of the groups that ``pairs`` reach.

    Of a group its largest component is dealt into parts and the loose rest into parts; every
    part of one meets every part of the other, and loose parts meet each other. Two of
    the largest component's need not meet. So a cell is a whole group.
    """
    anew = pairs.select(F.col("a").alias("cls")).join(groups, "cls").select("group").distinct()
    of = comps.select(F.col("node").alias("cls"), "comp")
    dealt = groups.join(anew, "group").join(reps, "cls").join(of, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    sizes = dealt.groupBy("group", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    main = sizes.groupBy("group").agg(F.max(F.struct("k", "comp", "n")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    main = main.select("group", F.col("main.comp").alias("main"), _parts(F.col("main.k"), F.col("main.n")).alias("mains"), _parts(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")).alias("loose")).where("loose > 0")
    rows = dealt.join(stage(main), "group")
    pick = lambda parts: F.pmod(F.xxhash64("cls"), F.col(parts)).cast("int")
    upto = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    unit = lambda kind, x, y: F.xxhash64("group", F.lit(kind), x, y)
    inner = rows.where("comp = main").select("group", "cls", "doc", F.explode(F.transform(upto("loose"), lambda i: unit("main", pick("mains"), i))).alias("unit"))
    own = rows.where("comp <> main").withColumn("own", pick("loose"))
    others = F.filter(upto("loose"), lambda j: j != F.col("own"))
    both = F.concat(F.transform(upto("mains"), lambda m: unit("main", m, F.col("own"))), F.transform(others, lambda j: unit("loose", F.least(j, F.col("own")), F.greatest(j, F.col("own")))))
    outer = own.select("group", "cls", "doc", F.explode(both).alias("unit"))
    return inner.unionByName(outer).select("unit", "cls", "doc", F.xxhash64("group", F.lit("cell")).alias("cell"))


def _stars(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """unit, cls, doc: each pair (a, b) in one unit, a's partners together."""
    sized = pairs.join(reps.select(F.col("cls").alias("b"), "n"), "b")
    parts = stage(sized.groupBy("a").agg(_parts(F.count("*"), F.sum("n")).alias("parts")))
    dealt = sized.join(parts, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("unit"), "a", "b")
    return dealt.select("unit", F.col("b").alias("cls")).unionByName(dealt.select("unit", F.col("a").alias("cls")).distinct()).join(reps.select("cls", "doc"), "cls")


def _decided(units: DataFrame, n: int, docs: DataFrame, comps: DataFrame | None, class_of) -> DataFrame:
    """a, b: components that links among each unit's classes join; ``units`` has n rows."""
    sets = stage(_sets(docs, units, n, class_of))
    rows = units.select("unit", "cls").join(sets, "cls")
    if comps is None:
        rows = rows.withColumn("comp", F.col("cls"))
    else:
        rows = rows.join(comps.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    return rows.groupBy("unit").applyInArrow(_unit_links, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked: exact set comparison of candidate pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            out = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield pa.record_batch([a, b, pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long, linked boolean")


def _enough(count, na, nb):
    """Shared prefix entries that a linked pair has at least: the overlap it needs less what may lie beyond a prefix."""
    need = F.ceil(F.lit(3) * (na + nb) / F.lit(7.0))
    beyond = F.greatest(na - prefix_length_sql(na), nb - prefix_length_sql(nb))
    return count >= need - beyond


def prefix_length_sql(n):
    return n - F.floor((F.lit(3) * n + F.lit(3)) / F.lit(4.0)) + F.lit(1)


def _fits(na, nb):
    return (F.lit(4) * na >= F.lit(3) * nb) & (F.lit(4) * nb >= F.lit(3) * na)


def _all_links(docs: DataFrame, reps: DataFrame, postings: DataFrame, comps: DataFrame, class_of) -> DataFrame:
    """a < b: every pair of classes of verified similarity; nothing runs before it is read.

    Linked classes share a component, so pairs are met within one. Classes under a shingle
    are salted: a task never holds all pairs of a common one.
    """
    rows = postings.join(comps.select(F.col("node").alias("cls"), "comp"), "cls")
    several = rows.groupBy("token", "comp").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("salts"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi")
    rows = rows.join(several.select("token", "comp", "salts"), ["token", "comp"])
    left = rows.select("token", "comp", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), F.col("cls").alias("a"), F.col("n").alias("na"))
    right = rows.select("token", "comp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("cls").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, ["token", "comp", "salt"]).where((F.col("a") < F.col("b")) & _fits(F.col("na"), F.col("nb")))
    met = met.groupBy("a", "b", "na", "nb").count()
    pairs = met.where(_enough(F.col("count"), F.col("na"), F.col("nb"))).select("a", "b")
    sets = _loaded(docs, reps.join(comps.select(F.col("node").alias("cls")), "cls").select("doc", F.col("cls").alias("want")), class_of)
    return _verified(pairs, sets).where("linked").select("a", "b")


def _ranked(postings: DataFrame, place: DataFrame | None) -> DataFrame:
    """token, main, f of shingles with several labels (written; no place: every class is its own).

    f counts the shingle's rows, main is the label that most classes have of all shingles, so
    that two large groups that share shingles do not change places.
    """
    if place is None:
        known = postings.select("token", F.col("cls").alias("label"), F.lit(1).cast("long").alias("held"))
    else:
        known = postings.select("token", "cls").join(place.select("cls", "label", "held"), "cls")
    top = known.groupBy("token").agg(F.max(F.struct("held", "label")).alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("f"))
    return stage(top.where("lo < hi").select("token", F.col("top.label").alias("main"), "f"))


def _sided(postings: DataFrame, place: DataFrame | None, top: DataFrame) -> DataFrame:
    """token, f, main, inner and the columns of ``place`` of the shingles in ``top`` (no place: every class is its own).

    What is inner (of the main label) hangs together or was compared before, so only the rest
    needs partners: a group of near copies makes no pairs of its own.
    """
    own = F.col("cls")
    rows = postings.select("token", "cls", "n", own.alias("comp"), own.alias("cell"), own.alias("label")) if place is None else postings.select("token", "cls").join(place, "cls")
    return rows.join(top.select("token", "main", "f"), "token").withColumn("inner", F.col("label") == F.col("main"))


def _hub_pairs(postings: DataFrame, place: DataFrame, top: DataFrame, round_: int) -> DataFrame:
    """a, b: each class and, of its shingles' hubs that it is not settled with, the one that shares most.

    Hubs of a shingle are the classes of smallest hash within its main label, one for each of
    some seeds; the hash is one to one, so it stands for the class. Two classes are settled if
    one component or one unit before held both.
    """
    seeds = [F.lit(round_ * HUBS + k) for k in range(HUBS if round_ else 1)]
    rows = _sided(postings, place if round_ else None, top)
    least = rows.where("inner").groupBy("token").agg(*[F.min(F.xxhash64("cls", x)).alias(f"hub{k}") for k, x in enumerate(seeds)])
    met = rows.where("not inner").select("token", "cls", (F.col("f") > CROWDED).alias("crowded")).join(least, "token")
    met = met.select("cls", "crowded", F.posexplode(F.array(*[f"hub{k}" for k in range(len(seeds))])).alias("seed", "hub"))
    met = met.groupBy("cls", "seed", "hub").agg(F.count("*").alias("count"), F.bool_or("crowded").alias("crowded"))
    of = place.select("cls", F.col("n").alias("m"), F.col("comp").alias("hub_comp"), F.col("cell").alias("hub_cell"), F.posexplode(F.array(*[F.xxhash64("cls", x) for x in seeds])).alias("seed", "hub"))
    met = met.join(of.withColumnRenamed("cls", "b"), ["seed", "hub"]).join(place.select("cls", "n", "comp", "cell"), "cls")
    met = met.where((F.col("comp") != F.col("hub_comp")) & (F.col("cell") != F.col("hub_cell")))
    enough = _fits(F.col("n"), F.col("m")) & _enough(F.col("count"), F.col("n"), F.col("m"))
    met = met.withColumn("enough", enough).where(F.col("enough") | (F.col("crowded") & F.lit(bool(round_))))
    return met.groupBy("cls").agg(F.max(F.struct("enough", "count", "b")).alias("best")).select(F.col("cls").alias("a"), "best.b")


def _crossing_pairs(postings: DataFrame, place: DataFrame | None, top: DataFrame) -> DataFrame:
    """a < b: every pair that the bounds allow and that neither a component nor a unit has settled.

    Rows meet under a shingle by bands of size (partners lie in the same or the next one) and
    by salts of about SALT rows, so neither a crowded shingle nor texts of unlike length are
    one task's pairs.
    """
    band = F.floor(F.log("n") / F.lit(math.log(4 / 3))).cast("int")
    salts = F.ceil(F.col("f") / F.lit(SALT)).cast("int")
    rows = _sided(postings, place, top).withColumns({"band": band, "salts": salts})
    left = rows.where("not inner").select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("cell").alias("ea"), "salts", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = rows.select("token", "band", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("cell").alias("eb"), "inner")
    met = left.join(right, ["token", "band", "salt"]).where((F.col("inner") | (F.col("a") < F.col("b"))) & (F.col("ca") != F.col("cb")) & (F.col("ea") != F.col("eb")) & _fits(F.col("na"), F.col("nb")))
    pair = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("both"), F.greatest("na", "nb").alias("most"))
    counted = pair.groupBy("a", "b", "both", "most").count()
    return counted.where(_enough(F.col("count"), F.col("both") - F.col("most"), F.col("most"))).select("a", "b")


def _tidy(spark: SparkSession) -> None:
    """Let finished steps' shuffle files go: they are only dropped when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Returns (members, links).

    members: doc (``id_key``), key (``set_key``, null without shingles), n, comp (the smallest class
    of the component), least (its smallest doc) per row of ``docs``; links as in ``ngram_jaccard_components``.
    """
    with small_batches(docs.sparkSession, "4m"):
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    narrow = docs.select(id_key(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    classes, reps, crowded, turn = _told_apart(narrow)
    class_of = partial(_class_of, crowded=crowded, turn=turn)
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, -(-total // BLOCK_BYTES))
    common = _common(narrow, blocks)
    postings, entries = counted_stage(_postings(narrow, common, blocks, class_of))
    _tidy(spark)

    comps = cells = groups = None
    sharing = stage(postings.select("cls").distinct().join(reps.select("cls", "n"), "cls"))
    round_, begun, met, last = 0, 0, 0, not entries
    left = postings
    while not last:
        last = round_ == HUB_ROUNDS or (round_ > 0 and not met) or (round_ > 1 and 10 * met <= begun)
        place = _placed(sharing, comps, cells)
        top = _ranked(left, place if round_ else None)
        if round_ == 1:
            # a shingle of one label is settled for good: all its classes hang together or were compared (most are after the first round)
            left = stage(left.join(top.select("token"), "token", "left_semi"))
        pairs, n = counted_stage(_crossing_pairs(left, place if round_ else None, top) if last else _hub_pairs(left, place, top, round_))
        begun, met, round_ = begun if round_ else n, n, round_ + 1
        if not n:
            continue
        if not last:
            groups = stage(_grouped(groups, pairs))
        units, n = counted_stage(_stars(pairs, reps) if last else _dealt(groups, pairs, reps) if comps is None else _covered(groups, pairs, reps, comps))
        links, n = counted_stage(_decided(units, n, narrow, comps, class_of))
        if n:
            comps = merged(comps, links)
        if not last:
            cell = units.select("cls", "cell").distinct()
            cells = cell if cells is None else stage(cell.unionByName(cells.join(cell, "cls", "left_anti")))
        _tidy(spark)
    if comps is None:
        comps = reps.select(F.col("cls").alias("node"), F.col("cls").alias("comp")).limit(0)

    # by class, so that a class or component of very many rows is a few numbers before rows join it
    by_class = reps.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc", F.coalesce("comp", "cls").alias("comp"))
    least = stage(by_class.groupBy("comp").agg(F.min("doc").alias("least")))
    by_class = stage(by_class.join(least, "comp").select("cls", "comp", "least"))
    member = classes.join(by_class, "cls", "left")
    return member.select("doc", "key", "n", "comp", "least"), _all_links(narrow, reps, postings, comps, class_of)


def _placed(sharing: DataFrame, comps: DataFrame | None, cells: DataFrame | None) -> DataFrame:
    """cls, n, comp, cell (what last compared it), label: its cell, or its component where that lies in several cells, and how many classes are held by the label.

    Two classes of one component, one cell or one label are settled.
    """
    place = sharing
    for found, name in ((comps, "comp"), (cells, "cell")):
        known = None if found is None else found.withColumnRenamed("node", "cls")
        place = place.withColumn(name, F.lit(None).cast("long")) if known is None else place.join(known, "cls", "left")
    place = place.select("cls", "n", F.coalesce("comp", "cls").alias("comp"), F.coalesce("cell", "cls").alias("cell"))
    if comps is None and cells is None:
        return place.select("*", F.col("cls").alias("label"), F.lit(1).cast("long").alias("held"))
    wide = place.groupBy("comp").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).where("lo < hi").select("comp", F.lit(True).alias("wide"))
    place = place.join(wide, "comp", "left").select("cls", "n", "comp", "cell", F.when(F.col("wide"), F.col("comp")).otherwise(F.col("cell")).alias("label"))
    held = place.groupBy("label").agg(F.count("*").alias("held"))
    return stage(place.join(held, "label").select("cls", "n", "comp", "cell", "label", "held"))


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Returns (documents, links).

    documents: doc_id, n_shingles, component_id per row of ``docs``; links: classes a < b of
    verified similarity, each named by a number of its set (sets are told apart by 128 bits).

    Defined cases: null text and texts without words have no shingles and are alone; rows
    with equal ids are linked each by its own text; a null id sorts last and
    stays null where its component has no other; an empty table gives an empty table; other
    columns are not carried. No cap anywhere: units and hubs only save comparisons that the
    components do not need; every pair of different components that the bounds allow is
    decided. ``links`` compares every pair that the bounds allow, k(k-1)/2 in a group of k
    texts that all link; it is evaluated only where it is read, and ``documents`` does not
    read it.
    """
    member, links = near_duplicates(docs, id_col, text_col)
    doc = F.when(F.col("doc") == NO_ID, F.lit(None)).otherwise(F.col("doc"))
    least = F.least(F.coalesce("least", "doc"), F.col("doc"))
    out = member.select(
        doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(least == NO_ID, F.lit(None)).otherwise(least).alias("component_id")
    )
    return out, links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
