"""Source divergence audit by sorting: how far the word use of a language's sources lies apart.

Two sorts carry it. The first brings the runs of (lang, term, source, document) together: a task
counts its own documents first and hands on one row for each (lang, term, source) that it met,
with the first document of that run, so a very frequent term is a few rows of each task. A scan of
the sorted runs adds up document frequency and counts, and keeps a term once enough documents
have it. The second sort brings a language's kept terms in ranges past its sources' totals; a
scan of each range yields partial sums for pairs of sources and the range's leading terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.llm.common import counted_stage, small_batches, stage, table, text_of

#: Documents of a language that a kept term is in at least; smoothing; scale of shares; terms listed a source.
MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Runs that a task gathers before it sends them on (some 60 bytes each).
GATHERED = 1_500_000
#: Kept rows of a range of terms on average; sources of a language that meet in one scan (times two).
RANGE_ROWS, BLOCK_SOURCES = 100_000, 256
#: Cells (terms times sources) that a scan holds at once.
CELLS = 1 << 20

#: Bytes to lower-case letters and bytes beyond ASCII; all others become spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total), exact for totals below 9e15 (count <= total)."""
    share, rest = count // total, count % total
    for _ in range(3):  # three decimal digits at a time stay within 64 bits
        rest = rest * 1000
        share, rest = share * 1000 + rest // total, rest % total
    return share + 1


RUNS = ["lang", "term", "source"]


def _runs_of(batch: pa.RecordBatch) -> pa.Table:
    """lang, term, source, doc (the smallest of the run), docs, n: the runs of a batch (doc, lang, source, text), by sorting its terms."""
    texts = batch.column(3).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = bytes(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].translate(_LETTERS)
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(letters)))
    terms = pc.list_flatten(lists).dictionary_encode()
    term, of = terms.indices.to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    there = pc.not_equal(terms.dictionary, "").to_numpy(zero_copy_only=False)[term] if len(term) else np.zeros(0, bool)
    langs, sources = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    # one number for (group, term, document) sorts as the three do
    rows, width = len(texts), max(1, len(terms.dictionary))
    found = np.sort(((group[of] * width + term) * rows + of)[there])
    at = np.flatnonzero(np.diff(found, prepend=-1))
    n, pair = np.diff(at, append=len(found)), found[at] // rows
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    docs = ids = first
    if len(first):
        docs, n, ids = np.diff(first, append=len(pair)), np.add.reduceat(n, first), np.minimum.reduceat(batch.column(0).to_numpy()[found[at] % rows], first)
    group, term = np.divmod(pair[first], width)
    lang, source = np.divmod(group, max(1, len(sources.dictionary)))
    take = lambda values, k: values.take(pa.array(k))
    return pa.table({"lang": take(langs.dictionary, lang), "term": take(terms.dictionary, term).cast(pa.string()), "source": take(sources.dictionary, source), "doc": ids, "docs": docs, "n": n})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, source, doc (the smallest of the run), docs, n: a row for each (lang, term, source) among a task's documents, as far as GATHERED."""
    held, size = [], 0

    def together() -> pa.Table:
        out = pa.concat_tables(held).group_by(RUNS, use_threads=False).aggregate([("doc", "min"), ("docs", "sum"), ("n", "sum")])
        return out.rename_columns([c.removesuffix("_min").removesuffix("_sum") for c in out.column_names]).select([*RUNS, "doc", "docs", "n"])

    for batch in filter(len, batches):
        held.append(_runs_of(batch))
        size += len(held[-1])
        if size >= GATHERED:
            held = [together()]
            size = len(held[0])
            if 2 * size >= GATHERED:
                yield from held[0].to_batches(20_000)
                held, size = [], 0
    if held:
        yield from together().to_batches(20_000)
    pa.default_memory_pool().release_unused()


def _changes(*columns: pa.ChunkedArray) -> np.ndarray:
    """Whether each row differs from the row before it in any of ``columns`` (the first does)."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return new


def _merged(rows: pa.Table) -> pa.Table:
    """Sorted runs of one (lang, term, source) as one."""
    at = np.flatnonzero(_changes(rows["lang"], rows["term"], rows["source"]))
    total = {c: pa.array(np.add.reduceat(rows[c].to_numpy(), at)) for c in ("docs", "n")}
    first = rows.select(["lang", "term", "source"]).take(pa.array(at))
    return pa.table({**{c: first[c] for c in first.column_names}, **total})


def _kept_terms(min_docs: int):
    """A scan of sorted runs: lang, term, source, n, all_n, lead of terms in at least ``min_docs`` documents."""

    def kept(rows: pa.Table) -> pa.RecordBatch:
        new = _changes(rows["lang"], rows["term"])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(new)))
        docs, n = np.add.reduceat(rows["docs"].to_numpy(), at), np.add.reduceat(rows["n"].to_numpy(), at)
        found = rows.select(["lang", "term", "source", "n"]).append_column("all_n", pa.array(np.repeat(n, length))).append_column("lead", pa.array(new.astype(np.int64)))
        return found.filter(pa.array(np.repeat(docs >= min_docs, length))).combine_chunks()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # the last term's rows: one for each source at most
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(["lang", "term", "source", "docs", "n"])
            rows = _merged(rows if open_ is None else pa.concat_tables([open_, rows])) if len(rows) else open_
            if rows is None:
                continue
            last = int(np.flatnonzero(_changes(rows["lang"], rows["term"]))[-1])
            open_ = rows.slice(last)
            if last:
                yield from kept(rows.slice(0, last)).to_batches()
        if open_ is not None:
            yield from kept(open_).to_batches()

    return scan


class _Range:
    """What a range of one language's terms adds for the sources (and pairs of them) of its block."""

    def __init__(self, lang: str, half: int, heads: pa.Table):
        self.lang, self.sources = lang, heads["source"].to_pylist()
        self.at = {s: i for i, s in enumerate(self.sources)}
        self.total, self.half = heads["n"].to_numpy() + SMOOTH * heads["kept"].to_numpy(), half
        self.all_total = int(heads["all_n"][0].as_py()) + SMOOTH * int(heads["kept"][0].as_py())
        self.absent = _share(np.full(len(self.total), SMOOTH, np.int64), self.total)
        block = heads["block"].to_numpy()
        # of two different blocks only the pairs across belong here
        self.own = np.triu(np.ones((len(block), len(block)), bool), 1) if not half else (block[:, None] < block)
        self.away = np.abs(self.absent[:, None] - self.absent)
        self.sums = np.zeros((len(self.total), len(self.total)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in self.sources]

    def add(self, rows: pa.Table) -> None:
        """Whole runs of terms, of at most CELLS cells."""
        at = np.flatnonzero(_changes(rows["term"]))
        run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(rows))))
        of = np.array([self.at[s] for s in rows["source"].to_pylist()], np.int64)
        here = _share(rows["n"].to_numpy() + SMOOTH, self.total[of])
        shares = np.repeat(self.absent[None, :], len(at), axis=0)
        shares[run, of] = here
        for i in range(len(self.sources)):
            self.sums[i] += np.abs(shares[:, i : i + 1] - shares).sum(axis=0) - len(at) * self.away[i]
        if self.half:
            return
        over = here - _share(rows["all_n"].to_numpy() + SMOOTH, np.int64(self.all_total))
        terms = rows["term"].to_pylist()
        for i in np.unique(of[over > 0]).tolist():
            mine = np.flatnonzero((of == i) & (over > 0))
            if len(mine) > TOP:  # ties with the last one stay until terms decide
                mine = mine[over[mine] >= np.partition(over[mine], len(mine) - TOP)[len(mine) - TOP]]
            self.best[i] = sorted(self.best[i] + [(-int(over[k]), terms[k].encode()) for k in mine.tolist()])[:TOP]

    def out(self) -> pa.RecordBatch:
        """lang, source, part, item, value: partial sums of pairs (each once), leading terms."""
        rows = [(*sorted((self.sources[i], self.sources[j]), key=str.encode), int(self.sums[i, j])) for i, j in zip(*np.nonzero(self.sums * self.own), strict=True)]
        rows = [(a, "pair", b, more) for a, b, more in rows]
        rows += [(s, "term", term.decode(), -value) for s, best in zip(self.sources, self.best, strict=True) for value, term in best]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.record_batch([pa.array([self.lang] * len(rows), pa.string()), *columns], names=["lang", "source", "part", "item", "value"])


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A scan of sorted ranges (lang, x, y, range): heads (the empty term) come first, then runs of terms."""
    known, range_, open_ = None, None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if open_ is not None:
            rows = pa.concat_tables([open_, rows])
        if not len(rows):
            continue
        new = _changes(rows["lang"], rows["x"], rows["y"], rows["range"], rows["term"])
        starts = np.flatnonzero(new).tolist()
        open_ = rows.slice(starts[-1])  # a term's rows (or heads) are BLOCK_SOURCES times two at most on average
        rows = rows.slice(0, starts[-1])
        for known, range_, done in _walked(rows, known, range_):
            if done is not None:
                yield done
    if open_ is not None:
        for known, range_, done in _walked(open_, known, range_):
            if done is not None:
                yield done
    if range_ is not None:
        yield range_.out()
    pa.default_memory_pool().release_unused()


def _walked(rows: pa.Table, known, range_):
    """Takes whole runs; yields the range it is in, and what an ended one has found."""
    if not len(rows):
        return
    cuts = np.flatnonzero(_changes(rows["lang"], rows["x"], rows["y"], rows["range"])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
        part = rows.slice(a, b - a)
        key = tuple(part[c][0].as_py() for c in ("lang", "x", "y", "range"))
        heads = int(np.count_nonzero(pc.equal(part["term"], "").to_numpy(zero_copy_only=False)))
        if key != known:
            done, known = None if range_ is None else range_.out(), key
            range_ = _Range(key[0], key[1] != key[2], part.slice(0, heads))
            yield known, range_, done
        body = part.slice(heads)
        if len(body):
            starts = np.flatnonzero(_changes(body["term"]))
            some = max(1, CELLS // max(1, len(range_.sources)))
            edges = [*starts[::some].tolist(), len(body)]
            for i, j in zip(edges, edges[1:], strict=False):
                range_.add(body.slice(i, j - i))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value (long), rank (int, from 1 in each group and part).

    Part ``pair``: how far each other source of the language lies from this one, summed over all
    kept terms; part ``term``: the ``top`` terms that this source uses most above its language.

    Defined cases: null text, lang or source counts as empty; a language without kept terms has
    pairs of value 0; a source that is alone in its language has no pairs; every row is a
    document of its own, also where ids repeat or are null; equal values are ordered by the
    item's bytes; an empty table gives an empty table; other columns are not carried.

    Sources of a language beyond BLOCK_SOURCES are dealt into blocks of which two meet at a time,
    terms into ranges, so no task holds a language's sources or terms whole; the result's own
    size, sources squared, remains.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    groups = stage(read.select("lang", "source").distinct())
    order = ["term", "lang", "source", "doc"]  # terms differ in their first bytes, which a sort compares first; languages hardly do
    with small_batches(spark):
        runs = read.mapInArrow(_runs, "lang string, term string, source string, doc long, docs long, n long")
        runs = runs.repartition("lang", "term").sortWithinPartitions(*order)
        kept, n_kept = counted_stage(runs.mapInArrow(_kept_terms(min_docs), "lang string, term string, source string, n long, all_n long, lead long"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("lead").alias("kept"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(BLOCK_SOURCES)).cast("int").alias("blocks"))
    ranges = max(1, -(-(n_kept or 0) // RANGE_ROWS))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
    groups = stage(groups.select("lang", "source", zero("n"), zero("all_n"), zero("kept"), "blocks", block))

    # a row of block b goes to every pair of blocks (x <= y) that has b
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = F.explode(F.transform(others, lambda o: F.named_struct(F.lit("x"), F.least(o, F.col("block")), F.lit("y"), F.greatest(o, F.col("block"))))).alias("met")
    width = groups.select("lang", "blocks").distinct()
    body = kept.join(width, "lang").withColumn("block", block).select("lang", met, "block", "term", "source", "n", "all_n", F.lit(0).cast("long").alias("kept"), F.pmod(F.xxhash64("term"), F.lit(ranges)).cast("int").alias("range"))
    heads = groups.where("kept > 0").select("lang", met, "block", F.lit("").alias("term"), "source", "n", "all_n", "kept", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"))
    key = ["lang", "x", "y", "range"]
    dealt = body.unionByName(heads).select("lang", "met.x", "met.y", "range", "term", "source", "block", "n", "all_n", "kept")
    with small_batches(spark):
        scanned = dealt.repartition(*key).sortWithinPartitions(*key, "term", "source")
        partial = stage(scanned.mapInArrow(_scan_ranges, "lang string, source string, part string, item string, value long"))

    # a pair's sum is that of two sources without any of the terms, corrected where one has them
    pairs = partial.where("part = 'pair'").groupBy("lang", F.col("source").alias("a"), F.col("item").alias("b")).agg(F.sum("value").alias("more"))
    bare = F.when(F.col("kept") > 0, F.expr(f"1 + {UNIT * SMOOTH}L div (n + {SMOOTH} * kept)")).otherwise(F.lit(0))
    side = lambda name, *more: groups.select("lang", F.col("source").alias(name), bare.alias(f"{name}_bare"), *more)
    every = side("a", "kept").join(side("b"), "lang").where("a < b").join(pairs, ["lang", "a", "b"], "left")
    every = every.select("lang", "a", "b", (F.col("kept") * F.abs(F.col("a_bare") - F.col("b_bare")) + F.coalesce("more", F.lit(0))).alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("ends")
    every = every.select("lang", ends, "value").select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")
    found = every.unionByName(partial.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return found.select("*", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


ORACLE = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS MATERIALIZED (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
terms AS MATERIALIZED (SELECT lang, term, count(*) AS all_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
counted AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN terms USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY lang, source) USING (lang, source)),
langs AS (SELECT lang, sum(all_n) AS all_total, count(*) AS v FROM terms GROUP BY lang),
shares AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         CAST(1 + (CAST({UNIT} AS HUGEINT) * (coalesce(n, 0) + {SMOOTH})) // (total + {SMOOTH} * v) AS BIGINT) AS p,
         CAST(1 + (CAST({UNIT} AS HUGEINT) * (all_n + {SMOOTH})) // (all_total + {SMOOTH} * v) AS BIGINT) AS q
  FROM groups JOIN langs USING (lang) JOIN terms USING (lang) LEFT JOIN counted USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= {TOP}
"""
