"""Line dedup: drop lines that other documents already hold. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import WS_CHARS, ascii_lower, id_key, own_prefix, stage, table, text_of

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """Outer white space stripped, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(WS_CHARS)))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, plus ``n_lines`` and ``n_dropped`` (long).

    Texts split at ``\\n``; a line's key is the stripped, ASCII-lower-cased line, kept as
    a 128-bit hash. A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines except in the smallest id holding it.

    Defined cases: null or empty text is one empty line; a null id counts as larger than
    every id; rows with equal id are one document when holders are counted, and each row
    is rewritten; an empty table gives an empty table; other columns stay, and input
    columns called ``n_lines`` or ``n_dropped`` are replaced.

    Counting combines before the shuffle. The join of lines with their keys has one row
    per key on one side, so a key that a third of all documents hold is split at run time.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    ld = own_prefix(kept, "ld_")
    i, t = f"{ld}id", f"{ld}text"
    rows = kept.withColumns({i: id_key(id_col), t: F.xxhash64(text_of(text_col))})

    lines = (
        rows.select(i, t, F.posexplode(F.split(text_of(text_col), "\n")).alias(f"{ld}pos", f"{ld}line"))
        .select(i, t, f"{ld}pos", line_key(F.col(f"{ld}line")).alias(f"{ld}key"))
        .where(F.length(f"{ld}key") >= min_chars)
        .select(i, t, f"{ld}pos", F.xxhash64(f"{ld}key").alias(f"{ld}h1"), F.xxhash64(F.lit(8), f"{ld}key").alias(f"{ld}h2"))
    )
    if min_docs <= 2:
        holders = lines.groupBy(f"{ld}h1", f"{ld}h2").agg(F.min(i).alias(f"{ld}owner"), F.max(i).alias(f"{ld}last"))
        shared = holders.where(F.col(f"{ld}owner") < F.col(f"{ld}last")) if min_docs == 2 else holders
    else:
        holders = lines.select(f"{ld}h1", f"{ld}h2", i).distinct().groupBy(f"{ld}h1", f"{ld}h2")
        shared = holders.agg(F.min(i).alias(f"{ld}owner"), F.count("*").alias(f"{ld}n")).where(F.col(f"{ld}n") >= min_docs)
    # written first: a join with an aggregate's own partitions could not be split at run time
    shared = stage(shared.select(f"{ld}h1", f"{ld}h2", f"{ld}owner"))
    drops = (
        lines.join(shared, [f"{ld}h1", f"{ld}h2"])
        .where(F.col(i) > F.col(f"{ld}owner"))
        .groupBy(i, t)
        .agg(F.collect_set(f"{ld}pos").alias(f"{ld}drop"))
    )
    split = F.split(text_of(text_col), "\n")
    joined = rows.join(drops, [i, t], "left").withColumn(f"{ld}lines", split)
    left = F.array_except(F.sequence(F.lit(0), F.size(f"{ld}lines") - 1), F.col(f"{ld}drop"))
    # rows without drops keep their text as it is, so the arrays are built for the others only
    text = F.when(F.col(f"{ld}drop").isNull(), text_of(text_col)).otherwise(
        F.array_join(F.transform(left, lambda k: F.get(F.col(f"{ld}lines"), k)), "\n")
    )
    out = joined.withColumns(
        {
            "n_lines": F.size(f"{ld}lines").cast("long"),
            "n_dropped": F.coalesce(F.size(f"{ld}drop"), F.lit(0)).cast("long"),
            f"{ld}text_out": text,
        }
    )
    columns = [F.col(f"{ld}text_out").alias(c) if c == text_col else F.col(c) for c in kept.columns]
    return out.select(*columns, "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id > owner, false) AS dropped
  FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
