"""From raw documents to packed training sequences, stage by stage.

Every stage takes all documents that its predecessor kept and returns the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import NO_ID, fresh, id_key, spent_stages, stage
from refloom.llm.line_dedup import line_dedup
from refloom.llm.mixing import mix
from refloom.llm.ngram_join import near_duplicates, with_key
from refloom.llm.packing import VOCABULARY, best_fit_packing
from refloom.llm.quality_rules import quality_rules


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller id already holds go; ``n_chars`` follows the text."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: of its smallest id, and of that id's texts one class.

    A row is told by its id and its text's set of shingles (128 bits), so different texts without an id, or with
    a repeated one, each stay as the survivor of their own component. A null id survives only
    where its component has no other. Rows without shingles are alone: of equal id and equal
    text one stays.
    """
    members, _ = near_duplicates(docs)
    first = members.where("key is not null").groupBy("comp").agg(F.min(F.struct("doc", "key")).alias("first")).select("first.doc", "first.key")
    keep = first.unionByName(members.where("key is null").select("doc", "key").distinct())
    counted = members.groupBy("doc").agg(((F.count("*") > 1) | (F.col("doc") == NO_ID)).alias("by_text"))
    keep = stage(keep.join(counted, "doc"))
    key, cls, rest = fresh(docs, "nj_id"), fresh(docs, "nj_class"), fresh(docs, "nj_rest")
    rows = docs.withColumn(key, id_key("doc_id"))
    by_id = keep.where("not by_text").select(F.col("doc").alias(key))
    by_text = keep.where("by_text").select(F.col("doc").alias(key), F.col("key").alias("kept_key"))
    single = rows.join(by_id, key, "left_semi")
    # only rows whose id does not tell them are hashed again
    several = with_key(rows.join(by_text.select(key).distinct(), key, "left_semi"), name=cls)
    several = several.join(by_text, (several[key] == by_text[key]) & several[cls].eqNullSafe(by_text["kept_key"]), "left_semi")
    several = several.withColumn(rest, F.when(F.col(cls).isNull(), F.struct("text"))).dropDuplicates([key, cls, rest])
    return single.select(*docs.columns).unionByName(several.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) so that sources meet their target weights, in random order."""
    return mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 4096 tokens."""
    return best_fit_packing(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenisation and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        with spent_stages(spark):  # what a stage wrote on its way is emptied once its result stands
            docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
