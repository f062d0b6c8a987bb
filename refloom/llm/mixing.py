"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import own_prefix, stage, table

#: Target share of a source: its documents to this power, over the sum (0.5 lifts small sources).
ALPHA = 0.5
SEED = 17
#: Terms of the distribution at least; larger rates take as many as leave a tail under 2**-53.
TERMS = 48
#: Beyond this rate the distribution starts near its mean, since exp(-rate) would vanish.
FAR = 500.0


def unit(*columns) -> F.Column:
    """A uniform number in [0, 1) of 52 bits from an MD5 of the columns."""
    digest = F.md5(F.concat_ws("/", *columns))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _distribution(rate: F.Column, cdf: str, lo: str) -> list[F.Column]:
    """The distribution function at lo, lo + 1, ... as an array ``cdf``, and ``lo``; what lies outside is under 2**-53."""
    far = rate > FAR
    reach = F.ceil(F.sqrt(rate) * 10 + 36)
    first = F.when(far, F.floor(rate) - reach).otherwise(F.lit(0).cast("long"))
    last = F.when(far, F.floor(rate) + reach).otherwise(F.greatest(F.lit(TERMS).cast("long"), F.ceil(rate) + reach))
    # term(k) = term(k-1) * rate / k; beyond FAR up to a factor that the sum takes out
    term = F.when(far, F.lit(1e-40)).otherwise(F.exp(-rate))
    start = F.struct(term.alias("term"), term.alias("sum"), F.array(term).alias("cdf"))

    def step(acc, k):
        term = acc["term"] * rate / k
        total = acc["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.array_append(acc["cdf"], total).alias("cdf"))

    whole = F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: F.when(far, F.transform(acc["cdf"], lambda c: c / acc["sum"])).otherwise(acc["cdf"]))
    return [whole.alias(cdf), first.alias(lo)]


def _capped(sizes: DataFrame, rate: F.Column, n: float, max_rate: float) -> F.Column:
    """Rates of at most ``max_rate`` whose other sources share the rest; a step takes one small aggregate."""
    full = 0
    while True:
        over = rate >= max_rate
        found = sizes.agg(F.count_if(over).alias("k"), F.sum(F.when(over, F.col("mx_n"))).alias("n"), F.sum(F.when(~over, F.col("mx_w"))).alias("w")).first()
        if found["k"] <= full or not found["w"]:
            return F.least(F.lit(max_rate), rate)
        full = found["k"]
        rate = F.lit((n - max_rate * found["n"]) / found["w"]) * F.col("mx_w") / F.col("mx_n")


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: dict[str, float] | None = None,
    alpha: float = ALPHA,
    max_rate: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Each row repeated k times, in global random order, plus ``mix_copy`` and ``mix_key`` (long).

    k inverts the Poisson distribution whose mean is the row's target repetition rate
    ``total * share(source) / rows(source)``. The uniform number is a hash of seed and id,
    so runs repeat; a row without an id is hashed by its contents instead.
    With ``max_rate`` no mean is larger, and what such sources lose goes to the others by
    their shares; the total falls short only where all sources with a weight are at that rate.
    ``weights`` gives shares by source (sources not named get none); without it the share
    is rows**alpha, normalised. The global shuffle deals rows by a hash key and sorts
    each part by it.

    Defined cases: null source is a source of its own (no weight where ``weights`` is
    given); rows with equal id share their count, as do rows without an id whose columns
    (maps aside) are all equal; an empty table gives an empty table; other columns stay, and input columns called
    ``mix_copy`` or ``mix_key`` are replaced. A source that holds a third of all rows costs
    no more than others: counts combine before the shuffle, and the rate table has one row a source.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_copy", "mix_key")])
    mx = own_prefix(kept, "mx_")
    s, r, lo, u, k = (mx + x for x in ("source", "cdf", "lo", "u", "count"))
    sizes = kept.groupBy(F.col(source_col).alias(s)).agg(F.count("*").alias("mx_n"))
    if weights is None:
        share = F.sqrt("mx_n") if alpha == 0.5 else F.pow(F.col("mx_n").cast("double"), F.lit(alpha))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        named = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        share = F.coalesce(F.create_map(*named)[F.col(s)], F.lit(0.0)) if named else F.lit(0.0)
    sizes = sizes.withColumn("mx_w", share)
    if max_rate is not None:
        sizes = stage(sizes)
    total = sizes.agg(F.sum("mx_n").alias("n"), F.sum("mx_w").alias("w")).first()
    n, w = float(total["n"] or 0), float(total["w"] or 0.0)
    rate = F.lit(n) * F.col("mx_w") / F.lit(w or 1.0) / F.col("mx_n")
    if max_rate is not None:
        rate = _capped(sizes, rate, n, max_rate)
    rates = sizes.withColumn("mx_rate", rate).select(s, *_distribution(F.col("mx_rate"), r, lo))
    content = F.xxhash64(*[f.name for f in kept.schema.fields if "map<" not in f.dataType.simpleString()])
    doc = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null/"), content))
    drawn = unit(F.lit(str(seed)), F.lit("count"), doc)
    out = (
        kept.withColumn(u, drawn)
        .join(rates, kept[source_col].eqNullSafe(rates[s]))
        .withColumn(k, F.col(lo) + F.size(F.filter(F.col(r), lambda c: c <= F.col(u))))
        .where(F.col(k) > 0)
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(k).cast("long"))))
    )
    key = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit("order"), doc, F.col("mix_copy"))), 1, 15), 16, 10)
    out = out.withColumn("mix_key", key.cast("long")).select(*[F.col(c) for c in kept.columns], "mix_copy", "mix_key")
    return out.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle(source: str = "documents") -> str:
    """The same rows in DuckDB SQL, from a relation of documents with ids and rates up to FAR."""
    return f"""
WITH RECURSIVE mx_sizes AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM {source} GROUP BY source),
mx_rates AS (
  SELECT source, CAST((SELECT sum(n) FROM mx_sizes) AS DOUBLE) * w / (SELECT sum(w) FROM mx_sizes) / n AS rate
  FROM mx_sizes),
mx_cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS c FROM mx_rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), c + term * rate / (k + 1) FROM mx_cdf WHERE k < greatest({TERMS}, ceil(rate) + ceil(sqrt(rate) * 10 + 36))),
mx_lists AS (SELECT source, list(c ORDER BY k) AS cdf FROM mx_cdf GROUP BY source),
mx_drawn AS (
  SELECT d.*, len(list_filter(l.cdf, lambda c: c <= CAST(('0x' || substr(md5('{SEED}/count/' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / {float(2**52)})) AS n_copies
  FROM {source} d JOIN mx_lists l ON d.source IS NOT DISTINCT FROM l.source),
mx_out AS (SELECT * EXCLUDE (n_copies), unnest(generate_series(1, n_copies)) AS mix_copy FROM mx_drawn WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(mix_copy AS BIGINT) AS mix_copy,
       CAST(('0x' || substr(md5('{SEED}/order/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || mix_copy), 1, 15)) AS BIGINT) AS mix_key
FROM mx_out
"""


ORACLE = oracle()
