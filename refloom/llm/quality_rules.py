"""Quality rules by weak supervision. DataFrame and SQL functions only.

Rules over document statistics vote good, vote bad or abstain. Expectation-maximisation
over the counts of vote patterns estimates how often each rule is right on good and on
bad documents; a document is kept when its posterior probability of being good is at
least one half and the base filter passes. Only documents that pass the base filter
take part in the estimation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.common import WS_CLASS, own_prefix, stage, table, text_of

#: Statistics of a text, all long.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_STATS = ("n_unique", "n_text_lines", "n_upper", "n_lower", "n_bangs")


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the statistics (integer arithmetic, so every engine agrees)."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "n_words >= 100"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words < 15 * n_words"),
    Rule("dup_lines", "100 * n_dup_lines > 30 * n_text_lines", "100 * n_dup_lines < 10 * n_text_lines"),
    Rule("caps", "n_upper > n_lower", "4 * n_upper < n_lower"),
    Rule("bangs", "5 * n_bangs > n_words", "50 * n_bangs < n_words"),
    Rule("variety", "100 * n_unique < 15 * n_words", "100 * n_unique > 30 * n_words"),
    Rule("word_length", "word_chars > 14 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words AND n_words > 0"),
)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

#: Rounds of expectation-maximisation and its start: the share of good documents, and how
#: often a voting rule is right on a good one (rules are written to spare good documents) and
#: on a bad one (each rule knows one kind of junk). PRIOR pseudo-votes at these rates smooth.
ROUNDS = 15
START_GOOD, PRIOR = 0.8, 5.0
START_RIGHT = {"a": 0.998, "b": 0.3}
#: Rules are written to spare good documents, so none is taken to be wrong on more of them than
#: this leaves. Without the bound one frequent kind of junk can pass for a habit of good documents.
LEAST_RIGHT = 0.995


def document_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the statistics, computed within each row (no shuffle, codegen and array functions).

    Words are maximal runs without white space. A three-word window counts as repeated
    when its 64-bit hash occurs twice in the text; sorting a text's windows by hash puts
    equal ones side by side, so the cost is n log n even for a text of one repeated word.
    Null text has no words.
    """
    text, qr = text_of(text_col), own_prefix(docs, "qr_")
    out = docs.withColumns(
        {
            f"{qr}words": F.array_remove(F.split(text, f"[{WS_CLASS}]+"), ""),
            f"{qr}lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS_CLASS}]")),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size(f"{qr}words").cast("long"),
            "word_chars": F.length(F.array_join(f"{qr}words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size(f"{qr}lines") - F.size(F.array_distinct(f"{qr}lines"))).cast("long"),
            "n_text_lines": F.size(f"{qr}lines").cast("long"),
            "n_unique": F.size(F.array_distinct(f"{qr}words")).cast("long"),
            "n_upper": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long"),
            "n_lower": (F.length(text) - F.length(F.regexp_replace(text, "[a-z]+", ""))).cast("long"),
            "n_bangs": (F.length(text) - F.length(F.regexp_replace(text, "!", ""))).cast("long"),
            # windows as (hash, start), equal hashes side by side
            f"{qr}sorted": F.expr(
                f"if(size({qr}words) < 4, cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(sequence(0, size({qr}words) - 3), "
                f"i -> named_struct('h', xxhash64(get({qr}words, i), get({qr}words, i + 1), get({qr}words, i + 2)), 'i', i))))"
            ),
        }
    )
    out = out.withColumn(
        f"{qr}starts",
        F.expr(
            f"if(size({qr}sorted) < 2, cast(array() as array<int>), sort_array(transform(filter({qr}sorted, (x, k) -> "
            f"coalesce(get({qr}sorted, k - 1).h = x.h, false) OR coalesce(get({qr}sorted, k + 1).h = x.h, false)), x -> x.i)))"
        ),
    )
    # words covered by the windows: each start adds three words less the overlap with the next start
    out = out.withColumn(
        "n_repeat_words",
        F.expr(
            f"if(size({qr}starts) = 0, 0L, aggregate(transform({qr}starts, (s, k) -> least(3, coalesce(get({qr}starts, k + 1), s + 3) - s)), 0L, (a, x) -> a + x))"
        ),
    )
    # a generator keeps later filters on the statistics above their computation: pushed below,
    # they would evaluate the nested arrays once for every mention
    stats = F.struct(*[F.col(c) for c in (*STATS, *MORE_STATS)])
    return out.select(*[F.col(c) for c in docs.columns], F.inline(F.array(stats)))


def vote_sql(rule: Rule) -> str:
    return f"CASE WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END"


def log_odds_sql(params: dict[str, str], rules=RULES, vote: str = "v") -> str:
    """Log odds of being good, from the votes and the parameters' SQL."""
    terms = [f"ln({params['p']} / (1 - {params['p']}))"]
    for j in range(len(rules)):
        a, b = params[f"a{j}"], params[f"b{j}"]
        terms.append(f"CASE {vote}{j} WHEN 1 THEN ln({a} / (1 - {b})) WHEN -1 THEN ln((1 - {a}) / {b}) ELSE 0.0 END")
    return " + ".join(terms)


def sums_sql(rules=RULES) -> list[tuple[str, str]]:
    """The expected counts that a round adds up, as (name, SQL over post, c and the votes)."""
    out = [("g", "sum(c * post)"), ("t", "sum(c)")]
    for j in range(len(rules)):
        out += [
            (f"ga{j}", f"sum(CASE WHEN v{j} = 1 THEN c * post ELSE 0.0 END)"),
            (f"gn{j}", f"sum(CASE WHEN v{j} <> 0 THEN c * post ELSE 0.0 END)"),
            (f"bb{j}", f"sum(CASE WHEN v{j} = -1 THEN c * (1 - post) ELSE 0.0 END)"),
            (f"bn{j}", f"sum(CASE WHEN v{j} <> 0 THEN c * (1 - post) ELSE 0.0 END)"),
        ]
    return out


def estimate(patterns: DataFrame, rules=RULES, rounds: int = ROUNDS) -> dict[str, float]:
    """Expectation-maximisation over (votes v0.., count c); every round is one aggregate.

    There are at most 3**rules patterns, whatever the number of documents; the driver
    only carries the round's parameters.
    """
    params = {"p": START_GOOD} | {f"{k}{j}": START_RIGHT[k] for k in "ab" for j in range(len(rules))}
    for _ in range(rounds):
        odds = log_odds_sql({k: f"{v!r}D" for k, v in params.items()}, rules)
        sums = patterns.selectExpr("*", f"1 / (1 + exp(-({odds}))) AS post").agg(*[F.expr(sql).alias(n) for n, sql in sums_sql(rules)]).first()
        if not sums["t"]:
            return params
        params = {"p": (sums["g"] + PRIOR * START_GOOD) / (sums["t"] + PRIOR)}
        for j in range(len(rules)):
            params[f"a{j}"] = max(LEAST_RIGHT, (sums[f"ga{j}"] + PRIOR * START_RIGHT["a"]) / (sums[f"gn{j}"] + PRIOR))
            params[f"b{j}"] = (sums[f"bb{j}"] + PRIOR * START_RIGHT["b"]) / (sums[f"bn{j}"] + PRIOR)
    return params


def quality_rules(docs: DataFrame, text_col: str = "text", rules=RULES, keep_text: bool = True) -> DataFrame:
    """``docs`` plus statistics, ``base_failed``, ``quality`` (posterior) and ``kept``.

    The statistics are computed in one pass over the texts and written once, with the rows'
    columns (without the text unless ``keep_text``); vote patterns are counted (a combining
    aggregate of at most 3**rules rows) and verdicts given from there. No text is shuffled.

    Defined cases: null text has no words, so the base filter fails; an empty table gives
    an empty table; equal rows get equal verdicts; a rule whose conditions both fail
    abstains; input columns named like an output are replaced, others stay.
    """
    outputs = {*STATS, *MORE_STATS, "base_failed", "quality", "kept"}
    kept = docs.drop(*[c for c in docs.columns if c.lower() in outputs])
    v = own_prefix(kept, "v")
    votes = {f"{v}{j}": F.expr(vote_sql(r)) for j, r in enumerate(rules)}
    found = document_stats(kept, text_col)
    found = stage(found if keep_text else found.drop(text_col))
    # documents that the base filter rejects anyway would teach the rules about a kind of junk that is gone
    patterns = found.where(f"NOT ({BASE_FAILED})").groupBy(*[x.alias(f"v{j}") for j, x in enumerate(votes.values())])
    params = estimate(stage(patterns.agg(F.count("*").cast("double").alias("c")).coalesce(1)), rules)
    odds = log_odds_sql({k: f"{x!r}D" for k, x in params.items()}, rules, v)
    out = found.withColumns(votes).withColumns({"base_failed": F.expr(BASE_FAILED), "quality": F.expr(f"1 / (1 + exp(-({odds})))")})
    return out.withColumn("kept", F.expr("NOT base_failed AND quality >= 0.5")).drop(*votes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, keep_text=False).select("doc_id", *STATS, "base_failed", "kept")


def oracle(source: str = "documents", final: str | None = None) -> str:
    """The same in DuckDB SQL; expectation-maximisation becomes a chain of one-row relations."""
    n = len(RULES)
    w = r"[^\x20\x09-\x0D]"
    parts = [
        f"""qr_t AS (SELECT *, row_number() OVER () AS qr_row, coalesce(text, '') AS qr_text FROM {source})""",
        f"""qr_w AS (SELECT *, regexp_extract_all(qr_text, '{w}+') AS words,
  list_filter(string_split(qr_text, chr(10)), lambda x: regexp_matches(x, '{w}')) AS lines FROM qr_t)""",
        """qr_win AS (SELECT qr_row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT qr_row, words, unnest(generate_series(1, len(words) - 2)) AS i FROM qr_w WHERE len(words) >= 3))""",
        """qr_rep AS (SELECT qr_row, i FROM (SELECT qr_row, i, count(*) OVER (PARTITION BY qr_row, g) AS n FROM qr_win) WHERE n > 1)""",
        """qr_cov AS (SELECT qr_row, count(*) AS covered FROM (SELECT DISTINCT qr_row, unnest([i, i + 1, i + 2]) AS p FROM qr_rep) GROUP BY qr_row)""",
        """qr_stats AS (SELECT qr_w.*, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(qr_text) - length(regexp_replace(qr_text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(len(lines) AS BIGINT) AS n_text_lines, CAST(len(list_distinct(words)) AS BIGINT) AS n_unique,
  CAST(length(qr_text) - length(regexp_replace(qr_text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(qr_text) - length(regexp_replace(qr_text, '[a-z]', '', 'g')) AS BIGINT) AS n_lower,
  CAST(length(qr_text) - length(replace(qr_text, '!', '')) AS BIGINT) AS n_bangs,
  CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words
  FROM qr_w LEFT JOIN qr_cov USING (qr_row))""",
        "qr_votes AS MATERIALIZED (SELECT *, " + ", ".join(f"{vote_sql(r)} AS v{j}" for j, r in enumerate(RULES)) + " FROM qr_stats)",
        "qr_pat AS MATERIALIZED (SELECT " + ", ".join(f"v{j}" for j in range(n)) + f", CAST(count(*) AS DOUBLE) AS c FROM qr_votes WHERE NOT ({BASE_FAILED}) GROUP BY ALL)",
        f"qr_p0 AS (SELECT {START_GOOD}::DOUBLE AS p, " + ", ".join(f"{START_RIGHT[k]}::DOUBLE AS {k}{j}" for k in "ab" for j in range(n)) + ")",
    ]
    names = {k: k for k in ["p", *[f"{x}{j}" for x in "ab" for j in range(n)]]}
    odds = log_odds_sql(names)
    sums = ", ".join(f"{sql} AS {name}" for name, sql in sums_sql())
    for k in range(ROUNDS):
        parts.append(f"qr_s{k} AS MATERIALIZED (SELECT {sums} FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS post FROM qr_pat, qr_p{k}))")
        parts.append(
            f"qr_p{k + 1} AS MATERIALIZED (SELECT (g + {PRIOR * START_GOOD}) / (t + {PRIOR}) AS p, "
            + ", ".join(
                f"greatest({LEAST_RIGHT}, (ga{j} + {PRIOR * START_RIGHT['a']}) / (gn{j} + {PRIOR})) AS a{j}, (bb{j} + {PRIOR * START_RIGHT['b']}) / (bn{j} + {PRIOR}) AS b{j}" for j in range(n)
            )
            + f" FROM qr_s{k})"
        )
    final = final or "SELECT doc_id, " + ", ".join(STATS) + f", ({BASE_FAILED}) AS base_failed, (NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5) AS kept FROM qr_votes, qr_p{ROUNDS}"
    return "WITH " + ",\n".join(parts) + "\n" + final


ORACLE = oracle()
