"""Small tests of the training-data operators against brute force, with the defined edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refloom.llm import ann, chat, components, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, repeats, toxicity

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain_construction  # noqa: E402

LONG = " ".join(f"word{i % 700}" for i in range(6000))
#: Null and empty texts, one very long one, repeated rows, equal texts, ties; columns that clash with outputs.
DOCS = [
    (1, "Hello there my old friend\nshared line number one\nx", "en", "a", 5),
    (2, "another text\n  SHARED line number one  \ny", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, LONG, "en", "a", 9),
    (6, LONG + " tail", "en", "b", 9),
    (7, "same words again here now ok", "fr", "b", 9),
    (7, "same words again here now ok", "fr", "b", 9),
    (None, "shared line number one\nno id", "en", "c", 1),
    (8, "short", "en", "c", 1),
    (9, "\n\n", "en", "c", 1),
    (10, "é" * 30 + " ünï " * 40, "de", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- line dedup ---------------------------------------------------------------------------


def test_line_dedup(docs, nothing):
    clash = docs.withColumns({"n_lines": F.lit("x"), "ld_id": F.lit(1)})
    got = [r.asDict() for r in line_dedup.line_dedup(clash).collect()]
    assert len(got) == len(DOCS) and all(r["ld_id"] == 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"].split("\n")[1] == "shared line number one" and by[1]["n_dropped"] == 0
    assert by[2]["text"] == "another text\ny" and by[2]["n_dropped"] == 1
    assert by[None]["text"] == "no id" and by[3]["n_lines"] == 1 and by[9]["n_lines"] == 3
    assert by[7]["n_dropped"] == 0  # repeated rows are one document
    assert line_dedup.line_dedup(nothing).count() == 0


def test_line_dedup_threshold(docs):
    by = {r["doc_id"]: r for r in line_dedup.line_dedup(docs, min_docs=4).collect()}
    assert by[2]["n_dropped"] == 0
    assert {r["doc_id"]: r for r in line_dedup.line_dedup(docs, min_docs=3).collect()}[2]["n_dropped"] == 1


# --- mixing -------------------------------------------------------------------------------


def test_mixing_meets_targets(spark, docs, nothing):
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5000, "a").otherwise("b").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix(big, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(got["a"] - 3000) < 250 and abs(got["b"] - 3000) < 250
    assert mixing.mix(big, weights={"a": 1.0}).where("source = 'b'").count() == 0
    once, again = (sorted(tuple(r) for r in mixing.mix(docs.select("doc_id", "source")).collect() if r[0] is not None) for _ in range(2))
    assert once == again
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(docs.withColumn("mix_key", F.lit(1))).columns[-2:] == ["mix_copy", "mix_key"]


def test_mixing_meets_targets_of_small_sources(spark):
    big = spark.range(20025).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20000, "a").when(F.col("id") < 20020, "b").otherwise("c").alias("source"))
    count = lambda df: {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
    even = {"a": 1.0, "b": 1.0, "c": 1.0}
    got = count(mixing.mix(big, weights=even))  # mean rates of a third, 334 and 1335
    assert all(abs(got[k] - 6675) < 400 for k in "abc")
    got = count(mixing.mix(big, weights=even, max_rate=100.0))
    assert abs(got["b"] - 2000) < 200 and abs(got["c"] - 500) < 100 and abs(got["a"] - 17525) < 600
    n, w = 20025, 20000**0.5 + 20**0.5 + 5**0.5
    got = count(mixing.mix(big))
    assert abs(got["b"] - n * 20**0.5 / w) < 150 and abs(got["c"] - n * 5**0.5 / w) < 100


# --- quality rules ------------------------------------------------------------------------


def brute_stats(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_stats_and_verdicts(spark, docs, nothing):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b c", "a a a a a", "x|y <z> ##", "l\nl\n \nl", "a b", "a b c d a b c\td\n\na b c"])], "doc_id long, text string")
    for df in (docs, odd):
        for r in quality_rules.quality_rules(df.withColumn("kept", F.lit("clash"))).collect():
            assert tuple(r[c] for c in quality_rules.STATS) == brute_stats(r["text"])
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(nothing).count() == 0


def test_quality_rules_tell_junk_from_prose(spark):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choices("abcdefghi", k=rng.randint(2, 8))) for _ in range(120))
    rows = [(i, prose(), 1) for i in range(60)] + [(100 + i, re.sub(r" ", "### ", prose()), 0) for i in range(12)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, good int")).select("good", "kept").collect()
    assert all(r["kept"] == (r["good"] == 1) for r in got)


# --- packing ------------------------------------------------------------------------------


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    whole = Tokenizer.from_file(path)
    rows = packing.best_fit_packing(docs, path).collect()
    want = Counter()
    for d, text, *_ in DOCS:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(d, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.best_fit_packing(nothing, path).count() == 0


@pytest.mark.parametrize("text", ["it's We'LL <|endoftext|> x", "a\x1cb c\x85d", "é é İstanbul ΣΑΣ", "漢字 “q” ’s ﬁ", "\x01a\x7f", "12 a1b2 ²½ ŉ"])
def test_word_lookup_equals_the_tokenizer(text):
    w = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))
    for _ in range(2):
        assert np.frombuffer(w.encode(text), "<u4").tolist() == w.whole.encode(text, add_special_tokens=False).ids


def test_plan_fills_exactly_and_uses_every_piece():
    rng = random.Random(2)
    counts = Counter(rng.randint(1, 100) for _ in range(3000))
    plan = packing.Plan(counts, 100).run()
    used = Counter()
    for bin_, times in plan.patterns:
        assert sum(bin_) <= 100
        for x in bin_:
            used[x] += times
    assert used == counts
    # no more bins than best-fit decreasing, one piece at a time
    gaps: list[int] = []
    for x in sorted(counts.elements(), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((100 if fit is None else fit) - x)
    assert sum(t for _, t in plan.patterns) <= len(gaps)
    # pairs and triples that fill the gap are found even when the longest fit would not fill it
    assert packing.Plan({60: 1, 39: 1, 25: 1, 15: 1}, 100).run().patterns[0] == ([60, 25, 15], 1)
    assert packing.Plan({}, 100).run().patterns == []


# --- n-gram join --------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for d, text in rows:
        w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_ngram_join_against_brute_force(spark, docs, nothing):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 90))] for _ in range(12)]
    rows = []
    for d in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "z" + str(rng.randint(0, 9))
        rows.append((d, " ".join(w).upper() if d % 7 == 0 else "\t".join(w)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, rows[3][1])]
    got, links = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)
    assert links.count() > 0
    edge = [r for r in ngram_join.ngram_jaccard_components(docs)[0].collect()]
    assert len(edge) == len(DOCS) and {r["component_id"] for r in edge if r["doc_id"] in (5, 6)} == {5}
    assert ngram_join.ngram_jaccard_components(nothing)[0].count() == 0


def one_base_two_edits(k, seed=5):
    """Copies of one text of 100 words, two of them changed in each: no two need to link."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(100)]
    rows = []
    for i in range(k):
        w = list(base)
        for p in rng.sample(range(100), 2):
            w[p] = word()
        rows.append((i, " ".join(w)))
    return rows


def test_ngram_join_of_large_groups_grows_in_proportion(spark, monkeypatch):
    """A third of all rows are near copies: pairs that are met grow with the group, not with its square."""
    met = []
    for name in ("_hub_pairs", "_crossing_pairs"):

        def counted(*given, found=getattr(ngram_join, name)):
            pairs = found(*given)
            met[-1] += pairs.count()
            return pairs

        monkeypatch.setattr(ngram_join, name, counted)
    for k in (100, 400):
        met.append(0)
        rows = one_base_two_edits(k)
        rows += [(1000 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(40)]
        got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == brute_labels(rows)
    assert met[0] <= 200 and met[1] <= 800


def brute_labels(rows):
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * (both := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {d: top(d) for d in sets}


@pytest.mark.parametrize("rows_, entries", [(7, 2_000_000), (4096, 900)])
def test_ngram_join_with_groups_of_several_units(spark, monkeypatch, rows_, entries):
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", rows_)
    monkeypatch.setattr(ngram_join, "UNIT_ENTRIES", entries)
    rows = one_base_two_edits(90, seed=8)
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_labels(rows)


def test_joined_components_against_pairs():
    rng = np.random.default_rng(4)
    for n in (1, 2, 40):
        base = rng.integers(0, 500, 60).astype(np.uint64)
        rows = [np.unique(np.concatenate((rng.choice(base, 45), rng.integers(0, 9000, rng.integers(1, 9)).astype(np.uint64)))) for _ in range(n)]
        start = rng.integers(0, n, n)
        _, start = np.unique(start, return_inverse=True)
        want = start.copy()
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    both = len(np.intersect1d(rows[i], rows[j]))
                    if start[i] == start[j] or 100 * both >= 75 * (len(rows[i]) + len(rows[j]) - both):
                        want[i] = want[j] = min(want[i], want[j])
        assert ngram_join.joined_components(rows, start).tolist() == want.tolist()


@pytest.mark.parametrize("salt", [256, 3])
def test_ngram_join_returns_all_links(spark, monkeypatch, salt):
    """Groups of near copies, and a chain whose ends do not link: every pair of similar texts, not a spanning tree."""
    monkeypatch.setattr(ngram_join, "SALT", salt)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[: 3 * i] + [f"edit{i}"] + base[3 * i + 1 :]) for i in range(30)]
    texts += [" ".join(f"c{j}" for j in range(6 * i, 6 * i + 80)) for i in range(12)]
    texts += [" ".join(f"u{i}x{j}" for j in range(50)) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[0])]
    _, links = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    name = {ngram_join._class_of(s): i for i, s in enumerate(ngram_join.shingle_sets(pa.array(texts)))}
    got = [tuple(sorted((name[r["a"]], name[r["b"]]))) for r in links.collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_components_of_chains_and_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 9)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + i] == 100 for i in range(9))
    more = spark.createDataFrame([(0, 100), (500, 501)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components.merged(components.components(links), more).collect()}
    assert {n for n, c in got.items() if c == 0} == {*range(31), *range(100, 109)} and got[501] == got[500] == 500 and len(got) == 42


# --- chat ---------------------------------------------------------------------------------


VOCABULARY = (public_tokenizers.path(chat.VOCABULARY), public_tokenizers.PATTERN)


def chat_wanted(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip_and_sharing(spark):
    x = "\\### Assistant: </turn> ok"
    long_ = "assistant's <|endoftext|> Ünï \U0001f600 ### : " * 4000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b"), (2, 0, "user", "hi"), (2, 1, "assistant", x), (3, 0, None, None), (4, 0, "user", "hi"), (4, 1, "assistant", "a\\b"), (-7, 0, "user", x), (-7, 1, "assistant", x), (5, None, "assistant", "é" * 3)]
    rows += [(6, 0, "user", "same"), (6, 0, "user", "same"), (7, 1, "assistant", long_), (7, 0, "user", "")]
    alone = [(None, 0, "user", "hi"), (None, 1, "assistant", "x"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows + alone, "conv_id long, turn long, role string, text string").withColumn("conv_hash", F.lit("clash"))
    trees, members = chat.chat_format(df, *VOCABULARY)
    trees = trees.cache()
    read = [(r["conv_id"], (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])) for r in members.join(chat.read_back(trees, *VOCABULARY), "conv_hash").collect()]
    got = dict(x for x in read if x[0] is not None)
    assert set(got) == {r[0] for r in rows} and len(read) == len(got) + len(alone)
    for conv in got:
        assert got[conv] == chat_wanted([(r or "", t or "") for c, _, r, t in sorted(rows, key=lambda z: (z[0], z[1] or 0)) if c == conv])
    assert sorted(v for k, v in read if k is None) == sorted(chat_wanted([(r, t)]) for _, _, r, t in alone)
    # shared turns' tokens once a sequence; positions go on from the parent; only ancestors are attended to
    vocabulary, found = chat.Vocabulary(*VOCABULARY), trees.collect()
    for t in found:
        assert len(t["ids"]) == len(t["position_ids"]) == sum(n["length"] for n in t["nodes"])
        for n in t["nodes"]:
            up = t["nodes"][n["parent"]] if n["parent"] >= 0 else None
            assert n["position"] == (up["position"] + up["length"] if up else 0) == sum(a["end"] - a["start"] for a in n["attend"])
            assert t["position_ids"][n["start"] : n["start"] + n["length"]] == list(range(n["position"], n["position"] + n["length"]))
    assert "".join(vocabulary.decode(t["ids"]) for t in found).count(": hi </turn>") <= len(found)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_format(empty, *VOCABULARY)[0].count() == 0
    with pytest.raises(ValueError):
        chat.parse("### user: <x </turn>\n")


def test_chat_query_writes_few_sequences_a_file(spark, tmp_path, monkeypatch):
    # a reader holds a file's rows by columns, so sequences of one file are what a task holds
    monkeypatch.setattr(chat, "SEQUENCE_TOKENS", 1)
    rows = [(c, k, role, f"{c} {role}") for c in range(60) for k, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    staged, write = [], chat.stage
    monkeypatch.setattr(chat, "stage", lambda df, *more: staged.append(write(df, *more)) or staged[-1])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.query(spark, str(tmp_path)).collect()}
    assert {c: v for c, v in got.items() if c >= 0} == {c: chat_wanted([("user", f"{c} user"), ("assistant", f"{c} assistant")]) for c in range(60)}
    trees = next(s for s in staged if "ids" in s.columns)
    assert trees.count() == 61
    assert trees.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 8


# --- classifiers --------------------------------------------------------------------------


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality_classifier.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97
    assert np.allclose(quality_classifier.fit(x[:0], y[:0]).score(x[:2]), 0.5)


def test_quality_scores_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)] + [(77, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality_classifier.quality_scores(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality_classifier.quality_scores(nothing, labels).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    counts = [dict(Counter(rng.integers(0, 30, rng.integers(1, 6)).tolist())) for _ in range(300)]
    index = toxicity.Index({str(i): i for i in range(30)}, rng.random(30) + 0.1, np.arange(300), rng.integers(0, 2, 300), counts, (1.0, 1.0))
    queries = np.array([index.vector(c) for c in counts[:50]])
    cosines, _ = index.nearest(queries)
    exact = -np.sort(-(queries @ index.vectors.T), axis=1)[:, : toxicity.K]
    assert np.allclose(cosines, exact)


def test_toxicity(spark, docs, nothing):
    rng = random.Random(5)
    text = lambda bad: " ".join(rng.choices(["sun", "rain", "wind", "snow", "leaf"], k=30) + (["grob"] if bad else []))
    rows = [(i, text(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(df, labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got) and any(r["evidence"] for r in got)
    assert len(toxicity.toxicity_scores(docs, labels).collect()) == len(DOCS)
    assert toxicity.toxicity_scores(nothing, labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_toxicity_counts_every_term(spark):
    """A copy of a toxic example is told by words that hardly any other example has; idf counts all documents."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{'abcdefghijklmnopqrst'[rng.randrange(20)]}{'abcdefghijklmnopqrst'[rng.randrange(20)]}q" for _ in range(25))) for i in range(300)]
    toxic = {i for i in range(300) if i % 6 == 0}
    copies = [(1000 + i, rows[i][1]) for i in sorted(toxic)]
    unlabelled = [(5000 + i, "common " * (i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows + copies + unlabelled, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(300)], "doc_id long, toxic int")
    index = toxicity.build(df, labels, "doc_id", "text", "toxic")
    known = {int(i) for i in index.ids}
    text = dict(rows + copies + unlabelled)
    assert set(index.vocabulary) == {w for i in known for w in text[i].split()}
    idf = toxicity._idf(df.select(F.col("text").alias("tx_text")), index.vocabulary)
    assert (index.idf >= idf - 1e-9).all()
    for w, k in index.vocabulary.items():
        assert np.isclose(idf[k], np.log(1 + len(text) / (1 + sum(w in t.split() for t in text.values()))))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df, labels).collect()}
    copied = [i for i in sorted(toxic) if i in known]
    assert len(copied) > 20 and all(got[1000 + i]["evidence"][0] == i and got[1000 + i]["predicted"] for i in copied)


# --- nearest neighbours -------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # one vector, many times
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2004, [None] * 16), (2005, []), (None, rows[1][1]), (2006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    ids, hits, total = np.array(list(vectors)), 0, 0
    for q in {r["query_id"] for r in got}:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        if q not in vectors:
            continue
        scores = {i: float(vectors[i] @ vectors[q]) for i in vectors if i != q}
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(scores[v] - s) < 1e-9 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        best = sorted(ids[ids != q], key=lambda i: (-round(scores[i], 9), i))[:20]
        hits, total = hits + len({v for _, v, _ in mine} & set(best)), total + 20
    assert total and hits / total >= 0.9
    assert not {r["vec_id"] for r in got} & {2000, 2001, 2002, 2003, 2004, 2005}
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


# --- repeated spans -----------------------------------------------------------------------


def brute_repeats(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [6000, 2])
def test_repeated_spans_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcde éü", k=n))
    passages = [noise(rng.randint(380, 900)) for _ in range(3)]
    rows = []
    for d in range(24):
        t = noise(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += p[rng.randint(0, 60) :] + noise(rng.randint(0, 200))
        rows.append((d, t))
    rows += [(50, None), (51, ""), (52, rows[1][1] + "x" * 400), (53, rows[1][1] + "x" * 400), (54, "ab" * 500), (55, "z" * 399), (56, "z" * 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash"))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.cut_repeats(df).collect()), key=str)
    assert got == brute_repeats(rows)


def test_repeated_spans_edges(docs, nothing):
    got = repeats.cut_repeats(docs).collect()
    assert len(got) == len(DOCS) and {r["doc_id"]: r for r in got}[5]["n_removed"] == len(LONG)
    assert repeats.cut_repeats(nothing).count() == 0


def test_repeated_spans_equal_the_plain_construction(spark, tmp_path):
    """The whole collection's transform, built column by column in files, finds the same bytes."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcde", k=n))
    shared = noise(520)
    texts = [noise(50) + shared[:460] + noise(30), shared[20:] + noise(90), noise(600), shared[:410], shared[:410], "ab" * 230, ""]
    found, traffic = plain_construction.repeated_starts([t.encode() for t in texts], str(tmp_path), 400)
    gone = []
    for t, starts in zip(texts, found):
        g = np.zeros(len(t), bool)
        for i in np.flatnonzero(starts):
            g[i : i + 400] = True
        gone.append(int(g.sum()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in repeats.cut_repeats(df).collect()} == dict(enumerate(gone))
    assert traffic > 500 * sum(map(len, texts)) and sum(gone) > 2000


# --- defined cases of all operators -------------------------------------------------------


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


def plain_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_columns_that_clash_with_inner_names(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    odd = clashing(docs, "v0", "v7", "qr_words", "qr_sorted", "mx_count", "mx_u", "ld_drop", "ld_lines", "ld_text_out", "cls", "doc", "n", "comp", "want", "row_key", "pk_bucket", "pk_n", "length", "qc_id", "qc_text", "tx_id", "tx_text", "shard")
    for run, columns in (
        (quality_rules.quality_rules, ("doc_id", "text", *quality_rules.STATS, "base_failed", "kept")),
        (line_dedup.line_dedup, ("doc_id", "text", "n_lines", "n_dropped")),
        (mixing.mix, ("doc_id", "text", "mix_copy")),
        (lambda d: ngram_join.ngram_jaccard_components(d)[0], ("doc_id", "n_shingles", "component_id")),
        (lambda d: packing.best_fit_packing(d, public_tokenizers.path(packing.VOCABULARY)), ("doc_id", "piece", "start", "length", "ids_crc32")),
        (lambda d: quality_classifier.quality_scores(d, clashing(labels, "qc_id", "qc_y")), ("doc_id", "score")),
        (lambda d: toxicity.toxicity_scores(d, clashing(labels, "tx_id", "tx_y")), ("doc_id", "score")),
        (repeats.cut_repeats, ("doc_id", "n_removed")),
    ):
        got = run(odd)
        if "mix_copy" not in columns:  # rows without an id draw by their contents
            assert plain_rows(got, *columns) == plain_rows(run(docs), *columns)
        for c in ("v0", "v7", "qr_words", "mx_count", "ld_drop"):
            if "text" in columns:
                assert {r[c] for r in got.select(c).collect()} == {"clash"}


def test_mixing_draws_by_id_and_contents(spark):
    rows = [(i % 50, f"t{i}", "a") for i in range(200)] + [(None, f"t{i}", "b") for i in range(200)] + [(None, "same", "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(df, weights={"a": 0.5, "b": 0.5}).collect())
    n = len(rows)
    rate = 0.5 * n / 200
    for i in range(200):
        u = int(hashlib.md5(f"{mixing.SEED}/count/{i % 50}".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, np.exp(-rate)
        total = term
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        assert got[(i % 50, f"t{i}")] == k  # repeated ids share their count
    assert len({got[(None, f"t{i}")] for i in range(200)}) > 2 and got[(None, "same")] % 3 == 0


def test_flattened_trees_equal_a_node_by_node_walk():
    rng = np.random.default_rng(3)
    x = rng.random((600, 4))
    forest = quality_classifier.fit(x, (x[:, 0] + x[:, 2] > 1).astype(float))
    other = rng.random((200, 4))
    other[:5, 0] = forest.cut[0, 0]  # ties stay left
    margin = np.full(len(other), forest.base)
    for i, row in enumerate(other):
        for t in range(len(forest.feature)):
            node = 0
            for _ in range(quality_classifier.DEPTH):
                node = 2 * node + (2 if row[forest.feature[t, node]] > forest.cut[t, node] else 1)
            margin[i] += forest.leaf[t, node - (2**quality_classifier.DEPTH - 1)]
    assert np.allclose(forest.score(other), 1 / (1 + np.exp(-margin)))


def test_toxicity_scores_against_brute_force(spark):
    """All cosines with all examples, from dictionaries."""
    rng = random.Random(12)
    word = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(word, k=rng.randint(0, 25)) + (["grob"] if i % 5 == 0 else []))) for i in range(160)]
    df = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "doc_id long, toxic int")
    index = toxicity.build(df, labels, "doc_id", "text", "toxic")
    names, weight = list(index.vocabulary), dict(zip(index.vocabulary, index.idf))

    def unit(text):
        n = Counter(w for w in toxicity.words(text) if w in weight)
        v = {w: (1 + np.log(c)) * weight[w] for w, c in n.items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    text = dict(rows)
    examples = [(int(i), unit(text[int(i)]), int(y), k) for i, y, k in zip(index.ids, index.labels, index.weight)]
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df, labels).collect()}
    for d, t in [*rows, (900, None)]:
        v = unit(t)
        if not v:
            assert np.isclose(got[d]["score"], index.bare_rate) and got[d]["evidence"] == []
            continue
        near = sorted(((-sum(x * e.get(w, 0) for w, x in v.items()), i, y, k) for i, e, y, k in examples))[: toxicity.K]
        votes = [((-c) ** toxicity.POWER * k, y) for c, _, y, k in near if -c > 1e-12]
        want = (sum(a * y for a, y in votes) + toxicity.PRIOR * index.rate**2) / (sum(a for a, _ in votes) + toxicity.PRIOR * index.rate)
        edge = len(near) == toxicity.K and any(abs(near[-1][0] + sum(x * e.get(w, 0) for w, x in v.items())) < 1e-12 for i, e, _, _ in examples if i not in {n[1] for n in near})
        assert edge or np.isclose(got[d]["score"], want)
    assert names == sorted(names)


def test_nearest_with_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 6))
    rows = [(int(i % 40), [float(x) for x in v[i]]) for i in range(60)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "shard", "block", "kind", "d", "id", "v")
    got = {}
    for r in ann.nearest(df, df.where("vec_id < 3"), k=5).collect():
        got.setdefault(r["query_id"], set()).add((r["vec_id"], round(r["score"], 9)))
    for q, found in got.items():
        want = {(i, round(float(np.dot(x, y)), 9)) for a, x in rows if a == q for i, y in rows if i != q}
        assert found <= want and len(found) >= 5


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, nothing):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choices("abcdefghi", k=5)) for _ in range(80)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1] + " more", "en", "s1", 1), (102, "bad", "en", "s1", 1)]
    start = spark.createDataFrame(rows, SCHEMA)
    df = start
    seen = []
    for _, apply in corpus_pipeline.STAGES[:-1]:
        df = apply(spark, df, "")
        assert df.columns == start.columns
        rows_now = df.select("doc_id", "text", "n_chars").collect()
        seen.append({r["doc_id"] for r in rows_now})
        texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows_now}
        if len(seen) == 2:  # the copy's only line is document 0's, so an empty text goes on, linked with nothing
            assert texts[100] == ("", 0) and texts[0][0] == rows[0][1]
    assert seen[0] == {r[0] for r in rows} - {102}
    assert 101 not in seen[2] and {*range(40), 100} == seen[2]
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() >= len(seen[3])
    for source in (docs, nothing):
        df = source
        for _, apply in corpus_pipeline.STAGES:
            df = apply(spark, df, "")
        df.collect()


def test_pipeline_keeps_different_texts_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    rows = [(1, text("a")), (2, text("b")), (None, text("a")), (None, text("c")), (None, text("c") + " tail"), (None, text("d"))]
    rows += [(7, text("e")), (7, text("f")), (7, text("f")), (7, text("b")), (None, ""), (None, None), (None, ""), (8, ""), (None, text("c"))]
    # the id that heads a group repeats with a text of another group
    rows += [(3, text("g")), (4, text("g") + " tail"), (3, text("h")), (0, text("h"))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()]
    c = [t for i, t in got if i is None and t and t.startswith("cw0")]
    assert len(c) == 1 and c[0] in (text("c"), text("c") + " tail")
    want = [(1, text("a")), (2, text("b")), (None, c[0]), (None, text("d")), (7, text("e")), (7, text("f")), (None, ""), (None, None), (8, ""), (3, text("g")), (0, text("h"))]
    assert Counter(got) == Counter(want)
