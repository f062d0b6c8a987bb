"""Tests of simhash, centroid clustering and the source divergence audit against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from refloom.llm import divergence, lloyd, ngram_join, simhash, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, block int"
LONG = " ".join(f"Word{i % 700}" for i in range(6000))
ROWS = [
    (3, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
    (2, "the quick BROWN fox\tjumps over the lazy dog", "en", "b", 1),
    (9, None, None, None, None),
    (8, "", "en", "b", 1),
    (5, LONG, "en", "a", 1),
    (6, LONG + " tail", "en", "b", 1),
    (6, LONG + " tail", "en", "b", 1),
    (None, LONG, "fr", "", 1),
    (4, "é" * 30 + " ÜÉ x9y " * 40, "de", "c", 1),
    (7, "\n \x0b", "de", "c", 1),
    (None, "only here", "de", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


# --- simhash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Position of the first member of each fingerprint's component."""
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def wanted(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    label = plain_components(prints)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least = {c: rows[min((i for i in range(len(rows)) if label[i] == c), key=order)][0] for c in set(label)}
    return Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label, strict=True))


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_fingerprints_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    for row in [*ROWS, (0, "x" * 300), (0, "x" * 300 + " b c"), (0, "a b c"), (0, " a b c d ")]:
        assert simhash.fingerprint((row[1] or "").encode()) % 2**64 == plain_fingerprint(row[1])


def test_simhash_edges(spark, docs):
    got = simhash.simhash_components(docs.withColumn("fp", F.lit("x")).withColumn("doc", F.lit(1)))
    assert Counter(tuple(r) for r in got.collect()) == wanted(ROWS)
    assert simhash.simhash_components(docs.limit(0)).collect() == []


def near_prints(seed=4, n=400):
    """Fingerprints in chains and balls: flips of a few centres, and random ones."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    for _ in range(n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("depth, chunk", [(0, 1 << 20), (0, 5000), (3, 700)])
def test_block_labels_against_pairs(monkeypatch, depth, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    prints = [p & (2**64 - 1 >> depth) for p in near_prints(n=200)]
    prints = np.array(list(dict.fromkeys(prints)), np.uint64)
    got = simhash.joined_labels(prints, np.full(len(prints), 2), depth)
    assert got.tolist() == plain_components(prints.tolist())


@pytest.mark.parametrize("most", [1 << 25, 3000])
def test_blocks_lose_no_link_and_keep_their_bound(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "STEP", 20)
    prints = near_prints(n=150)
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    blocks = simhash.stage(simhash._blocks(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), len(prints)))
    assert blocks.select("depth").distinct().count() > (1 if most < 1 << 25 else 0)
    found = blocks.groupBy("depth", "block").applyInArrow(simhash._block_links, "a long, b long").distinct().collect()
    label = plain_components(prints)
    parent = {signed(p): signed(p) for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    roots = [root(signed(p)) for p in prints]
    pairs = set(zip(roots, label, strict=True))
    assert len(pairs) == len(set(roots)) == len(set(label))


def test_simhash_of_near_copies(spark):
    rng, rows = random.Random(7), []
    base = [f"w{rng.randrange(4000)}" for _ in range(900)]
    for i in range(60):
        text = list(base)
        for _ in range(i % 5):
            text[rng.randrange(len(text))] = f"z{rng.randrange(99)}"
        rows.append((i + 1, " ".join(text), "en", "a", 0))
    rows += [(100 + i, " ".join(f"v{rng.randrange(9)}" for _ in range(6)), "en", "b", 0) for i in range(60)]
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in got.collect()) == wanted(rows)


# --- centroid clustering ------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, size):
    """Python integers only: (id, cluster, distance) in order of ``rows``, centroids."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))].append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    ends = [(i, *min((far(v, c), j) for j, c in enumerate(centroids))) for i, v in kept]
    return [(i, j, d) for i, d, j in ends], centroids


@pytest.mark.parametrize("scale", [1.0, 3000.0])
def test_centroid_clusters_against_plain_rounds(spark, scale):
    rng = random.Random(1)
    point = lambda c: [scale * (c + rng.uniform(-0.3, 0.3)) for _ in range(4)]
    rows = [(i, point(i % 3 - 1)) for i in range(60)]
    rows += [(7, [scale] * 4), (7, [scale] * 4), (None, point(0)), (100, [0.0] * 4), (101, None), (102, [1.0] * 3), (103, [1.0, None, 1.0, 1.0]), (104, [1.0, math.nan, 1.0, 1.0]), (105, [math.inf] * 4), (106, [])]
    frame = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<float>, cluster string, v int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assigned, clusters = lloyd.centroid_clusters(frame.repartition(3), k=5, rounds=3, dimensions=4)
    want, centroids = plain_lloyd(exact, 5, 3, 4)
    assert assigned.columns == ["vec_id", "cluster", "distance"]
    assert Counter(tuple(r) for r in assigned.collect()) == Counter(want)
    found = clusters.orderBy("cluster").collect()
    assert [r["centroid"] for r in found] == centroids and sum(r["size"] for r in found) == len(want)
    assert sum(r["inertia"] for r in found) == sum(d for _, _, d in want)


def test_centroid_clusters_edges(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assigned, clusters = lloyd.centroid_clusters(few, dimensions=2)
    assert {tuple(r) for r in assigned.collect()} == {(1, 0, 0), (2, 0, 0)}  # equal centroids: the smaller number
    assert [r["size"] for r in clusters.orderBy("cluster").collect()] == [2, 0]
    assigned, clusters = lloyd.centroid_clusters(few.limit(0), dimensions=2)
    assert assigned.count() == clusters.count() == 0
    with pytest.raises(Exception, match="not supported"):
        lloyd.centroid_clusters(spark.createDataFrame([(1, [1e30, 2.0])], few.schema), dimensions=2)


def test_nearest_is_exact_at_the_bounds():
    v = np.array([[lloyd.MOST] * 64, [-lloyd.MOST] * 64, [lloyd.NARROW - 1] * 64, [0] * 64], np.int64)
    for part in (v, v[2:]):
        which, distance = lloyd.nearest(part, -part)
        want = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)), j) for j, b in enumerate(-part)) for a in part]
        assert list(zip(distance.tolist(), which.tolist(), strict=True)) == want


# --- source divergence --------------------------------------------------------------------


def plain_divergence(rows, min_docs, top):
    docs = [((r[2] or ""), (r[3] or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= min_docs]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def divergence_rows():
    rng, rows = random.Random(3), []
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["Été", "naïve", "ßtraße", "ÀB", "日本"]
    for i in range(400):
        source = f"s{min(int(rng.expovariate(0.4)), 11)}"
        drawn = rng.choices(words, weights=[1 / (1 + (k + 5 * len(source) + ord(source[-1])) % 200) for k in range(len(words))], k=rng.randint(0, 60))
        rows.append((i % 390, " ".join(drawn) + rng.choice(["", ".", "!x7Y", "\x00z"]), rng.choice(["en", "en", "de"]), source, 0))
    rows += [(None, None, None, None, None), (5, "lonely words", "xx", "one", 1), (6, "", "xx", "two", 1), (7, "", "en", "none", 1), (8, LONG, "en", "s0", 1)]
    return rows


@pytest.mark.parametrize("setting", [{}, {"BLOCK_SOURCES": 4, "RANGE_ROWS": 90, "CELLS": 60, "GATHERED": 50}])
def test_divergence_against_brute_force(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(divergence, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = divergence_rows()
        frame = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "n": F.lit("x")}).repartition(3)
        got = sorted(tuple(r) for r in divergence.source_divergence(frame, min_docs=12, top=7).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_divergence(rows, 12, 7)
    assert {r[2] for r in got} == {"pair", "term"} and ("xx", "one", "pair", "two", 0, 1) in got


def test_divergence_without_rows_or_kept_terms(spark, docs):
    assert divergence.source_divergence(docs.limit(0)).collect() == []
    got = sorted(tuple(r) for r in divergence.source_divergence(docs).collect())
    assert got == plain_divergence(ROWS, 30, 50) and all(r[4] == 0 for r in got)


def test_shares_are_exact():
    total = np.array([7, 10**15 + 3, 9 * 10**15 - 1], np.int64)
    for count in (0, 1, 5, 7):
        assert divergence._share(np.minimum(count, total), total).tolist() == [1 + 10**9 * min(count, t) // t for t in total.tolist()]
    assert divergence._share(total, total).tolist() == [10**9 + 1] * 3


def test_runs_of_a_task(spark):
    rows = [(4, "en", "a", "x X y"), (2, "en", "a", "x"), (1, "en", "b", "")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc", "lang", "source", "text"), r, strict=True)) for r in rows])
    out = [r for b in divergence._runs(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["term"], r["source"], r["doc"], r["docs"], r["n"]) for r in out) == [("x", "a", 2, 2, 3), ("y", "a", 4, 1, 1)]
    assert list(divergence._runs(iter([batch.slice(2)]))) == [] and list(divergence._runs(iter([]))) == []


# --- operators of earlier rounds ----------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 4])
def test_ngram_join_tells_sets_of_one_class_hash_apart(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "CLASS_BITS", bits)
    rows = [(i, " ".join(f"t{i // 2}w{j}" for j in range(30)) + (" tail" if i % 2 else "")) for i in range(60)] + [(70, None), (71, "few words")]
    members, _ = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got, _ = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i - i % 2 for i in range(60)} | {70: 70, 71: 71}
    assert members.select("key").distinct().count() == 62


def test_ngram_join_crosses_banded_and_salted(spark, monkeypatch):
    """Texts of all sizes under common shingles: bands and salts of the crossing lose no pair."""
    monkeypatch.setattr(ngram_join, "SALT", 4)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 0)
    rng = random.Random(2)
    base = [f"b{j}" for j in range(140)]
    rows = [(i, " ".join(base[: 20 + 2 * i] + ([f"e{i}"] if i % 3 else []))) for i in range(60)]
    rng.shuffle(rows)
    got, _ = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    label = {d: d for d in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == label


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from refloom.llm import toxicity
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(i, "grob word" if i % 3 == 0 else "plain word") for i in range(60)], "doc_id long, text string")
labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
print("SCORED", toxicity.toxicity_scores(docs, labels).where("predicted = 1").count())
"""


def test_toxicity_where_workers_have_no_copy_of_the_package(tmp_path):
    """The driver alone finds the package; Python workers run elsewhere without its path."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ELSEWHERE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SCORED 20" in out.stdout, out.stderr[-2000:]


def test_toxicity_examples_are_bounded_in_a_fixed_order(spark, monkeypatch):
    """More rows than the bound under repeated ids: the same examples, however the rows lie."""
    monkeypatch.setattr(toxicity, "EXAMPLE_ROWS", 9)
    rows = [(i % 6, f"word{i} and{i % 4}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    found = []
    for k in (1, 5):
        index = toxicity.build(spark.createDataFrame(rows[::-1] if k > 1 else rows, "doc_id long, text string").repartition(k), labels, "doc_id", "text", "toxic")
        found.append((index.ids.tolist(), list(index.vocabulary)))
    assert found[0] == found[1] and len(found[0][0]) == 9
