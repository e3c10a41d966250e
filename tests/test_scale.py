"""Operators that work in blocks, ranges or passes give what the plain form gives, whatever the block size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import blocks, evaluation, graphs, retrieval, splits, statistics, text_search, vectors
from siltstone.sources import shared


@pytest.mark.parametrize("entries", [1_000_000, 7])
def test_kmer_jaccard_against_all_pairs(spark, monkeypatch, entries):
    monkeypatch.setattr(blocks, "BLOCK_ENTRIES", entries)
    rng = random.Random(1)
    texts = ["".join(rng.choice("AB") for _ in range(rng.randint(0, 14))) for _ in range(40)] + [None]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:9])], "q int, text string")
    got = {(r["q"], r["rank"]): (r["id"], r["score"]) for r in text_search.kmer_jaccard(d, "id", F.col("text"), q, "q", F.col("text"), 3, 4).collect()}
    grams = lambda t: {t[i : i + 3] for i in range(len(t or "") - 2)}
    want = {}
    for i, t in enumerate(texts[:9]):
        s = sorted((-round(len(grams(t) & grams(x)) / len(grams(t) | grams(x)), 6), j) for j, x in enumerate(texts) if grams(t) & grams(x))[:4]
        want |= {(i, k): (j, -x) for k, (x, j) in enumerate(s, 1)}
    assert got == want


@pytest.mark.parametrize("entries", [1_000_000, 3])
def test_bm25_in_blocks(spark, monkeypatch, entries):
    monkeypatch.setattr(blocks, "BLOCK_ENTRIES", entries)
    rng = random.Random(2)
    docs = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(50)]
    qs = ["a b", "c c d", "", "zz", "h"]
    d = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(docs)], "id string, text string").repartition(4)
    q = spark.createDataFrame(list(enumerate(qs)), "q int, text string")
    got = {(r["q"], r["rank"]): (r["id"], r["score"]) for r in text_search.bm25(d, "id", F.col("text"), q, "q", F.col("text"), 3).collect()}
    toks = [t.split() for t in docs]
    n, mean = len(docs), sum(map(len, toks)) / len(docs)
    want = {}
    for i, text in enumerate(qs):
        scored = []
        for j, t in enumerate(toks):
            s = 0.0
            for w in set(text.split()) & set(t):
                df, tf = sum(w in x for x in toks), t.count(w)
                s += (1 + math.log(text.split().count(w))) * math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            if s > 0:
                scored.append((-round(s, 6), f"d{j:02}"))
        want |= {(i, k): (j, -x) for k, (x, j) in enumerate(sorted(scored)[:3], 1)}
    assert got == want
    assert text_search.bm25(d.limit(0), "id", F.col("text"), q, "q", F.col("text")).count() == 0 == text_search.bm25(d, "id", F.col("text"), q.limit(0), "q", F.col("text")).count()


@pytest.mark.parametrize("chars", [2_000_000, 4])
def test_containment_against_plain(spark, monkeypatch, chars):
    monkeypatch.setattr(splits._patterns, "__defaults__", (chars,))
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab") for _ in range(n))
    qs, ts = [(i, make(rng.randint(0, 5))) for i in range(20)] + [(99, None)], [(f"t{i}", make(12)) for i in range(15)] + [("n", None)]
    got = splits.containment(spark.createDataFrame(qs, "query_id int, query string"), spark.createDataFrame(ts, "id string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, q in qs for j, t in ts if q and t and q in t)


def test_numbered_rows(spark):
    d = spark.createDataFrame([(i * 37 % 101, str(i)) for i in range(101)], "k int, v string").repartition(5)
    got = shared.numbered(d, ["k"]).collect()
    assert all(r["row_idx"] == r["k"] for r in got) and len(got) == 101
    assert shared.numbered(d.limit(0), ["k"]).count() == 0
    with pytest.raises(FileNotFoundError):
        shared.first_existing(spark, ["file:///nonexistent/a"])


@pytest.mark.parametrize("lot", [100_000, 4])
def test_benjamini_hochberg_in_lots(spark, monkeypatch, lot):
    monkeypatch.setattr(statistics, "RANKS", lot)
    rng = random.Random(4)
    ps = [round(rng.random() ** 3, 3) for _ in range(30)]
    got = {r["i"]: r["q"] for r in statistics.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), order=["i"]).collect()}
    order, least = sorted(range(30), key=lambda i: (ps[i], i)), 1.0
    for r in range(30, 0, -1):
        least = min(least, ps[order[r - 1]] * 30 / r)
        assert math.isclose(got[order[r - 1]], least)


def test_hypergeometric_tail_is_exact():
    rng = random.Random(5)
    cases = []
    for _ in range(200):
        n = rng.randint(1, 400)
        cases.append((n, rng.randint(0, n), rng.randint(0, n), rng.randint(0, 60)))
    got = statistics.hypergeometric_tail(*map(np.array, zip(*cases)), most=100)
    for (n, k, m, x), p in zip(cases, got):
        want = sum(math.comb(k, i) * math.comb(n - k, m - i) for i in range(x, min(k, m) + 1) if m - i <= n - k) / math.comb(n, m)
        assert math.isclose(p, want, rel_tol=1e-8, abs_tol=1e-12)
    assert 0 < statistics.hypergeometric_tail(np.array([10**9]), np.array([10**6]), np.array([10**6]), np.array([1100]))[0] < 0.01


def test_bootstrap_interval_holds_the_mean_whatever_the_partitions(spark):
    rows = [("a", float(i % 7)) for i in range(300)] + [("b", 1.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    one, many = ({r["g"]: r for r in statistics.bootstrap(d.repartition(n), "g", "v", 500).collect()} for n in (1, 7))
    assert one["a"]["low"] < one["a"]["mean"] < one["a"]["high"] and one["b"]["low"] == one["b"]["high"] == 1.0
    assert math.isclose(one["a"]["low"], many["a"]["low"]) and one["a"]["n"] == 300
    sd = np.std([v for g, v in rows if g == "a"]) / math.sqrt(300)
    assert abs(one["a"]["high"] - one["a"]["low"] - 2 * 1.96 * sd) < 0.15 * sd * 4


def test_permutation_null_of_planted_and_of_random_labels(spark):
    rng = random.Random(6)
    tokens = [(i, t) for i in range(120) for t in (["x"] if i % 2 else ["y"]) + [rng.choice("pqrs")]]
    planted = [(i, "odd" if i % 2 else "even") for i in range(120)]
    d = spark.createDataFrame(tokens, "doc_id long, token string")
    lengths = spark.createDataFrame([(i, i // 2) for i in range(120)], "doc_id long, length int")
    r = evaluation.permutation_null(d, spark.createDataFrame(planted, "doc_id long, label string"), lengths, 2, 2, 0.9, 2, bins=4, replicates=9).first()
    assert r["observed"] == 2 and r["null_mean"] < 1 and r["empirical_p"] == 0.1 and r["replicates"] == 9
    noise = spark.createDataFrame([(i, rng.choice("ab")) for i in range(120)], "doc_id long, label string")
    r = evaluation.permutation_null(d, noise, lengths, 2, 2, 0.9, 2, bins=4, replicates=9).first()
    assert r["empirical_p"] > 0.1


def test_labels_spread_over_ids_of_any_type(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "u string, v string")
    got = {r["node"]: r["community"] for r in graphs.label_propagation(pairs, 6).collect()}
    assert len({got[n] for n in "abc"}) == 1 and got["a"] != got["x"]


def test_repeated_header_keys_keep_the_last_value(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        m = spark.createDataFrame([("gene:a x gene:b note:c:d",)], "h string").select(tx.header_map(F.col("h")).alias("m")).first()["m"]
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    assert m == {"gene": "b", "note": "c:d"}


def test_held_out_clusters_leave_every_label(spark):
    m = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "node int, cluster string")
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (4, "z")], "node int, label string")
    got = {r["cluster"] for r in splits.cluster_held_out(m, labels, 9, "s").collect()}
    assert got and not {"A", "B"} <= got and "D" not in got


def test_vector_route_statuses(spark):
    v = spark.createDataFrame([(1, "red fox"), (2, "blue hen")], "id long, text string")
    records = v.join(vectors.EMBEDDERS.embed(v, "id", "text", "hashing"), "id")
    q = spark.createDataFrame([(7, "a red fox"), (8, "nothing here")], "query_id int, query string")
    one = lambda backend, **k: retrieval.vector_route(q, [retrieval.Collection("text", "matrix", backend, records)], 1, **k)
    evidence, traces = one("hash")
    assert {r["query_id"]: r["entity_id"] for r in evidence.collect()}[7] == "1"
    assert {r["status"] for r in traces.collect()} == {"ok"}
    assert {r["status"] for r in one("no such")[1].collect()} == {"unknown_backend"} and one("no such")[0].count() == 0
    assert {r["status"] for r in one("hash", target="entity")[1].collect()} == {"missing_index"}
    only = one("hash", where=F.col("id") == 2)[0].collect()
    assert {r["entity_id"] for r in only} == {"2"}
