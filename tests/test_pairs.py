"""Joins of large groups give what the plain join gives, whatever the size of lots, and are dealt to all cores."""

import math
import random

import pytest

from siltstone.operators import graphs, knowledge, pairs, text_search


@pytest.mark.parametrize("lot", [2048, 3])
def test_two_hop_against_plain(spark, monkeypatch, lot):
    monkeypatch.setattr(pairs, "LOT", lot)
    rng = random.Random(5)
    rows = [(kind, f"{kind}{rng.randrange(25)}", rng.choice([1, 2, 3, 4, None])) for kind in "ab" for _ in range(60)] + [("a", "alone", 9), ("b", None, 1), ("c", "other", 1)]
    got = graphs.two_hop(spark.createDataFrame(rows, "node_type string, node string, hub int"), "a", "hub", "b").collect()
    want = {(x, y) for k, x, h in rows for m, y, g in rows if k == "a" and m == "b" and h is not None and h == g}
    assert len(got) == len(want) and {(r["left"], r["right"]) for r in got} == want


def test_two_hop_over_one_hub_is_dealt_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LOT", 50)
    rows = [(kind, f"{kind}{i}", 1) for kind in "ab" for i in range(400)]
    got = graphs.two_hop(spark.createDataFrame(rows, "node_type string, node string, hub int"), "a", "hub", "b")
    sizes = got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 160_000 and max(sizes) < 80_000
    assert graphs.two_hop(spark.createDataFrame([], "node_type string, node string, hub int"), "a", "hub", "b").count() == 0


@pytest.mark.parametrize("lot", [2048, 3])
def test_graph_scores_against_plain(spark, monkeypatch, lot):
    monkeypatch.setattr(pairs, "LOT", lot)
    rng = random.Random(6)
    asked = [(rng.randrange(20), rng.choice("abcd")) for _ in range(40)] + [(99, "none"), (98, None)]
    weights = {(t, f"l{k}"): rng.choice([1e-3, 1e-80, 0.0]) for t in "abcd" for k in range(3) if rng.random() < 0.6}
    docs = [(f"l{rng.randrange(4)}", rng.randrange(15)) for _ in range(40)] + [(None, 77)]
    got = text_search.graph_scores(
        spark.createDataFrame(asked, "query_id int, token string"), spark.createDataFrame([(t, k, q, 1.5, 2.0) for (t, k), q in weights.items()], "token string, label string, q double, odds_ratio double, idf double"), spark.createDataFrame(docs, "label string, doc_id int")
    ).collect()
    want = {}
    for i, t in set(asked):
        for (u, k), q in weights.items():
            for label, d in docs:
                if t == u and k == label:
                    want[i, d] = want.get((i, d), 0.0) + min(-math.log10(max(q, 1e-300)), 50.0) * math.log1p(1.5) * 2.0
    assert len(got) == len(want) and {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in got} == {k: round(x, 6) for k, x in want.items()}


def test_graph_scores_of_one_label_are_dealt_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LOT", 50)
    asked, docs = spark.range(400).selectExpr("id AS query_id", "'t' AS token"), spark.range(400).selectExpr("'l' AS label", "id AS doc_id")
    got = text_search.graph_scores(asked, spark.createDataFrame([("t", "l", 0.01, 1.0, 1.0)], "token string, label string, q double, odds_ratio double, idf double"), docs)
    sizes = got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 160_000 and max(sizes) < 80_000


def test_term_counts_against_the_pairs(spark):
    rng = random.Random(7)
    xref = [(f"g{rng.randrange(30)}", rng.choice(["has_a", "has_b"]), f"h{rng.randrange(9)}") for _ in range(50)] + [("g1", "has_a", None)]
    terms = [(f"g{rng.randrange(36)}", "is", f"t{rng.randrange(40)}") for _ in range(60)] + [("g2", "is", None), ("g40", "is", "t1"), ("lost", "is", "t2")]
    edges = spark.createDataFrame(xref + terms, "source_entity_id string, relation_type string, target_entity_id string")
    nodes = spark.createDataFrame([(f"g{i}",) for i in range(41)], "entity_id string")
    want = {r["node"]: r["count"] for r in knowledge.terms_over_xrefs(nodes, edges, "is").groupBy("node").count().collect()}
    got = knowledge.term_counts_over_xrefs(nodes, edges, "is").collect()
    assert len(got) == len(want) and {r["node"]: r["terms"] for r in got} == want


def test_term_counts_beyond_one_bitmap(spark):
    """40,000 terms over one hub: more than the 32,768 bits of one."""
    has = spark.range(40_000).selectExpr("concat('g', id % 50) AS source_entity_id", "'is' AS relation_type", "concat('t', id) AS target_entity_id")
    hub = spark.range(50).selectExpr("concat('g', id) AS source_entity_id", "'has_a' AS relation_type", "'h' AS target_entity_id")
    got = knowledge.term_counts_over_xrefs(hub.selectExpr("source_entity_id AS entity_id"), has.unionByName(hub), "is").collect()
    assert len(got) == 50 and {r["terms"] for r in got} == {40_000}
