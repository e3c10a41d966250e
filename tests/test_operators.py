"""Small cases of the operators, with values worked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.operators import alignment, answers, fusion, graphs, splits, statistics, text_search, vectors
from siltstone.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rrf(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)], "q int, item string, rank int")
    got = fusion.rrf(r, "q", "item", 60, 3).orderBy("rank").collect()
    assert [x["item"] for x in got] == ["b", "a", "c"] and got[0]["score"] == round(1 / 62 + 1 / 61, 9)


def test_append(spark):
    p = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcd", 1)], "q int, item string, rank int")
    s = spark.createDataFrame([(1, x, i) for i, x in enumerate("xbz", 1)], "q int, item string, rank int")
    assert [x["item"] for x in fusion.appended(p, s, "q", "item", 2, 6).orderBy("rank").collect()] == ["a", "b", "x", "z", "c", "d"]


def test_bm25_prefers_rare_terms_and_counts_queries(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue"), (4, None)], "id int, text string")
    q = spark.createDataFrame([(1, "fox red"), (2, "nothing")], "q int, text string")
    got = text_search.bm25(d, "id", F.col("text"), q, "q", F.col("text")).collect()
    assert [(r["q"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (1, 2)]


def test_upserts_keep_the_first_and_every_null_key(spark):
    a = spark.createDataFrame([("x", "s", 1), ("y", None, 2)], "k string, source string, v int")
    b = spark.createDataFrame([("x", "s", 9), ("y", None, 3)], "k string, source string, v int")
    assert rows(graphs.upserted([a, b], ["k", "source"]), "k", "v") == [("x", 1), ("y", 2), ("y", 3)]


def test_components_modularity_and_clusters(spark):
    p = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (5, 6, 1)], "u long, v long, weight long")
    assert rows(graphs.components(p), "node", "component") == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    c = graphs.clustered(spark.createDataFrame([(i,) for i in (1, 4, 6)], "node long"), p)
    assert rows(c, "node", "cluster") == [(1, 1), (4, 4), (6, 5)]
    m = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (5, 1), (6, 1)], "node long, community int")
    assert math.isclose(graphs.modularity(p, m).first()["modularity"], 2 / 3 - (4 / 6) ** 2 + 1 / 3 - (2 / 6) ** 2)


def test_greedy_communities_of_two_triangles(spark):
    e = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    p = spark.createDataFrame([("g", u, v) for u, v in e], "graph string, u long, v long")
    got = rows(graphs.greedy_communities(p, "graph"), "node", "community")
    assert {n for n, c in got if c == got[0][1]} == {1, 2, 3}


def test_degree_null_keeps_degrees(spark):
    e = [(i, j) for i in range(8) for j in range(i + 1, 8) if (i * j + i + j) % 3 != 1]
    p = spark.createDataFrame(e, "u long, v long")
    degree = dict(rows(graphs.degrees(p), "node", "degree"))
    for r in (1, 2):
        assert dict(rows(graphs.degrees(graphs.degree_null(p, 2).where(f"replicate = {r}")), "node", "degree")) == degree


def test_trace_stays_in_depth_and_budget(spark):
    e = spark.createDataFrame([("a", "r", "b", 1.0), ("b", "r", "c", 1.0), ("c", "r", "d", 1.0)], "source_entity_id string, relation_type string, target_entity_id string, confidence double")
    s = spark.createDataFrame([("a",)], "seed_id string")
    assert rows(graphs.traced(s, e, 2, 10), "u", "v", "depth") == [("a", "b", 1), ("b", "c", 2)]
    assert graphs.traced(s, e, 3, 1).count() == 1


def test_statistics(spark):
    h = spark.createDataFrame([("t", 10, 4, 3, 2)], "k string, population int, successes int, draws int, observed int")
    assert math.isclose(statistics.hypergeometric(h, ["k"]).first()["p"], (6 * 6 + 4) / 120)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    q = dict(rows(statistics.benjamini_hochberg(p, order=["k"]), "k", "q"))
    assert [round(q[k], 6) for k in "abcd"] == [0.04, 0.053333, 0.053333, 0.5]
    k = spark.createDataFrame([(0, 0), (4, 4), (2, 2)], "a int, b int")
    assert statistics.weighted_kappa(k, "a", "b", 0, 4).first()["kappa"] == 1.0
    b = spark.createDataFrame([("g", float(i % 5)) for i in range(100)], "g string, x double")
    r = statistics.bootstrap(b, "g", "x", samples=500).first()
    assert r["low"] < r["mean"] == 2.0 < r["high"]
    s = spark.createDataFrame([(["a", "b"], ["b", "c", "d"])], "p array<string>, e array<string>").select(*statistics.set_metrics(F.col("p"), F.col("e"))).first()
    assert (s["precision"], s["recall"], s["f1"], s["hit"]) == (0.5, round(1 / 3, 6), 0.4, True)


def test_permutation_stays_in_strata(spark):
    r = spark.createDataFrame([(i, i, i // 10) for i in range(40)], "id int, n int, label int")
    got = statistics.stratified_permutation(r, "id", "n", "label", 4, 1).collect()
    assert all(x["label"] == x["id"] // 10 for x in got) and len(got) == 40


def test_alignment(spark):
    assert alignment.local_alignment("ACDEFG", "XXACDEFGYY") == (12, 100.0, 6, 0, 6, 2, 8)
    assert alignment.local_alignment("AAAA", "CCCC")[0] == 0
    assert alignment.local_alignment("ACGTACGT", "ACGTCGT")[0] == 12
    o = spark.createDataFrame([("CDEFG", "ABCDEFG"), ("AAAAA", "CCCCC"), ("", "A"), (None, "A")], "a string, b string").select(alignment.overlap_score("a", "b").alias("o")).collect()
    assert [r["o"] for r in o] == [1.0, 0.0, 0.0, 0.0]
    q = spark.createDataFrame([(1, "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ")], "query_id int, query string")
    s = spark.createDataFrame([(7, "GGMKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQGG"), (8, "WWWWWWWWWW")], "subject_id int, subject string")
    assert [(r["subject_id"], r["identity"]) for r in alignment.search(q, s).collect()] == [(7, 100.0)]


def test_knn_and_pooling(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>")
    got = vectors.knn(v.withColumnRenamed("id", "query_id"), v, 1)
    assert dict(rows(got, "query_id", "id")) == {1: 2, 2: 1, 3: 2}
    t = spark.createDataFrame([(1, 0, [9.0, 9.0], True), (1, 1, [1.0, 3.0], False), (1, 2, [3.0, 5.0], False)], "d int, pos int, v array<double>, special boolean")
    assert vectors.pooled(t, "d").first()["v"] == [2.0, 4.0] and vectors.pooled(t, "d", "last").first()["v"] == [3.0, 5.0] and vectors.pooled(t, "d", "cls").first()["v"] == [9.0, 9.0]
    e = vectors.Embedders()
    e.register("length", lambda: lambda texts: [[float(len(x))] for x in texts])
    assert [r["v"] for r in e.embed(spark.createDataFrame([(1, "abc")], "id int, t string"), "id", "t", "length").collect()] == [[3.0]]
    with pytest.raises(ValueError):
        e.embed(v, "id", "v", "other")


def test_held_out_labels_stay_reachable(spark):
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in (i % 4, i % 5)], "item int, label int")
    held = splits.held_out(pairs, "item", "label", 3, 2, 100, "s")
    truth = splits.ground_truth(pairs, held, "item", "label")
    assert 0 < held.count() <= 3 and truth.agg(F.min("n_relevant")).first()[0] > 0
    assert truth.select("item").distinct().count() == held.count()


def test_containment_of_short_and_long_queries(spark):
    q = spark.createDataFrame([(1, "x" * 30), (2, "ab"), (3, "")], "query_id int, query string")
    t = spark.createDataFrame([(1, "aa" + "x" * 31), (2, "zab"), (3, "x" * 29)], "id int, text string")
    assert rows(splits.containment(q, t), "query_id", "id") == [(1, 1), (2, 2)]


def test_audit_of_answers(spark):
    a = spark.createDataFrame([(1, "Conclusion GO:0000001 is shown [G1]. Evidence [P2]. Limitations: may vary."), (2, "It proves GO:0000009 [G9] [x]."), (3, "insufficient evidence")], "id int, answer string")
    reg = spark.createDataFrame([(1, "G1", "GO:0000001"), (1, "P2", "123")], "id int, citation string, identifier string")
    got = {r["id"]: r for r in answers.audit(a, reg).collect()}
    assert (got[1]["citation_validity"], got[1]["entailment"], got[1]["format_compliance"], got[1]["calibrated"]) == (1.0, 1.0, True, True)
    assert (got[2]["citation_validity"], got[2]["entailment"], got[2]["overclaims"], got[2]["citation_syntax"]) == (0.0, 0.0, True, False)
    assert got[3]["abstains"] and got[3]["citation_validity"] == 1.0


def test_record_store(spark):
    s = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "record_id string, n int, d string")
    r = spark.createDataFrame([("b", None, "z"), ("c", 3, "w")], "record_id string, n int, d string")
    assert rows(sinks.added(s, r), "record_id", "d") == [("a", "x"), ("b", "y"), ("c", "w")]
    assert rows(sinks.upserted(s, r), "record_id", "d") == [("a", "x"), ("b", "z"), ("c", "w")]
    assert rows(sinks.updated(s, r), "record_id", "n", "d") == [("a", 1, "x"), ("b", 2, "z")]
    assert rows(sinks.deleted(s, r), "record_id") == [("a",)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">sp|P1|E1 Some name OS=Homo sapiens OX=9606 GN=TP53\nMKT\nAYI\n>x\n\n>y z\nACG\n")
    got = readers.fasta(spark, str(tmp_path / "a.fa"))
    assert rows(got, "sequence") == [("ACG",), ("MKTAYI",)]
    h = got.where("sequence = 'MKTAYI'").select(readers.header_fields(F.col("header")).alias("h")).first()["h"]
    assert (h["accession"], h["entry"], h["name"], h["organism"], h["taxon"], h["gene"]) == ("P1", "E1", "Some name", "Homo sapiens", "9606", "TP53")
    (tmp_path / "go.obo").write_text('format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nnamespace: bp\ndef: "first \\"x\\"" [a]\n\n[Typedef]\nid: part_of\nname: wrong\n\n[Term]\nid: GO:2\nname: two\nis_obsolete: true\n')
    assert rows(readers.obo(spark, str(tmp_path / "go.obo")), "term_id", "name", "obsolete") == [("GO:1", "one", False), ("GO:2", "two", True)]
    line = "\t".join(["UniProtKB", "P1", "TP53", "NOT|involved_in", "GO:1", "PMID:12|GO_REF:1", "IDA", "", "P", "", "", "protein", "taxon:9606", "20200101", "X"])
    (tmp_path / "a.gaf").write_text("!comment\n" + line + "\nshort\tline\n")
    g = readers.gaf(spark, str(tmp_path / "a.gaf")).collect()
    assert len(g) == 1 and g[0]["negated"] and g[0]["pmids"] == ["12"]
    (tmp_path / "t.jsonl").write_text('# note\n\n{"id": "1", "query": "q", "expected": {"symbols": "TP53"}}\n')
    assert rows(readers.tasks(spark, str(tmp_path / "t.jsonl")), "id", "query") == [("1", "q")]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="task without query"):
        readers.tasks(spark, str(tmp_path / "bad.jsonl")).collect()


def test_streaming_ingest_is_resumable(spark, tmp_path):
    from siltstone.streaming import ingest

    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")], "record_id string, t string").select("record_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        ingest.ingest(ingest.records(spark, src, schema), out, state).awaitTermination(120)
    assert rows(spark.read.parquet(out), "record_id") == [("a",), ("b",)]


def test_paths_have_a_total_order(spark):
    e = spark.createDataFrame([(1, x, 5) for x in "dcba"] + [(1, "z", 1)], "query_id int, entity_id string, ord long").coalesce(1)
    c = spark.createDataFrame([(1, "a", "E5")], "query_id int, entity_id string, citation string")
    assert rows(graphs.paths(e, c), "path", "entity_id", "citation") == [("P1", "z", None), ("P2", "a", "E5"), ("P3", "b", None), ("P4", "c", None), ("P5", "d", None)]
