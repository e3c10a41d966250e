"""Worked values and invariants of the column expressions."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import sequence as seq
from siltstone.functions import text as tx
from siltstone.operators import corpus, fusion, splits


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("x")).first()["x"]


def test_windows_are_anchored_at_the_end(spark):
    got = one(spark, "abcdefghij", seq.windows(F.col("c"), 4, 3))
    assert [(w["start"], w["end"], w["text"]) for w in got] == [(0, 4, "abcd"), (3, 7, "defg"), (6, 10, "ghij")]
    assert [(w["start"], w["text"]) for w in one(spark, "abc", seq.windows(F.col("c"), 4, 3))] == [(0, "abc")]
    assert one(spark, "", seq.windows(F.col("c"), 4, 3)) == []


@pytest.mark.parametrize("n", range(1, 40))
def test_windows_match_a_plain_loop(spark, n):
    s = "".join(chr(97 + i % 26) for i in range(n))
    size, stride = 7, 3
    plain = [(0, n)] if n <= size else [(i, i + size) for i in range(0, n, stride) if i + size < n] + [(n - size, n)]
    assert [(w["start"], w["end"], w["text"]) for w in one(spark, s, seq.windows(F.col("c"), size, stride))] == [(a, b, s[a:b]) for a, b in plain]


def test_window_texts(spark):
    assert one(spark, "acgt acgt", seq.window_texts(F.col("c"), 4, 4)) == ["ACGTACGT", "ACGT"]


@pytest.mark.parametrize("text,kind", [("ACGTACGTACGT", "dna"), ("ACGUACGUACGU", "rna"), ("MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ", "protein"), ("MKTAYIAKQRQISFVKSHF", "peptide_fragment"), ("BRCA1 DNA repair", None), ("DNA repair", None), ("ACG", None), (None, None), (">x y\nACGTACGTAC", "dna")])
def test_detection(spark, text, kind):
    assert one(spark, text, seq.detected(F.col("c"))) == kind


def test_reverse_complement_is_an_involution(spark):
    assert one(spark, "ACGTNacgtn", seq.reverse_complement(F.col("c"))) == "nacgtNACGT"
    assert one(spark, "ACGTTGCA", seq.reverse_complement(seq.reverse_complement(F.col("c")))) == "ACGTTGCA"


def test_kmers(spark):
    assert one(spark, "ABCD", seq.kmers(F.col("c"), 3)) == ["ABC", "BCD"]
    assert one(spark, "AB", seq.kmers(F.col("c"), 3)) == []
    assert one(spark, "ACGTNA", seq.base5_ids(F.col("c"))) == [5 + 0 * 25 + 1 * 5 + 2, 5 + 25 + 10 + 3, 5 + 50 + 15 + 4, 5 + 75 + 20 + 0]


def test_encoder_input(spark):
    assert one(spark, "ACD UZOB", seq.encoder_input(F.col("c"), "spaced")) == "A C D X X X X"
    assert one(spark, "acgt n xyz 123", seq.encoder_input(F.col("c"), "dna")) == "ACGTN"


def test_middle_and_mutation(spark):
    assert one(spark, "abcdefghij", seq.middle(F.col("c"), 4)) == "defg"
    m = one(spark, "A" * 400, seq.mutated(F.col("c"), F.lit("k"), "CGT"))
    assert len(m) == 400 and 4 <= sum(ch != "A" for ch in m) <= 50


def test_text_helpers(spark):
    assert one(spark, "  a   b  c ", tx.compact(F.col("c"), 20)) == "a b c"
    assert one(spark, "abcdefghij klm", tx.compact(F.col("c"), 9)) == "abcdef..."
    assert one(spark, "sp|P12345.2|NAME", tx.normalized_accession(F.col("c"))) == "P12345"
    assert one(spark, " - ", tx.missing(F.col("c"))) is None
    assert one(spark, "a|b, c,,-", tx.split_list(F.col("c"))) == ["a", "b", "c"]
    assert one(spark, "IGHV1-2", tx.gene_family(F.col("c"))) == "IGHV"
    assert one(spark, "TP53", tx.gene_family(F.col("c"))) is None
    assert one(spark, "x gene:G1 gene:G2 chr:1", tx.header_map(F.col("c"))) == {"gene": "G2", "chr": "1"}
    assert one(spark, "Ab c-D!", tx.safe_name(F.col("c"))) == "ab_c_d"
    assert one(spark, "www.example.com", tx.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.col("c"))) == "2ed6657d-e927-568b-95e1-2665a8aea6a2"


def test_splits_partition(spark):
    rows = spark.range(2000).select(splits.hash_split(F.col("id")).alias("s")).groupBy("s").count().collect()
    got = {r["s"]: r["count"] for r in rows}
    assert sum(got.values()) == 2000 and 1500 < got["train"] < 1700


def test_over_fetch_and_routes(spark):
    assert [fusion.over_fetch("dna_window", n) for n in (10, 100)] == [1000, 5000] and fusion.over_fetch("text", 10) == 10
    assert one(spark, "dna", fusion.routes_of(F.col("c"))) == ["blast", "vector"]
    assert one(spark, None, fusion.routes_of(F.col("c"))) == ["fts", "graph", "vector"]


def test_labels(spark):
    got = one(spark, "ENST1 gene:ENSG1 gene_symbol:TP53; GN=tp53", corpus.biological_labels(F.col("c")))
    assert got["gene_ids"] == ["ENSG1"] and got["gene_symbols"] == ["TP53"] and got["protein_gene_names"] == ["tp53"]
