"""The command line over a small knowledge base."""

import json

import pytest

from siltstone import cli


@pytest.fixture
def kb(spark, tmp_path):
    rows = [(1, "gene", "7", "BRCA1", "breast cancer 1", "DNA repair", "own", "U1|U2"), (2, "gene", "8", "TP53", "tumor protein", "guards the genome", "own", "-"), (3, "term", "9", None, "repair", "of DNA", "own", None)]
    spark.createDataFrame(rows, "id long, kind string, source_id string, symbol string, name string, description string, source string, xrefs string").write.parquet(f"{tmp_path}/documents")
    return str(tmp_path)


def test_search_status_and_graph(spark, kb, tmp_path, capsys):
    found = cli.main(["search", "brca1 repair", "--kb", kb, "--limit", "2"], spark)
    assert [r["id"] for r in found] == [1, 3] and json.loads(capsys.readouterr().out.splitlines()[0])["symbol"] == "BRCA1"
    assert cli.main(["status", "--kb", kb], spark) == [{"kind": "gene", "n": 2}, {"kind": "term", "n": 1}]
    cli.main(["build-graph", "--kb", kb, "--out", f"{tmp_path}/graph"], spark)
    assert spark.read.parquet(f"{tmp_path}/graph/nodes").count() == 5 and spark.read.parquet(f"{tmp_path}/graph/edges").count() == 2
    cli.main(["init-schema", "--out", f"{tmp_path}/schema"], spark)
    assert spark.read.parquet(f"{tmp_path}/schema/entities").count() == 0


def test_vectors(spark, kb, tmp_path):
    assert cli.main(["build-vector", "--kb", kb, "--out", f"{tmp_path}/v"], spark) == [{"target": "text", "records": 3, "dims": 256, "backend": "hashing"}]
    assert cli.main(["vector-search", "TP53 tumor protein guards the genome", "--store", f"{tmp_path}/v", "--limit", "1"], spark)[0]["record_id"] == "text:2"


def test_lists_conditions_and_tools(spark):
    assert {"query": "bm25_topk", "sql": True} in cli.main(["list"])
    assert cli.main(["sql", "bm25_topk"])[0]["sql"].strip().startswith("WITH")
    assert {"condition": "classical", "routes": ["fts", "blast"]} in cli.main(["conditions"])
    tools = {t["name"]: t for t in cli.tools()}
    assert tools["search"]["parameters"]["kb"] == {"type": "string", "required": True} and "BM25" in tools["search"]["description"]
    with pytest.raises(ValueError):
        cli.condition("bad", "no such route")
