"""The registered queries and the pipeline over small Parquet tables with all edge cases, and over empty ones."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from siltstone.llm import registry

LONG = " ".join("w%d" % (i % 997) for i in range(180_000))  # about 1 MB
EXTRA = "score string, label string, held_out string, key string, h1 string, row string"
TABLES = {
    "documents": f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}",
    "labels": "doc_id long, quality int, toxic int, text string",
    "pages": "page_id long, url string, html string, text string, n_chars string",
    "embeddings": "vec_id long, embedding array<float>, label int, score string, rank string",
    "benchmark": "item_id long, text string, doc_id string",
}
#: The contracts' columns; more may follow.
CONTRACT = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    made = [" ".join(word() for _ in range(60)) for _ in range(30)]
    item = " ".join(word() for _ in range(20))
    return [None, "", " \n ", "...!!! 123", "a", LONG, LONG, *made, made[0], made[0], made[1] + " password=supersecret1", made[2] + " " + item, item], item


@pytest.fixture(scope="module", params=["edges", "empty"])
def folder(spark, tmp_path_factory, request):
    where = tmp_path_factory.mktemp(request.param)
    all_, item = texts()
    extra = ("x", "y", "z", "k", "h", "r")
    docs = [(i, t, ("aa", "bb", None)[i % 3], "s", len(t or ""), *extra) for i, t in enumerate(all_)] + [(None, "no id at all here", "aa", "s", 17, *extra), (8, all_[8], "aa", "s", 9, *extra)]
    labels = [(i, i % 2, (i // 2) % 2, "t") for i in range(len(all_))] + [(8, None, 1, "t"), (None, 1, 1, "t"), (9999, 1, 0, "t")]
    pages = [(1, "u", None, "x", "y"), (2, None, "", "x", "y"), (None, "u", "<article><p>Some words of a page.</p></article>", "x", "y"), (4, "u", "<div>" * 3000 + "deep", "x", "y"), (5, "u", "<p>" + LONG, "x", "y")]
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], 1, "s", "r") for i in range(60)] + [(60, None, 1, "s", "r"), (80, [None, 1.0], 1, "s", "r"), (None, [1.0], 1, "s", "r"), (3, [0.5] * 8, 1, "s", "r")]
    bench = [(1, item, "d"), (2, None, "d"), (None, item, "d"), (3, "...", "d"), (1, item, "d")]
    rows = {"documents": docs, "labels": labels, "pages": pages, "embeddings": vectors, "benchmark": bench}
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name] if request.param == "edges" else [], schema).write.parquet(f"{where}/{name}.parquet")
    return request.param, str(where), rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, name):
    kind, where, rows = folder
    df = registry.QUERIES[name](spark, where)
    want = CONTRACT.get(name, "").split(", ")
    if want != [""]:
        assert [f"{c} {t}" for c, t in df.dtypes][: len(want)] == want
    got = df.toPandas()
    if kind == "empty":
        assert got.empty
        return
    docs = rows["documents"]
    if name in ("op1_language_id", "op3_toxicity", "op5_quality", "op6_secret_scan", "op8_decontamination", "op9_token_counts", "op10_near_dedup"):
        assert Counter(None if pd.isna(i) else int(i) for i in got["doc_id"]) == Counter(r[0] for r in docs)
    for n, rest in ((5, 0), (3, 1)):
        if name in {5: ("op1_language_id", "op5_quality"), 3: ("op3_toxicity",)}[n]:
            for i, held, score in zip(got["doc_id"], got["held_out"], got["score"]):
                assert held == (not pd.isna(i) and zlib.crc32(str(int(i)).encode()) % n == rest) and 0 <= score <= 1
    if name == "op2_html_extraction":
        assert len(got) == len(rows["pages"]) and (got["text"].str.len() == got["n_chars"]).all()
    if name == "op4_packing":
        assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()
        assert {None if pd.isna(i) else int(i) for i in got["doc_id"]} == {r[0] for r in docs}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, folder, name, tmp_path):
    _, whole, _ = folder
    where = str(tmp_path)
    for table in TABLES:  # without the texts of a megabyte, for which the SQL takes the square of their words
        rows = spark.read.parquet(f"{whole}/{table}.parquet")
        (rows.where("coalesce(length(text), 0) < 10000") if table == "documents" else rows).write.parquet(f"{where}/{table}.parquet")
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{where}/{table}.parquet/*.parquet'")
    want, got = c.execute(registry.ORACLE_SQL[name]).fetchdf(), registry.QUERIES[name](spark, where).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    listed = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).map(lambda v: int(v) if isinstance(v, float) else v).itertuples(index=False, name=None)))
    assert listed(want) == listed(got)
