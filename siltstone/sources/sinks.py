"""Writers: empty schemas, graph sidecars, record stores, corpora and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import exists, numbered, stored

SCHEMAS = {
    "entities": "entity_id string, entity_type string, canonical_id string, name string, source string, description string, organism string, metadata map<string,string>",
    "aliases": "entity_id string, alias string, alias_type string, source string",
    "text_chunks": "chunk_id string, entity_id string, text string, source string, metadata map<string,string>",
    "sequences": "sequence_id string, entity_id string, alphabet string, sequence string, length long, metadata map<string,string>",
    "relations": "source_entity_id string, relation_type string, target_entity_id string, source string, confidence double, metadata map<string,string>",
    "retrieval_evidence": "query_id string, route string, entity_id string, score double, pos int, metadata map<string,string>",
    "retrieval_traces": "query_id string, route string, status string, hits long, elapsed_ms double, created_at timestamp",
}


def initialize(spark: SparkSession, folder: str) -> None:
    """An empty table for each schema."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def sidecars(nodes: DataFrame, edges: DataFrame, folder: str, form: str = "parquet") -> None:
    nodes.sort("entity_id").write.mode("overwrite").format(form).save(f"{folder}/nodes")
    edges.sort("source_entity_id", "relation_type", "target_entity_id").write.mode("overwrite").format(form).save(f"{folder}/edges")


def evidence_documents(proteins: DataFrame, annotations: DataFrame) -> DataFrame:
    """A row a protein, and one for each of its annotations' papers."""
    p = proteins.select(F.concat(F.lit("protein:"), "accession").alias("id"), F.lit("protein").alias("modality"), "accession", F.concat_ws("\n", "name", F.concat(F.lit("Sequence:\n"), "sequence")).alias("text"), F.lit(None).cast("string").alias("go_id"), F.lit(None).cast("string").alias("pmid"))
    a = annotations.select("accession", "go_id", F.explode("pmids").alias("pmid"))
    return p.unionByName(a.select(F.concat_ws(":", F.lit("evidence"), "accession", "go_id", "pmid").alias("id"), F.lit("evidence").alias("modality"), "accession", F.concat_ws(" ", "accession", "go_id", F.concat(F.lit("PMID:"), "pmid")).alias("text"), "go_id", "pmid"))


def added(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows behind the store's; ids that exist stay as they are."""
    return store.unionByName(rows.join(store.select("record_id"), "record_id", "left_anti"))


def upserted(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of the same id; of new rows that share an id one stays, the largest."""
    rest = [c for c in store.columns if c != "record_id"]
    new = rows.groupBy("record_id").agg(F.max(F.struct(*rest)).alias("_r")).select("record_id", "_r.*")
    return store.join(new.select("record_id"), "record_id", "left_anti").unionByName(new.select(*store.columns))


def updated(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Fields of existing ids where the new value isn't NULL; other ids are left out."""
    new = rows.select("record_id", *[F.col(c).alias(f"_{c}") for c in rows.columns if c != "record_id"])
    return store.join(new, "record_id", "left").select("record_id", *[F.coalesce(f"_{c}", c).alias(c) if c in rows.columns else F.col(c) for c in store.columns if c != "record_id"])


def deleted(store: DataFrame, rows: DataFrame) -> DataFrame:
    return store.join(rows.select("record_id"), "record_id", "left_anti")


def fetched(store: DataFrame, ids: list[str] | None = None, limit: int = 10, embeddings: bool = False) -> DataFrame:
    rows = store.where(F.col("record_id").isin(ids)) if ids is not None else store
    return (rows if embeddings else rows.drop("embedding")).limit(limit)


def imported(vectors: DataFrame, records: DataFrame) -> DataFrame:
    """Vectors (row_idx, embedding) with their records (row_idx, ...); different numbers of rows are an error."""
    if vectors.count() != records.count():
        raise ValueError("vectors and records differ in number")
    return records.join(vectors, "row_idx")


def replaced(df: DataFrame, folder: str) -> None:
    """All rows of the targets that df holds; other targets stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target").parquet(folder)


def appended(df: DataFrame, folder: str, key: str) -> None:
    """Rows whose key isn't there yet; a run that was broken off is continued by running it again."""
    spark = df.sparkSession
    done = exists(spark, folder) and exists(spark, f"{folder}/_SUCCESS")
    rows = df.join(spark.read.schema(df.schema).parquet(folder).select(key), key, "left_anti") if done else df
    rows.write.mode("append").parquet(folder)


def written_target(vectors: DataFrame, folder: str, target: str, backend: str) -> DataFrame:
    """A target's matrix (row_idx, embedding), id map (row_idx and all else) and one manifest row (target, records, dims,
    backend); returns the manifest. vectors: (record_id, embedding, ...); rows are numbered by record_id."""
    rows = stored(numbered(vectors, ["record_id"]), "target")
    rows.select("row_idx", "embedding").write.mode("overwrite").parquet(f"{folder}/{target}/matrix")
    rows.drop("embedding").write.mode("overwrite").parquet(f"{folder}/{target}/id_map")
    manifest = rows.agg(F.lit(target).alias("target"), F.count(F.lit(1)).alias("records"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims"), F.lit(backend).alias("backend"))
    manifest.write.mode("overwrite").parquet(f"{folder}/{target}/manifest")
    return manifest


def read_target(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """The records of a target that written_target() wrote, with their vectors."""
    return imported(spark.read.parquet(f"{folder}/{target}/matrix"), spark.read.parquet(f"{folder}/{target}/id_map"))


def record_batch(store: DataFrame, offset: int, size: int) -> DataFrame:
    """The rows of a store from a place on, by row_idx; the filter reaches the scan."""
    return store.where((F.col("row_idx") >= offset) & (F.col("row_idx") < offset + size))


def sample_queries(proteins: DataFrame, annotations: DataFrame, terms: DataFrame, limit: int = 50, size: int = 160) -> DataFrame:
    """id, query, accession, go_ids, pmids, go_names of the first `limit` annotated proteins: their first `size` residues.

    proteins: (accession, sequence); annotations: (accession, go_id, pmids); terms: (go_id, name)."""
    names = annotations.join(terms, "go_id").groupBy("accession").agg(F.array_sort(F.collect_set("name")).alias("go_names"))
    a = annotations.groupBy("accession").agg(F.array_sort(F.collect_set("go_id")).alias("go_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pmids")))).alias("pmids"))
    first = proteins.join(a, "accession").orderBy("accession").limit(limit).join(names, "accession", "left")
    return first.select(F.concat(F.lit("seq_lit_query:"), "accession").alias("id"), F.substring("sequence", 1, size).alias("query"), "accession", "go_ids", "pmids", F.coalesce("go_names", F.array().cast("array<string>")).alias("go_names"))


def without(df: DataFrame, held: DataFrame, col: str) -> DataFrame:
    """The index side of a held-out split."""
    return df.join(held.select(F.col(held.columns[0]).alias(col)), col, "left_anti")


def as_fasta(df: DataFrame, header: str, sequence: str, width: int = 60) -> DataFrame:
    """(value): FASTA records of wrapped lines, for write.text."""
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"))).alias("value"))


def corpus(df: DataFrame, folder: str) -> DataFrame:
    """Writes by partition; returns the partitions' sizes."""
    df.write.mode("overwrite").partitionBy("partition").parquet(folder)
    return df.sparkSession.read.parquet(folder).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


def bundle(documents: DataFrame, entities: DataFrame, relations: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checked tables of an application: no relation without its entities, no held-out accession among the documents."""
    from siltstone.operators.graphs import dangling

    if n := dangling(relations, entities).count():
        raise ValueError(f"{n} relations without an entity")
    if held is not None and (n := documents.join(held, "accession", "left_semi").count()):
        raise ValueError(f"{n} held-out documents")
    return documents, entities, relations


def pending(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """What an import has still to send: rows that the state table doesn't list as done."""
    return rows.join(state.where("status = 'done'").select(key), key, "left_anti")


def query_rows(df: DataFrame, id_col: str, sequence, size: int = 160) -> DataFrame:
    """Held-out queries: the middle `size` residues."""
    from siltstone.functions.sequence import middle

    return df.select(F.col(id_col).alias("id"), middle(sequence, size).alias("query"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
