"""Readers of sequence, annotation, literature and benchmark files."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources.shared import file_order

GAF = "db object_id symbol qualifier go_id reference evidence_code with_from aspect name synonyms object_type taxon date assigned_by extension product_form".split()
TASK = T.StructType().add("id", "string").add("query", "string").add("category", "string").add("query_type", "string").add("vector_target", "string").add("notes", "string").add("expected", T.MapType(T.StringType(), T.StringType()))


@dataclass(frozen=True)
class Settings:
    """Defaults of the pipelines; overridden by a mapping of the same names."""

    window: int = 128
    stride: int = 64
    least_window: int = 24
    limit: int = 10
    context_limit: int = 8
    evidence_chars: int = 900
    routes: tuple[str, ...] = ("fts", "graph", "vector")
    paths: dict = field(default_factory=dict)


def settings(path: str | None = None) -> Settings:
    """From a YAML (where its library is installed) or JSON file; defaults without one."""
    import json

    if not path:
        return Settings()
    with open(path) as f:
        text = f.read()
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text) or {}
    return Settings(**{k: v for k, v in found.items() if k in asdict(Settings())})


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence): one row a record, read at record boundaries so that plain files are split; empty records go."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r"))
    rows = raw.select(F.trim(F.regexp_extract("r", r"^([^\r\n]*)", 1)).alias("header"), F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s+", "").alias("sequence"))
    return rows.where((F.col("header") != "") & (F.col("sequence") != ""))


def header_fields(header: Column) -> Column:
    """db, accession, entry, name, organism, taxon and gene of a `db|ACC|ENTRY name OS=.. OX=.. GN=..` header."""
    at = lambda p: F.nullif(F.trim(F.regexp_extract(header, p, 1)), F.lit(""))
    return F.struct(
        F.coalesce(at(r"^[^|\s]+\|([^|\s]+)\|"), at(r"^(\S+)")).alias("accession"), at(r"^[^|\s]+\|[^|\s]+\|(\S+)").alias("entry"), at(r"^\S+\s+(.*?)(?:\s+[A-Z]{2}=|$)").alias("name"),
        at(r"\bOS=(.*?)(?:\s+[A-Z]{2}=|$)").alias("organism"), at(r"\bOX=(\d+)").alias("taxon"), at(r"\bGN=(\S+)").alias("gene"),
    )


def wanted(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows whose id is wanted."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")


def gaf(spark: SparkSession, path: str, at: bool = False) -> DataFrame:
    """Annotation lines of 15 columns or more, comments left out; with `at` their place in file order (_at)."""
    schema = ", ".join(f"{c} string" for c in GAF)
    rows = spark.read.csv(path, sep="\t", comment="!", schema=schema, quote="")
    rows = rows.withColumn("_at", file_order()) if at else rows
    return rows.where(F.col("assigned_by").isNotNull()).withColumn("negated", F.coalesce(F.array_contains(F.split("qualifier", r"\|"), "NOT"), F.lit(False))).withColumn("pmids", F.regexp_extract_all("reference", F.lit(r"PMID:(\d+)"), F.lit(1)))


def obo(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, name, namespace, definition, obsolete): [Term] stanzas only; each stanza ends at a blank line."""
    s = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("[Term]"))
    key = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    return s.select(key("id").alias("term_id"), key("name").alias("name"), key("namespace").alias("namespace"), F.nullif(F.regexp_extract("value", r'(?m)^def:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("definition"), F.coalesce(key("is_obsolete") == "true", F.lit(False)).alias("obsolete")).where("term_id is not null")


def tsv(spark: SparkSession, path: str, names: list[str], comment: str = "#") -> DataFrame:
    return spark.read.csv(path, sep="\t", comment=comment, schema=", ".join(f"{n} string" for n in names), quote="")


def reactome(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(source_id, pathway_id, url, name, evidence, organism) of wanted ids; of repeated pairs the last line in file order."""
    names = ["source_id", "pathway_id", "url", "name", "evidence", "organism"]
    rows = tsv(spark, path, names).withColumn("_at", file_order()).where(F.col("organism").isNotNull())
    return _last(wanted(rows, ids, "source_id"), names[:2], names[2:])


def _last(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_at").alias("_r")).select(*keys, "_r.*")


def goa(spark: SparkSession, path: str, ids: DataFrame, terms: DataFrame) -> DataFrame:
    """(object_id, go_id, name, namespace, evidence_code, qualifier, aspect): annotations of wanted proteins, the last of a pair,
    with the term's name, or its id where the ontology lacks it. terms: as obo()."""
    rows = gaf(spark, path, at=True)
    last = _last(wanted(rows, ids, "object_id"), ["object_id", "go_id"], ["evidence_code", "qualifier", "aspect"])
    return _termed(last, terms)


def _termed(rows: DataFrame, terms: DataFrame) -> DataFrame:
    t = terms.select(F.col("term_id").alias("go_id"), "name", "namespace")
    return rows.join(t, "go_id", "left").withColumn("name", F.coalesce("name", "go_id"))


def gene_to_go(spark: SparkSession, path: str, genes: DataFrame, terms: DataFrame) -> DataFrame:
    """(gene_id, go_id, name, namespace, evidence_code, qualifier, category) of wanted genes, the last line of a pair."""
    names = ["tax_id", "gene_id", "go_id", "evidence_code", "qualifier", "go_term", "pubmed", "category"]
    rows = tsv(spark, path, names).withColumn("_at", file_order()).where(F.col("category").isNotNull())
    return _termed(_last(wanted(rows, genes, "gene_id"), ["gene_id", "go_id"], ["evidence_code", "qualifier", "category"]), terms)


def gene_to_pubmed(spark: SparkSession, path: str, genes: DataFrame, most: int) -> DataFrame:
    """(gene_id, pmid): the first `most` of each gene in file order."""
    rows = tsv(spark, path, ["tax_id", "gene_id", "pmid"]).withColumn("_at", file_order())
    w = Window.partitionBy("gene_id").orderBy("_at")
    return wanted(rows, genes, "gene_id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("gene_id", "pmid")


def pubmed_xml(spark: SparkSession, path: str | list[str], pmids: DataFrame | None = None, file_limit: int = 0) -> DataFrame:
    """(pmid, title, abstract, journal, year) of PubmedArticle elements: of wanted pmids only, of the first files by name only."""
    schema = "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>>>"
    paths = path
    if file_limit:
        files = spark.read.format("binaryFile").load(path).select("path").distinct().orderBy("path").limit(file_limit)
        paths = [r["path"] for r in files.collect()]
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(",".join(paths) if isinstance(paths, list) else paths)
    a = "MedlineCitation.Article"
    out = rows.select(F.col("MedlineCitation.PMID").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), F.array_join(f"{a}.Abstract.AbstractText", " ").alias("abstract"), F.col(f"{a}.Journal.Title").alias("journal"), F.col(f"{a}.Journal.JournalIssue.PubDate.Year").alias("year"))
    return out if pmids is None else wanted(out, pmids, "pmid")


def pubmed_cache(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; the last row of a pmid in file order wins."""
    rows = spark.read.schema("pmid string, title string, abstract string, journal string, year string").json(path).withColumn("_at", file_order())
    return _last(rows, ["pmid"], ["title", "abstract", "journal", "year"])


def graph(spark: SparkSession, folder: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that sinks.sidecars() wrote."""
    return spark.read.format(form).load(f"{folder}/nodes"), spark.read.format(form).load(f"{folder}/edges")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark tasks as JSON lines; blank and # lines are skipped, a task without id or query is an error."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    t = rows.select(F.from_json("value", TASK).alias("t"), "value")
    need = lambda c: F.coalesce(F.col(f"t.{c}"), F.raise_error(F.concat(F.lit(f"task without {c}: "), F.substring("value", 1, 200))).cast("string"))
    return t.select(need("id").alias("id"), need("query").alias("query"), *[F.col(f"t.{f.name}") for f in TASK.fields if f.name not in ("id", "query")])


def jsonl(spark: SparkSession, path: str, schema: str | None = None, limit: int = 0) -> DataFrame:
    df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return df.limit(limit) if limit else df


def proteins(documents: DataFrame, text: str = "text", marker: str = "Sequence:\n") -> DataFrame:
    """accession and the sequence after the text's last marker."""
    return documents.select("accession", F.regexp_replace(F.substring_index(text, marker, -1), r"\s+", "").alias("sequence")).where(F.contains(F.col(text), F.lit(marker)))


def typed_documents(proteins: DataFrame, evidence: DataFrame) -> DataFrame:
    """One record an accession: its sequence and sorted different terms, papers and term-paper edges. Both: (accession, ...)."""
    e = evidence.groupBy("accession").agg(F.array_sort(F.collect_set("go_id")).alias("go_ids"), F.array_sort(F.collect_set("pmid")).alias("pmids"), F.array_sort(F.collect_set(F.struct("go_id", "pmid"))).alias("edges"))
    return proteins.join(e, "accession", "left")


def id_mapping(spark: SparkSession, path: str, ids: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(node, cluster) of wanted ids from three-column mapping lines of a kind, and the number of malformed lines."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    bad = lines.agg(F.count(F.when(F.size("p") != 3, 1)).alias("malformed"))
    rows = lines.where((F.size("p") == 3) & (F.col("p")[1] == kind)).select(F.col("p")[0].alias("node"), F.col("p")[2].alias("cluster"))
    return wanted(rows, ids, "node").groupBy("node").agg(F.min("cluster").alias("cluster")), bad


def selected_annotations(rows: DataFrame, codes: list[str], accessions: int, per_accession: int) -> DataFrame:
    """Annotations with an allowed code and a paper, not negated: the first accessions in file order (`at`), the first of each."""
    good = rows.where(F.col("evidence_code").isin(codes) & ~F.col("negated") & (F.size("pmids") > 0))
    first = good.groupBy("object_id").agg(F.min("at").alias("first")).orderBy("first").limit(accessions).select("object_id")
    w = Window.partitionBy("object_id").orderBy("at")
    return good.join(first, "object_id", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_accession).drop("_n")
