"""Knowledge-base rows, typed texts, corpus partitions and task annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import sequence as seq
from siltstone.functions.text import labels_of, missing

#: Patterns of labels in sequence headers.
LABEL_PATTERNS = {"gene_ids": r"\bgene:([A-Za-z0-9_.-]+)", "gene_symbols": r"\bgene_symbol:([^\s\]]+)", "protein_gene_names": r"\bGN=([^\s]+)", "gene_biotypes": r"\bgene_biotype:([^\s\]]+)", "transcript_biotypes": r"\btranscript_biotype:([^\s\]]+)"}


def entity_id(kind: Column, source_id: Column) -> Column:
    return F.concat(kind, F.lit(":"), source_id.cast("string"))


def typed_text(kind: Column, fields: dict[str, Column]) -> Column:
    """[TYPE=kind] and the fields that aren't missing, a line each."""
    return F.concat_ws("\n", F.concat(F.lit("[TYPE="), kind, F.lit("]")), *[F.when(missing(v).isNotNull(), F.concat(F.lit(f"{k}: "), missing(v))) for k, v in fields.items()])


def sequence_records(df: DataFrame, id_col: str, text: Column, target: str) -> DataFrame:
    """record_id, target, text, length of the sequences that aren't empty."""
    s = seq.clean(text)
    return df.select(F.concat(F.lit(f"{target}:"), F.col(id_col).cast("string")).alias("record_id"), F.lit(target).alias("target"), s.alias("text"), F.length(s).alias("length")).where("length > 0")


def window_records(df: DataFrame, id_col: str, text: Column, target: str, size: int = 128, stride: int = 64, least: int = 24, source_limit: int = 0, emit_limit: int = 0) -> DataFrame:
    """A row a window: record_id, parent, start, end, text; windows shorter than `least` go. The limits, if not 0, keep the
    first sources by id and the first windows by parent and start."""
    sources = df.orderBy(id_col).limit(source_limit) if source_limit else df
    cleaned = sources.select(F.col(id_col).alias("parent"), seq.clean(text).alias("s"))  # once, not at each mention
    rows = cleaned.select("parent", F.explode(seq.windows(F.col("s"), size, stride)).alias("w")).where(F.col("w.end") - F.col("w.start") >= least)
    out = rows.select(F.concat_ws(":", F.lit(target), F.col("parent").cast("string"), F.col("w.start").cast("string"), F.col("w.end").cast("string")).alias("record_id"), "parent", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.text").alias("text"))
    return out.orderBy("parent", "start").limit(emit_limit) if emit_limit else out


def mixed_records(parts: list[DataFrame], limit: int, order: str = "record_id") -> DataFrame:
    """Equal shares of several sources, the rest from the last; each one's first rows by `order`."""
    share = limit // len(parts)
    sizes = [share] * (len(parts) - 1) + [limit - share * (len(parts) - 1)]
    out = None
    for part, n in zip(parts, sizes):
        rows = part.orderBy(order).limit(n)
        out = rows if out is None else out.unionByName(rows)
    return out


def records_for(target: str, sources: dict[str, DataFrame], limit: int = 0, size: int = 128, stride: int = 64) -> DataFrame:
    """record_id, text of a target: text, entity, protein_sequence, dna_sequence, protein_window, dna_window or mixed (thirds of
    text, protein and DNA). sources: text (id, text), protein and dna (id, sequence). Other targets are an error."""
    kind, _, form = target.partition("_")
    if target in ("text", "entity"):
        out = sources["text"].select(F.concat(F.lit(f"{target}:"), F.col("id").cast("string")).alias("record_id"), "text")
    elif target == "mixed":
        total = limit or sum(s.count() for s in sources.values())
        parts = [records_for(k, sources) for k in ("text", "protein_sequence", "dna_sequence")]
        return mixed_records(parts, total)
    elif kind in ("protein", "dna") and form == "sequence":
        out = sequence_records(sources[kind], "id", F.col("sequence"), target).select("record_id", "text")
    elif kind in ("protein", "dna") and form == "window":
        out = window_records(sources[kind], "id", F.col("sequence"), target, size, stride).select("record_id", "text")
    else:
        raise ValueError(f"unknown target {target!r}")
    return out.orderBy("record_id").limit(limit) if limit else out


def biological_labels(header: Column) -> Column:
    return F.create_map(*[x for k, p in LABEL_PATTERNS.items() for x in (F.lit(k), labels_of(header, p))])


def modality(target: Column) -> Column:
    return F.when(target.contains("protein"), "protein").when(target.contains("dna"), "dna").when(target.contains("rna"), "rna").otherwise("text")


def entity_type(target: Column) -> Column:
    return F.when(target.endswith("_window"), "sequence_window").when(target.contains("sequence"), "sequence").when(target.contains("text"), "text_chunk").otherwise("entity")


#: What an edge's source says of its evidence.
CURATED_SOURCES = ("goa", "uniprot", "ontology", "taxonomy", "pubmed")


def _said(source: Column, by_code: Column, code: Column, blast: str, vector: str, curated: str, other: str) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    any_of = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(s, w))
    has = F.coalesce(F.trim(code) != "", F.lit(False))
    return F.when(any_of("blast"), blast).when(any_of("vector", "dense"), vector).when(has, by_code).when(any_of(*CURATED_SOURCES), curated).otherwise(other)


def evidence_level(source: Column, code: Column) -> Column:
    """By an edge's source and its evidence code."""
    return _said(source, F.lit("curated_experimental_annotation"), code, "alignment_verified", "retrieved_unverified", "curated_database_assertion", "derived_dataset_edge")


def verification_method(source: Column, code: Column) -> Column:
    return _said(source, F.concat(F.lit("GOA:"), F.trim(code)), code, "sequence_alignment", "dense_similarity_only", "curated_record", "dataset_construction_rule")


def database_version(source: Column, date: Column) -> Column:
    """The source with the record's date, or a local snapshot."""
    name, day = F.replace(F.coalesce(source, F.lit("local")), F.lit(" "), F.lit("_")), F.trim(F.coalesce(date, F.lit("")))
    return F.concat(name, F.when(day != "", F.concat(F.lit("@record-date-"), day)).otherwise("@local-snapshot"))


def label_type(expected: Column) -> Column:
    """exact if there are ids, biological if there are biological labels, else none; of a map of arrays."""
    has = lambda *ks: F.exists(F.map_values(F.map_filter(expected, lambda k, v: k.isin(list(ks)))), lambda v: F.size(v) > 0)
    return F.when(has("entity_ids", "source_ids", "accessions", "record_ids"), "exact").when(has(*LABEL_PATTERNS), "biological").otherwise("none")


def matches_expected(item: dict[str, Column], expected: dict[str, Column]) -> Column:
    """Any expected id, accession, symbol (any case) or part of a title. Expected values are arrays; NULL counts as empty."""
    none = F.array().cast("array<string>")
    arr = lambda k: F.coalesce(expected[k], none) if k in expected else none
    val = lambda k: F.coalesce(item[k], F.lit("")) if k in item else F.lit("")
    up = lambda a: F.transform(a, F.upper)
    has = lambda a, v: (v != "") & F.array_contains(a, v)
    return has(F.concat(arr("entity_ids"), arr("record_ids")), val("entity_id")) | has(arr("source_ids"), val("source_id")) | has(arr("accessions"), val("accession")) | has(up(arr("symbols")), F.upper(val("symbol"))) | F.exists(arr("title_contains"), lambda t: F.contains(F.lower(val("title")), F.lower(t)))


def labels_match(kind: str, left: Column, right: Column) -> Column:
    """Whether two label maps share a label of the kind; any_identity: of any kind."""
    if kind == "any_identity":
        return F.exists(F.map_keys(left), lambda k: F.arrays_overlap(F.transform(left[k], F.upper), F.transform(F.coalesce(right[k], F.array().cast("array<string>")), F.upper)))
    return F.coalesce(F.arrays_overlap(F.transform(left[kind], F.upper), F.transform(right[kind], F.upper)), F.lit(False))


def status(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(F.col(by).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
