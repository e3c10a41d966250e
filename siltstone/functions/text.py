"""Column expressions on text: tokens, cleaning, keys, hashes and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """NULL for NULL, blank and '-'."""
    t = F.trim(c)
    return F.when((t != "") & (t != "-"), t)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def compact(c: Column, limit: int) -> Column:
    """White space collapsed; longer texts are cut to `limit` characters, the last three being dots."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def normalized_accession(c: Column) -> Column:
    """The second field of db|ACC|name, without a version."""
    parts = F.split(c, r"\|")
    return F.regexp_replace(F.when(F.size(parts) >= 2, parts[1]).otherwise(c), r"\.\d+$", "")


def safe_name(c: Column) -> Column:
    """Lower-case letters and digits, all else an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def gene_family(c: Column) -> Column:
    """Family prefix of immunoglobulin and T-cell receptor symbols, else NULL."""
    found = F.regexp_extract(F.upper(c), r"^((?:IG[HKL]V|TR[ABGD]V)[A-Z]*)", 1)
    return F.when(found != "", found)


def header_map(c: Column) -> Column:
    """key:value pairs of a header; a repeated key keeps its last value."""
    pairs = F.regexp_extract_all(c, F.lit(r"\b([A-Za-z_]+):([^\s]+)"), F.lit(0))
    key = lambda p: F.substring_index(p, ":", 1)
    keys = F.array_distinct(F.transform(pairs, key))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: key(p) == k), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.regexp_extract(last(k), r"^[A-Za-z_]+:(.*)$", 1)))


def labels_of(c: Column, pattern: str) -> Column:
    """Sorted different matches of a pattern's first group, trimmed of punctuation."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, "^[;,]+|[;,]+$", ""))))


def split_list(c: Column) -> Column:
    """Elements of a list written with pipes or commas; blanks and '-' go."""
    parts = F.transform(F.split(F.translate(F.coalesce(c, F.lit("")), "|", ","), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (x != "-"))


def joined_key(*cols: Column) -> Column:
    return F.concat_ws("|", *cols)


def token_id(namespace: str, c: Column) -> Column:
    """A stable id: the start of a SHA-1 of namespace and token."""
    return F.concat(F.lit(f"{namespace}:"), F.substring(F.sha1(F.concat(F.lit(f"{namespace}\u0000"), c)), 1, 16))


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def uuid5(namespace_hex: str, c: Column) -> Column:
    """Name-based UUID (version 5): SHA-1 of the namespace's bytes and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def flattened(metadata: Column) -> Column:
    """A map without NULL values, as JSON."""
    return F.to_json(F.map_filter(metadata, lambda k, v: v.isNotNull()))


def json_field(c: Column, path: str) -> Column:
    """A field of a JSON text; NULL where the text is no JSON."""
    return F.get_json_object(c, path)


def unflattened(c: Column) -> Column:
    """The map of a flattened JSON text; empty where it is none."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def optional_float(c: Column) -> Column:
    """NULL for what is no number."""
    return c.try_cast("double")


def optional_text(c: Column) -> Column:
    """NULL for NULL and empty texts."""
    return F.nullif(c.cast("string"), F.lit(""))


def as_list(c: Column) -> Column:
    """A scalar as an array of one, NULL and empty as an empty array."""
    t = optional_text(c)
    return F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.array(t))
