"""Column expressions on biological sequences: cleaning, detection, windows, k-mers and overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column, stop: bool = True) -> Column:
    """Upper-case letters, and * where stops are allowed."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}*]+" if stop else r"[^\p{L}]+", "")


def reverse_complement(c: Column) -> Column:
    return F.translate(F.reverse(c), "ACGTNacgtn", "TGCANtgcan")


def detected(c: Column, least: int = 8) -> Column:
    """dna, rna, protein (25 residues or more) or peptide_fragment; NULL if the text reads as language.

    A text with a FASTA header is a sequence; another must be letters and * in one piece, or in pieces of which the longest
    has 12 characters or more."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    s = clean(F.regexp_replace(raw, r"(?m)^[ \t]*>.*$", ""))
    pieces = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    shaped = raw.startswith(">") | raw.rlike(r"^[A-Za-z*\s]+$") & ((F.size(pieces) <= 1) | (F.array_max(F.transform(pieces, F.length)) >= 12))
    kind = (  # fixed values: the alphabets with their ambiguity codes
        F.when(s.rlike("^[ACGTNRYKMSWBDHV]+$"), "dna")
        .when(s.rlike("^[ACGUNRYKMSWBDHV]+$"), "rna")
        .when(s.rlike("^[ABCDEFGHIKLMNPQRSTVWXYZ*]+$"), F.when(F.length(s) >= 25, "protein").otherwise("peptide_fragment"))
    )
    return F.when(shaped & (F.length(s) >= least), kind)


def _inner(length: Column, size: int, stride: int) -> Column:
    """How many windows start at a stride and end before the end."""
    return F.ceil((length - size) / stride).cast("int")


def eval_windows(length: Column, size: int, stride: int, least: int = 24) -> Column:
    """Array of (start, end): a window at each stride while it fits inside, and one at the tail; none shorter than `least`."""
    last = F.greatest(length - size, F.lit(0))
    starts = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, length).alias("end")))
    return F.filter(spans, lambda w: w["end"] - w["start"] >= min(least, size))


def windows(c: Column, size: int, stride: int) -> Column:
    """Array of (start, end, text).

    Texts are put together from neighbouring pieces of one stride: a substring at a place costs as much as all that is
    before it, and what a lambda refers to is evaluated for each element."""
    n, near = F.length(c), -(-size // stride)
    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    zipped = F.slice(F.arrays_zip(*[F.slice(pieces, j + 1, F.greatest(F.size(pieces) - j, F.lit(0))).alias(f"p{j}") for j in range(near)]), F.lit(1), F.greatest(_inner(n, size, stride), F.lit(0)))
    window = lambda z, i: F.struct((i * stride).alias("start"), (i * stride + size).alias("end"), F.substring(F.concat_ws("", *[z[f"p{j}"] for j in range(near)]), 1, size).alias("text"))
    last = F.struct(F.greatest(n - size, F.lit(0)).alias("start"), n.alias("end"), F.right(c, F.lit(size)).alias("text"))
    return F.when(n <= 0, F.array().cast("array<struct<start:int,end:int,text:string>>")).when(n <= size, F.array(last)).otherwise(F.concat(F.transform(zipped, window), F.array(last)))


def window_texts(c: Column, size: int, stride: int, most: int = 8, whole: bool = True) -> Column:
    """Different window texts in order, the whole first, `most` at most."""
    s = clean(c)
    parts = F.transform(windows(s, size, stride), lambda w: w["text"])
    return F.slice(F.array_distinct(F.concat(F.array(s), parts) if whole else parts), 1, most)


def edge_windows(c: Column, size: int = 128) -> Column:
    """The first and the last window only."""
    n = F.length(c)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.array(F.lit(0), n - size))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))


def kmers(c: Column, k: int) -> Column:
    """All k-mers in order; none if shorter. One pass of a pattern that looks ahead."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def middle(c: Column, size: int = 160) -> Column:
    start = F.greatest(F.floor((F.length(c) - size) / 2), F.lit(0)).cast("int")
    return F.substr(c, start + 1, F.lit(size))


def fragment(c: Column, recipe: str, size: int) -> Column:
    """prefix, suffix, middle or exact."""
    n = F.length(c)
    return {"prefix": F.substring(c, 1, size), "suffix": F.substr(c, F.greatest(n - size, F.lit(0)) + 1, F.lit(size)), "middle": middle(c, size), "exact": c}[recipe]


def mutated(c: Column, key: Column, alphabet: str, rate: float = 0.05) -> Column:
    """Residues replaced where a hash of key and place says so, at about `rate`."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    draw = lambda i: F.conv(F.substring(F.sha1(F.concat_ws(":", key, i)), 1, 7), 16, 10).cast("long")
    letter = lambda i: F.substr(F.lit(alphabet), ((draw(i) / 1000).cast("long") % len(alphabet) + 1).cast("int"), F.lit(1))
    return F.when(F.length(c) == 0, c).otherwise(F.array_join(F.transform(spots, lambda i: F.when(draw(i) % 1000 < int(rate * 1000), letter(i)).otherwise(F.substr(c, i, F.lit(1)))), ""))


def encoder_input(c: Column, form: str) -> Column:
    """spaced: residues apart, rare ones X; dna: the five bases only; plain: as it is."""
    if form == "spaced":
        return F.trim(F.regexp_replace(F.regexp_replace(clean(c, stop=False), "[UZOB]", "X"), "(.)", "$1 "))
    return F.regexp_replace(F.upper(c), "[^ACGTN]", "") if form == "dna" else c


def base5_ids(c: Column, k: int = 3, specials: int = 5) -> Column:
    """Ids of k-mers over ACGTN, after the special tokens."""
    bases = F.array(*map(F.lit, "ACGTN"))
    digit = lambda m, j: F.array_position(bases, F.substring(m, j + 1, 1)) - 1
    return F.transform(kmers(F.regexp_replace(F.upper(c), "[^ACGTN]", "N"), k), lambda m: (sum(digit(m, j) * 5 ** (k - 1 - j) for j in range(k)) + specials).cast("int"))


def kmer_containment(a: Column, b: Column, k: int) -> Column:
    """Shared different k-mers over the smaller set."""
    x, y = F.array_distinct(kmers(a, k)), F.array_distinct(kmers(b, k))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))


def kmer_jaccard(a: Column, b: Column, k: int) -> Column:
    x, y = F.array_distinct(kmers(a, k)), F.array_distinct(kmers(b, k))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))
