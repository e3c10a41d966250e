"""Operator 6: secret scan by patterns and a token-efficiency test.

Base spans come from three patterns. The test then measures runs of credential characters in characters per token under a
public vocabulary: text compresses, random strings do not. A run of WHOLE_RUN characters or more with letters and digits is
added as kind `random` if its ratio is below `max_ratio`, unless it is an identifier (words and numbers joined by separators).
Other runs are split at their separators, and each stretch of parts whose own ratio is below `max_ratio` is added if it has
`min_chars` characters or more, with or without digits; readable parts around it don't count. Numbers and parts of one or
two letters tell nothing and are left out of both; runs and parts that are known digests (hex of a digest's length) or UUIDs
are not added, nor are spans that overlap a base span. Spans are of whole matches or stretches, in code points, end exclusive.

Null texts count as empty. Every row gives one row; ids are passed through, null and repeated ones too. Whole texts are read, very
long ones too; time grows with a text's length and its spans, not their square. Base spans of several kinds may overlap and all
stay. Further columns, whatever they are called, aren't read by the scan, and stay as they are when secrets are blanked out, but
for n_chars, which follows the text. Empty tables give no rows."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, table, tuned
from siltstone.llm.tokens import tokens, vocabulary_path

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PART = re.compile(r"[A-Za-z0-9]+")
#: The least length of a run that is measured as a whole, and of a stretch of parts.
WHOLE_RUN, MIN_CHARS = 20, 16
#: Of a stretch: readable characters beyond its random ones' excess that end it.
READABLE = 12
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
_IDENTIFIER = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[+/_.=-]+(?:[A-Za-z]+|[0-9]+))*[+/_.=-]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@cache
def _run(least: int) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % least)


def is_random(run: str, count, max_ratio: float) -> bool:
    """The token-efficiency test for one run as a whole."""
    if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
        return False
    if _UUID.fullmatch(run) or (len(run) in _DIGEST_CHARS and _DIGEST.fullmatch(run)) or _IDENTIFIER.fullmatch(run):
        return False
    return len(run) / max(1, count(run)) < max_ratio


def stretches(run: str, count, max_ratio: float, min_chars: int) -> Iterator[tuple[int, int]]:
    """The stretches of a run's parts that compress worse than `max_ratio` taken together."""
    uuids = [m.span() for m in _UUID.finditer(run)] if run.count("-") > 3 else []
    parts = []  # start, end, excess of tokens over what text takes, characters that count
    for m in _PART.finditer(run):
        part, (a, b) = m.group(), m.span()
        if any(s <= a < e for s, e in uuids) or len(part) in _DIGEST_CHARS and _DIGEST.fullmatch(part):
            parts.append((a, b, None, 0))
        elif part.isdigit() or len(part) < 3 and part.isalpha():
            parts.append((a, b, 0.0, 0))
        else:
            parts.append((a, b, max_ratio * count(part) - len(part), b - a))
    i = 0
    while i < len(parts):
        if not parts[i][2] or parts[i][2] < 0:
            i += 1
            continue
        total, best, last, unmeasured, at_last = 0.0, 0.0, i, 0, 0
        for k in range(i, len(parts)):
            a, b, excess, chars = parts[k]
            if excess is None:
                break
            total += excess
            unmeasured += 0 if chars else b - a
            if total > best:
                best, last, at_last = total, k, unmeasured
            if total <= 0 or best - total > READABLE:
                break
        a, b = parts[i][0], parts[last][1]
        if b - a - at_last >= min_chars:
            yield a, b + len(run) - b - len(run[b:].lstrip("="))
        i = last + 1


def spans(text: str, count, max_ratio: float = 2.0, min_chars: int = MIN_CHARS) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    # Base spans as unions in order: a new span overlaps one if the last union that starts before its end reaches into it.
    starts, ends = [], []
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    more = []
    for m in _run(min(min_chars, WHOLE_RUN)).finditer(text):
        run, at = m.group(), m.start()
        whole = len(run) >= WHOLE_RUN and is_random(run, count, max_ratio)
        for a, b in [(0, len(run))] if whole else stretches(run, count, max_ratio, min_chars):
            k = bisect.bisect_left(starts, at + b) - 1
            if k < 0 or ends[k] <= at + a:
                more.append((at + a, 3, at + b))
    return sorted(base + more) if more else base


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str = "<SECRET>") -> str:
    """Each union of overlapping spans becomes one mark."""
    out, at, until = [], 0, -1
    for a, _, b in found:
        if a >= until:
            out += [text[at:a], mark]
        until = max(until, b)
        at = until
    return "".join(out) + text[at:]


def scan(documents: DataFrame, path: str | None = None, max_ratio: float = 2.0, min_chars: int = MIN_CHARS) -> DataFrame:
    path = path or vocabulary_path()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens(path).count
        for batch in batches:
            every = [spans(t or "", count, max_ratio, min_chars) for t in column(batch, "text").to_pylist()]
            n = [[sum(k == kind for _, k, _ in s) for s in every] for kind in range(4)]
            digest = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in every]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(x, pa.int64()) for x in n[:3]), pa.array(digest, pa.string()), pa.array([joined(s) for s in every], pa.string()), pa.array(n[3], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(documents: DataFrame, path: str | None = None, max_ratio: float = 2.0, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents with every span replaced; n_chars, where there is such a column, follows the text. Null texts stay."""
    path, schema = path or vocabulary_path(), documents.schema
    counted = "n_chars" in documents.columns

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens(path).count
        for batch in batches:
            texts, chars = column(batch, "text").to_pylist(), column(batch, "n_chars").to_pylist() if counted else []
            for i, t in enumerate(texts):
                if t and (s := spans(t, count, max_ratio, min_chars)):
                    texts[i] = redacted(t, s)
                    if counted:
                        chars[i] = len(texts[i])
            for name, values in (("text", texts), *([("n_chars", chars)] if counted else [])):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return documents.mapInArrow(cleaned, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(tuned(spark), sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are blanked out; every document stays."""
    tuned(spark)
    return redact(docs)
