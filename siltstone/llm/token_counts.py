"""Operator 9: edit-aware token counts over segment trees of pre-tokens, kept for every document.

A document's text is cut into pieces of whole pre-tokens (about LEAF space-separated parts each) before spaces where the
vocabulary's pattern always starts a pre-token. built() encodes each piece once and keeps, for every row of documents, the
pieces' lengths and token counts; that table is written to the shared folder. edited() loads a document's tree from it without
encoding anything: leaves hold the counts and lengths of pieces, inner nodes their sums. An edit goes down to the leaves it
touches, and to those whose edge it could shift, encodes these anew and updates the sums above them, in steps that grow with
the logarithm of the number of pieces; all other pieces keep their counts. Totals equal encoding the whole edited text.

Null texts count as empty (0 tokens, one empty piece). Each row of documents gives one row, repeated ones too; null ids are
passed through, and take no edits from a table. Very long texts are one row and one tree each; a text without a cut is one
piece. Edits are clipped to the text. Further columns aren't read; an empty table gives an empty one."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, stored, table, tuned
from siltstone.llm.tokens import Tokens, tokens, vocabulary_path

LEAF = 48
#: Pieces in one leaf from which on the leaves are laid out anew.
CROWDED = 4
#: Edits that may be broadcast to the trees, by number and by characters of new text.
BROADCAST_EDITS, BROADCAST_CHARS = 500_000, 50_000_000

Edit = tuple[int, int, str]


def segments(text: str, leaf: int = LEAF) -> list[str]:
    """Cuts before spaces that stand between two characters which aren't white space."""
    parts = text.split(" ")
    out, mine = [], [parts[0]]
    for before, part in zip(parts, parts[1:]):
        if len(mine) >= leaf and before and part and not before[-1].isspace() and not part[0].isspace():
            out.append(" ".join(mine))
            mine = ["", part]
        else:
            mine.append(part)
    return [*out, " ".join(mine)]


class Tree:
    """Token counts of one document: leaves of pieces, and the sums of their tokens and characters."""

    def __init__(self, pieces: list[str], counts: list[int], tok: Tokens, leaf: int = LEAF):
        self.tok, self.leaf, self.encoded = tok, leaf, 0
        self._lay(pieces, counts)

    @classmethod
    def of(cls, text: str, tok: Tokens, leaf: int = LEAF) -> Tree:
        """Encodes a text."""
        pieces = segments(text, leaf)
        tree = cls(pieces, list(map(tok.count, pieces)), tok, leaf)
        tree.encoded = len(text)
        return tree

    @classmethod
    def kept(cls, text: str, chars: list[int], counts: list[int], tok: Tokens, leaf: int = LEAF) -> Tree:
        """From what built() kept; nothing is encoded."""
        pieces, at = [], 0
        for n in chars:
            pieces.append(text[at : at + n])
            at += n
        return cls(pieces, counts, tok, leaf)

    def _lay(self, pieces: list[str], counts: list[int]) -> None:
        self.leaves = [([p], [c]) for p, c in zip(pieces, counts)]
        self.width = 1 << max(0, (len(pieces) - 1).bit_length())
        rest = [0] * (self.width - len(pieces))
        self.n_tokens = [0] * self.width + counts + rest
        self.n_chars = [0] * self.width + list(map(len, pieces)) + rest
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.n_tokens[i] = self.n_tokens[2 * i] + self.n_tokens[2 * i + 1]
        self.n_chars[i] = self.n_chars[2 * i] + self.n_chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.n_tokens[1]

    @property
    def length(self) -> int:
        return self.n_chars[1]

    @property
    def pieces(self) -> list[str]:
        return [p for pieces, _ in self.leaves for p in pieces]

    @property
    def counts(self) -> list[int]:
        return [c for _, counts in self.leaves for c in counts]

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; the last leaf beyond the end."""
        if place >= self.n_chars[1]:
            return len(self.leaves) - 1, self.n_chars[1] - self.n_chars[self.width + len(self.leaves) - 1]
        i, base = 1, 0
        while i < self.width:
            i *= 2
            if place - base >= self.n_chars[i]:
                base += self.n_chars[i]
                i += 1
        return i - self.width, base

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces the code points start to end; returns the new total."""
        size = self.length
        start, end = min(max(0, start), size), min(max(start, end), size)
        # A cut is sure if the characters on both sides of it and the one after its space stay as they are.
        first, base = self._leaf_at(max(0, start - 2))
        last = max(first, self._leaf_at(min(size - 1, end + 1))[0]) if size else first
        old = "".join(p for pieces, _ in self.leaves[first : last + 1] for p in pieces)
        changed = segments(old[: start - base] + new + old[end - base :], self.leaf)
        counts = list(map(self.tok.count, changed))
        self.encoded += sum(map(len, changed))
        lots, n = last + 1 - first, len(changed)
        if n > CROWDED * lots:
            self.leaves[first : last + 1] = [(changed, counts)]
            self._lay(self.pieces, self.counts)
            return self.total
        touched = set()
        for k in range(lots):  # spread over the leaves that held the old text, some of them empty if it shrank
            mine = slice(k * n // lots, (k + 1) * n // lots)
            self.leaves[first + k] = (changed[mine], counts[mine])
            i = self.width + first + k
            self.n_tokens[i], self.n_chars[i] = sum(counts[mine]), sum(map(len, changed[mine]))
            touched.add(i >> 1)
        while touched and 0 not in touched:
            for i in touched:
                self._sum(i)
            touched = {i >> 1 for i in touched}
        return self.total


_TREES = "doc_id long, text string, chars array<int>, tokens array<int>"


def built(documents: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, text, chars, tokens): each row's pieces by length and token count. Encodes all texts; keep the result."""
    path = path or vocabulary_path()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(path)
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            cut = [segments(t, leaf) for t in texts]
            lists = pa.list_(pa.int32())
            chars, counts = pa.array([list(map(len, p)) for p in cut], lists), pa.array([list(map(tok.count, p)) for p in cut], lists)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string()), chars, counts], ["doc_id", "text", "chars", "tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, _TREES)


_EDITED = "n_tokens long, n_segments long, edit_start long, edit_end long, n_tokens_after long, n_reencoded long, n_chars_after long"


def _applied(trees: DataFrame, edits_of: Callable[[pa.RecordBatch, int, str], list[Edit]], path: str | None, leaf: int, state: bool) -> DataFrame:
    """doc_id, n_tokens, n_segments, start and end of the first edit, then after all edits: n_tokens_after, n_reencoded (code
    points encoded for them), n_chars_after; with `state` the new text, chars and tokens too, a row to keep."""
    path, extra = path or vocabulary_path(), ", text string, chars array<int>, tokens array<int>" if state else ""
    names = ["doc_id", *(c.split()[0] for c in (_EDITED + extra).split(", "))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(path)
        for batch in batches:
            rows, states = [], []
            for k, (t, chars, counts) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("text", "chars", "tokens")))):
                tree, edits = Tree.kept(t, chars, counts, tok, leaf), edits_of(batch, k, t)
                before = tree.total
                for a, b, new in edits:
                    tree.edit(a, b, new)
                a, b = edits[0][:2] if edits else (None, None)
                rows.append((before, len(chars), a, b, tree.total, tree.encoded, tree.length))
                if state:
                    states.append((tree.text, list(map(len, tree.pieces)), tree.counts))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 7)]
            if state:
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                cols += [pa.array(c, t) for c, t in zip(zip(*states) if states else [()] * 3, kinds)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *cols], names)

    return trees.mapInArrow(apply, f"doc_id long, {_EDITED}{extra}")


def edited(trees: DataFrame, edits: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Applies a table of edits (doc_id, seq, start, end, new) to kept trees, those of one document by seq, then start, end
    and text. Every row of the trees gives one row with counts before and after and its new state (text, chars, tokens).
    Rows that share an id all take its edits; edits of unknown ids and with nulls are left out."""
    whole = edits.dropna(subset=["doc_id", "seq", "start", "end", "new"])
    of = whole.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))).alias("_edits"))
    n, chars = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("new")), F.lit(0))).first()
    if n <= BROADCAST_EDITS and chars <= BROADCAST_CHARS:  # else a join by shuffle
        of = F.broadcast(of)
    both = trees.join(of, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "chars", "tokens", "_edits")
    listed = lambda batch, k, _: [(e["start"], e["end"], e["new"]) for e in column(batch, "_edits")[k].as_py() or []]
    return _applied(both, listed, path, leaf, True)


def probe_edit(doc_id: int | None, text: str) -> Edit:
    """The edit that the query applies to each document, set by the id alone: 0 to 19 code points at a place in the text
    are replaced by one of four texts."""
    h = zlib.crc32(str(doc_id).encode())
    start = h % (len(text) + 1)
    return start, min(len(text), start + (h >> 8) % 20), ("", " edited", "x y  z", "\n(new) 12 words' end ")[(h >> 16) % 4]


def counted(documents: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Keeps the trees of all documents and applies one probe edit to each; the columns of _EDITED behind doc_id."""
    trees = stored(built(documents, path, leaf), "trees")
    return _applied(trees, lambda batch, k, text: [probe_edit(column(batch, "doc_id")[k].as_py(), text)], path, leaf, False)


def query(spark, sf_dir: str) -> DataFrame:
    return counted(table(tuned(spark), sf_dir, "documents"))
