"""Operator 8: benchmark decontamination by a distributed positional inverted index.

The index holds every word of the training documents and doesn't depend on the test set. It is dealt by document: a shard
of about SHARD_BYTES of text keeps, for every different word (a 64-bit hash), the sorted positions where it stands, and the
documents' lengths in words. Shards are written to the shared folder; no posting is shuffled, so a frequent word is as cheap
as its postings in each shard.

A window (13 consecutive test words, or all of a shorter item) is looked up from its rarest word, by frequency in all shards:
the postings of that word are intersected with the lists of its neighbours in the test item, adjusted by their offsets,
outwards until a list has no such position. With a slop, every neighbour may stand up to that many other words further off.
Windows of one item with the same rarest word share that anchor. The test set is broadcast in blocks of about BLOCK_WORDS
words, so what is broadcast has a fixed bound; several blocks are matched one after another over the same index.

Null texts have no words and no hits. Repeated documents each get a row, null ids too; repeated items count once by id; items
without id or words take no part. Very long texts make a shard of their own. Further columns are not read by the query and
stay as they are in the stage, whatever they are called. Of empty tables the result is empty, or has no hits."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, stored, table, tuned
from siltstone.llm.words import of_text, raw, word_hashes

WINDOW, SHARD_BYTES, BLOCK_WORDS = 13, 250_000, 1_000_000
#: Other words that proximity() lets stand between neighbours of a window.
SLOP = 2
#: Parquet options of the index: its rows are some 200 KB each, and a writer holds a row group in memory.
BLOBS = {"parquet.block.size": str(4 << 20), "parquet.enable.dictionary": "false"}
#: Rows of hit documents that may be broadcast, about 24 bytes each.
BROADCAST_ROWS = 1_000_000


class TestSet:
    """One block of items as arrays of word hashes, and the places where their windows are looked up."""

    __test__ = False

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window, self.names = window, [i for i, _ in items]
        self.size = np.array([len(w) for _, w in items], dtype=np.int64)
        self.base = np.cumsum(self.size) - self.size
        flat = np.concatenate([w for _, w in items]) if items else np.zeros(0, dtype=np.uint64)
        self.terms, self.flat = np.unique(flat, return_inverse=True)  # different words; the items' words by number
        self.item = self.place = np.zeros(0, dtype=np.int64)

    def anchor(self, frequency: np.ndarray) -> TestSet:
        """Sets, for every window, the place of its rarest word; each place of an item once."""
        found = []
        for k, (base, n) in enumerate(zip(self.base.tolist(), self.size.tolist())):
            width, rare = min(self.window, n), frequency[self.flat[base : base + n]]
            found += [(k, p) for p in sorted({s + int(np.argmin(rare[s : s + width])) for s in range(n - width + 1)})]
        self.item, self.place = (np.array(x, dtype=np.int64) for x in (zip(*found) if found else ((), ())))
        return self


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[TestSet]:
    """The test set, read item by item, in blocks of bounded size."""
    items, n = [], 0
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("i"), "text")
    for r in rows.toLocalIterator():
        if len(ws := of_text(r["text"])):
            items.append((r["i"], ws))
            n += len(ws)
        if n >= most:
            yield TestSet(items, window)
            items, n = [], 0
    if items:
        yield TestSet(items, window)


class Shard:
    """Postings of some documents: different words in order, how often each stands, and where."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray):
        self.terms, self.counts, self.postings = terms, counts.astype(np.int64), postings.astype(np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        # All lists in one: a word's number times the shard's length, plus the position. In order, as the lists are.
        self.total = int(lengths.sum()) + 1
        self.lists = np.repeat(np.arange(len(terms)) * self.total, counts) + self.postings

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Each word's number among the shard's, -1 where it isn't there."""
        at = np.minimum(np.searchsorted(self.terms, words), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == words, at, -1) if len(self.terms) else np.full(len(words), -1)

    def holds(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the position is in the word's list."""
        key = number * self.total + position
        at = np.minimum(np.searchsorted(self.lists, key), len(self.lists) - 1)
        return (number >= 0) & (self.lists[at] == key)


def shard_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """terms, counts and postings of words by their position."""
    order = np.argsort(h, kind="stable")
    terms, counts = np.unique(h[order], return_counts=True)
    return terms, counts, order


def cut(batch: pa.RecordBatch, shard_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, word hashes, lengths) of each shard of a batch."""
    data, offsets = raw(batch)
    cuts = np.unique([0, *np.searchsorted(offsets, np.arange(shard_bytes, int(offsets[-1]), shard_bytes)), batch.num_rows]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield a, b, *word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


_INDEX = "shard long, doc_ids array<long>, keys array<long>, lengths binary, terms binary, counts binary, postings binary"


def indexed(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, doc_ids, keys, lengths, terms, counts, postings): one row a shard; keys are hashes of the documents' texts."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4]
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for whole in batches:
            for a, b, h, lengths in cut(whole, shard_bytes):
                terms, counts, at = shard_of(h)
                ids, keys = (column(whole, c).slice(a, b - a).to_pylist() for c in ("doc_id", "key"))
                narrow = "<u2" if len(h) < 1 << 16 else "<u4"  # what counts and positions are read as, too
                row = made, ids, keys, lengths.astype("<i4").tobytes(), terms.astype("<u8").tobytes(), counts.astype(narrow).tobytes(), at.astype(narrow).tobytes()
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")).mapInArrow(build, _INDEX)


def _array(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(column(batch, name)[row].as_buffer(), kind)


def _counts(batch: pa.RecordBatch, row: int, n: int) -> np.ndarray:
    """The counts of n words, 2 or 4 bytes each."""
    held = column(batch, "counts")[row].as_buffer()
    return np.frombuffer(held, "<u2" if held.size == 2 * n else "<u4").astype(np.int64)


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences of each of the sorted words in all documents; at most BLOCK_WORDS rows meet the driver."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)  # bounded by BLOCK_WORDS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(wanted.value), dtype=np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                have = _array(batch, "terms", r, "<u8")
                if len(have):
                    at = np.minimum(np.searchsorted(have, wanted.value), len(have) - 1)
                    sums += np.where(have[at] == wanted.value, _counts(batch, r, len(have))[at], 0)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    for r in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def intersect(tests: TestSet, shard: Shard, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, document of the shard, first, last) of runs of words that hold a whole window of the item, last exclusive.

    From each occurrence of an anchor outwards, step by step: what is reached at a step are the positions in the next word's
    list that lie 1 to slop + 1 words beyond one reached before. All of them are kept, so none is lost to a nearer one. Without
    slop a run covers all windows around its anchor; with slop it ends where the furthest reachable word is nearest."""
    none = (np.zeros(0, dtype=np.int64),) * 4
    number = shard.numbers(tests.terms)
    lead = number[tests.flat[tests.base[tests.item] + tests.place]] if len(tests.item) else np.zeros(0, dtype=np.int64)
    known = np.flatnonzero(lead >= 0)
    if not len(known):
        return none
    n = shard.counts[lead[known]]
    stop = np.cumsum(shard.counts)[lead[known]]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = shard.postings[np.repeat(stop - n, n) + within]
    item, place = np.repeat(tests.item[known], n), np.repeat(tests.place[known], n)
    doc = np.searchsorted(shard.ends, at, side="right")
    low, high, size = shard.begins[doc], shard.ends[doc], tests.size[item]
    steps, edge = {}, {}
    for step in (-1, 1):
        far, end = np.zeros(len(at), dtype=np.int64), at.copy()
        live, reached = np.arange(len(at)), at
        for d in range(1, tests.window):
            ok = (place[live] + step * d >= 0) & (place[live] + step * d < size[live])
            live, reached = live[ok], reached[ok]
            if not len(live):
                break
            word = number[tests.flat[tests.base[item[live]] + place[live] + step * d]]
            live, near, word = (np.repeat(x, slop + 1) for x in (live, reached, word))
            near = near + step * np.tile(np.arange(1, slop + 2), len(reached))
            ok = (near >= low[live]) & (near < high[live])
            live, near, word = live[ok], near[ok], word[ok]
            ok = shard.holds(word, near)
            live, reached = live[ok], near[ok]
            if slop and len(live):
                both = np.unique(live * shard.total + reached)
                live, reached = both // shard.total, both % shard.total
            far[live] = d
            order = np.lexsort((-step * reached, live)) if slop else slice(None)  # the nearest to the anchor is set last
            end[live[order]] = reached[order]
        steps[step], edge[step] = far, end
    good = np.flatnonzero(steps[-1] + steps[1] + 1 >= np.minimum(tests.window, size))
    begin = shard.begins[doc[good]]
    return item[good], doc[good], edge[-1][good] - begin, edge[1][good] + 1 - begin


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, np.ndarray, Shard]]:
    for batch in batches:
        for r in range(batch.num_rows):
            lengths = _array(batch, "lengths", r, "<i4").astype(np.int64)
            terms = _array(batch, "terms", r, "<u8")
            counts = _counts(batch, r, len(terms))
            narrow = "<u2" if int(lengths.sum()) < 1 << 16 else "<u4"
            shard = Shard(lengths, terms, counts, _array(batch, "postings", r, narrow))
            yield column(batch, "shard")[r].as_py(), column(batch, "doc_ids")[r].as_py(), column(batch, "keys")[r].as_py(), lengths, shard


def matches(index: DataFrame, tests: TestSet) -> DataFrame:
    """(shard, at, doc_id, key, n_words, hits, items) for each document: hits as 32-bit pairs of first and last word, last
    exclusive, of whole phrases; at is the document's place in its shard."""
    shared = index.sparkSession.sparkContext.broadcast(tests)  # bounded by BLOCK_WORDS

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard_id, ids, keys, lengths, shard in _shards(batches):
            hits, items = defaultdict(list), defaultdict(set)
            for k, d, a, b in zip(*(x.tolist() for x in intersect(shared.value, shard))):
                hits[d] += (a, b)
                items[d].add(shared.value.names[k])
            n = len(ids)
            columns = [pa.array([shard_id] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(lengths)]
            columns += [pa.array([np.array(hits.get(d, ()), "<i4").tobytes() for d in range(n)], pa.binary()), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "at", "doc_id", "key", "n_words", "hits", "items"])

    return index.mapInArrow(look, "shard long, at int, doc_id long, key long, n_words long, hits binary, items array<string>")


def phrases(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """matches() against the whole test set, one row for each row of documents."""
    index, found, n = stored(indexed(documents), "postings", **BLOBS), None, 0
    for tests in blocks(benchmark, block_words, window):
        part = matches(index, tests.anchor(frequencies(index, tests.terms)))
        found, n = part if found is None else found.unionByName(part), n + 1
    if found is None:
        return matches(index, TestSet([], window))
    if n == 1:
        return found
    merged = found.groupBy("shard", "at").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "key", "n_words")],
        F.unhex(F.array_join(F.collect_list(F.hex("hits")), "")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return merged.select("shard", "at", "doc_id", "key", "n_words", "hits", "items")


def proximity(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, first, last): where all the words of a window stand in order with at most `slop` other words
    between neighbours, looked up from the rarest word outwards. Exact phrases are those of slop 0. A run covers the windows
    around one occurrence of that word; a document that holds several runs has a row for each."""
    index, out = stored(indexed(documents), "postings", **BLOBS), None
    for tests in blocks(benchmark, block_words, window):
        shared = index.sparkSession.sparkContext.broadcast(tests.anchor(frequencies(index, tests.terms)))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for _, ids, _, _, shard in _shards(batches):
                found = {(d, shared.value.names[k], a, b) for k, d, a, b in zip(*(x.tolist() for x in intersect(shared.value, shard, slop)))}
                rows = list(zip(*[(ids[d], k, a, b) for d, k, a, b in sorted(found)])) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "first", "last"])

        part = index.mapInArrow(look, "doc_id long, item_id string, first long, last long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], "doc_id long, item_id string, first long, last long")


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def digested(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, key long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, items = column(batch, "n_words").to_pylist(), [sorted(set(i)) for i in column(batch, "items").to_pylist()]
            n_hit = [covered(h) for h in column(batch, "hits").to_pylist()]
            digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
            bad = [contaminated(h, n) for h, n in zip(n_hit, n_words)]
            columns = [column(batch, "doc_id"), column(batch, "n_words"), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_()), column(batch, "key")]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(digest, schema)


def covered(hits: bytes) -> int:
    """Words in the union of the pairs."""
    pairs, n, until = np.frombuffer(hits, "<i4").reshape(-1, 2), 0, 0
    for a, b in sorted(map(tuple, pairs.tolist())):
        n += max(0, b - max(a, until))
        until = max(until, b)
    return n


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    return digested(phrases(documents, benchmark, window, block_words)).drop("key")


def counted(documents: DataFrame, terms: np.ndarray) -> np.ndarray:
    """frequencies() of the sorted words without a stored index."""
    wanted = documents.sparkSession.sparkContext.broadcast(terms)  # bounded by BLOCK_WORDS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(wanted.value) + 1, dtype=np.int64)
        for batch in batches:
            for _, _, h, _ in cut(batch, SHARD_BYTES):
                at = np.minimum(np.searchsorted(wanted.value, h), len(wanted.value) - 1)
                sums += np.bincount(np.where(wanted.value[at] == h, at, len(wanted.value)), minlength=len(sums))
        some = np.flatnonzero(sums[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    for r in documents.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, least_share: float = 0.0) -> DataFrame:
    """The rows of documents without a whole window of the test set, all columns. With `least_share`, only those go in which
    hit words make that share of all words or more.

    A test set of one block is broadcast, and rows are filtered where they are read, against shards that are dropped again.
    The hits of several blocks add up, so these go through the stored index; rows are then told apart by id and text."""
    parts = blocks(benchmark, block_words, window)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return documents
    if second is None:
        shared = documents.sparkSession.sparkContext.broadcast(first.anchor(counted(documents, first.terms)))

        def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, dtype=bool)
                for a, _, h, lengths in cut(batch, SHARD_BYTES):
                    _, doc, begin, end = intersect(shared.value, Shard(lengths, *shard_of(h)))
                    for d in np.unique(doc).tolist():
                        hits = np.stack([begin[doc == d], end[doc == d]], axis=1).astype("<i4").tobytes()
                        good[a + d] = covered(hits) < least_share * int(lengths[d])
                yield batch.filter(pa.array(good))

        return documents.mapInArrow(filtered, documents.schema)
    found = digested(phrases(documents, benchmark, window, block_words))
    hit = found.where((F.col("n_hit") > 0) & (F.col("n_hit") >= least_share * F.col("n_words")))
    bad = stored(hit.select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct(), "hit")
    if bad.count() <= BROADCAST_ROWS:  # else a join by shuffle
        bad = F.broadcast(bad)
    return documents.join(bad, (F.xxhash64(documents["text"]) == bad["_bad_key"]) & documents["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    tuned(spark)
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def proximity_query(spark, sf_dir: str) -> DataFrame:
    """Proximity matches of all benchmark items in all documents, SLOP other words at most between neighbours."""
    tuned(spark)
    return proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a whole window of the test set go, however long they are."""
    tuned(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS g
  FROM b, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM d, sizes, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS u(s) WHERE len(w) >= n),
hits AS (SELECT r, s, n, item_id FROM grams JOIN wins USING (n, g)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) AS u(p) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
