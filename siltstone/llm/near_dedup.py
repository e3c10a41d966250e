"""Operator 10: near duplicates by improved consistent weighted sampling (ICWS).

A text is the multiset of its five-word shingles (all its words, if fewer); words are runs of digits, letters and
non-ASCII characters, A-Z lower-cased. A shingle weighs its count times a saturating inverse document frequency:

    idf = min(1, max(IDF_FLOOR, ln(N / df) / ln(1 / IDF_FULL)))

so shingles in less than IDF_FULL of all documents weigh 1 and only widespread boilerplate weighs less, never under
IDF_FLOOR; a large group of near copies keeps its similarity. Shingles that reach IDF_FULL are few (at most the average
length over IDF_FULL), so df is counted exactly for those alone: mergeable summaries of all blocks of documents leave a few
candidates, and a second pass counts them everywhere.

1. Rows of equal text form a class; its smallest doc_id stands for it.
2. Each text gets BANDS keys of ROWS ICWS samples each, and one that repeats shingles gets BANDS more as if each stood
   once, for the plain similarity. Texts that share a key are candidates. The idf alone, never under IDF_FLOOR, leaves a plain
   similarity of 0.8 a weighted one of 2/3 at least, which 12 bands of 3 find in 98 % of all pairs.
3. Buckets of the same members are compared once. A bucket of over BUCKET_BLOCK texts is cut into blocks, so no task holds an
   unbounded group; each block is compared with a few representatives of the bucket, and what isn't near to them with every
   block. Within a task overlaps are counted over an inverted list of shingles, and texts are linked whose weighted Jaccard similarity is SIMILARITY or more, or whose plain
   one is (all weights 1): a large group makes its own shingles frequent, and must not be parted by that. Texts that are
   linked already, over others, are not compared again. Nothing is capped or sampled.
4. Components of the links give class ids by repeated minima with pointer jumping, a stored table each round.

Null texts are classes of their own, as are null ids (class id null); texts without words are classes by equal text.
Repeated rows of one id give a row each. An id that stands on different texts takes part with each of them: its rows belong to
the classes of their texts, also where two of these have the same smallest id, and each is kept or dropped by its own text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, stored, table, tuned
from siltstone.llm.words import STEP, mixed, raw, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
IDF_FULL, IDF_FLOOR = 0.01, 0.5
BUCKET_BLOCK = 1024
#: Texts of a large bucket that all its others are compared with first.
REPRESENTATIVES = 16
#: Candidates of the frequent shingles that one pass counts; further ones take further passes.
SLICE = 2_000_000
#: Shingles of a block of documents that are counted together, 8 bytes each.
HELD = 2_000_000
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 17
#: Ids that may be broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240301)
_LAG = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SAMPLES = BANDS * ROWS
_TIMES = _rng.integers(1, 2**63, _SAMPLES, dtype=np.uint64) | np.uint64(1)
# ICWS draws by sample: r from Gamma(2, 1) and beta uniform by 16 bits of the shingle's hash, c from Gamma(2, 1) by 16 others,
# so that two shingles have the same draws with a chance of 2**-32.
_R = _rng.gamma(2.0, 1.0, (_SAMPLES, 1 << 16)).astype(np.float32)
_C = _rng.gamma(2.0, 1.0, (_SAMPLES, 1 << 16)).astype(np.float32)
_BETA = _rng.random((_SAMPLES, 1 << 16), dtype=np.float32)
_LOW = np.uint64(0xFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, shingles of each text): each text's different shingles, sorted by hash."""
    if len(data) > CHUNK and len(offsets) > 2:  # chunks that stay in cache
        cuts = sorted({0, *np.searchsorted(offsets, np.arange(CHUNK, len(data), CHUNK)).tolist(), len(offsets) - 1})
        if len(cuts) > 2:
            return tuple(np.concatenate(x) for x in zip(*(shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in zip(cuts, cuts[1:]))))
    h, n = word_hashes(data, offsets)
    first = np.cumsum(n) - n
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), made)
    at = np.repeat(first, made) + np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
    out, left = np.zeros(len(at), dtype=np.uint64), n[doc]
    for lag in range(SHINGLE):
        use = at[left > lag] if lag else at
        if lag and len(use) < len(at):
            out[left > lag] += h[use + lag] * _LAG[lag]
        else:
            out += h[use + lag] * _LAG[lag]
    out = mixed(out)
    ends = np.cumsum(made)
    for a, b in zip((ends - made).tolist(), ends.tolist()):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    return out[starts], np.diff(np.append(starts, len(out))), np.bincount(doc[starts], minlength=len(n))


def frequent(documents: DataFrame, n: int, share: float = IDF_FULL) -> dict[int, int]:
    """df of every shingle in at least `share` of the n documents, whatever the partitions.

    Candidates are heavy hitters by mergeable summaries: a block of d documents takes half of share x d, rounded down, from
    each shingle's count and passes on what is left. All blocks together take at most half of share x n, so a shingle whose
    sum falls under the other half can't be frequent; the few that stay are counted exactly."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0

        def block() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            c = c - int(share * docs / 2)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 0].view(np.int64)), pa.array(c[c > 0])], ["h", "n"])

        for batch in batches:
            held.append(shingles(*raw(batch))[0])
            docs, size = docs + batch.num_rows, size + len(held[-1])
            if size >= HELD:
                yield block()
                held, docs, size = [], 0, 0
        if docs:
            yield block()

    if not n:
        return {}
    texts = documents.select("text")
    heavy = texts.mapInArrow(local, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= share * n / 2).select("h")
    candidates = stored(heavy, "frequent")
    total, found = candidates.count(), {}  # at most twice the average length over share
    slices = max(1, -(-total // SLICE))
    for k in range(slices):  # one, unless the texts are of book length
        part = np.sort(candidates.where(F.pmod("h", F.lit(slices)) == k).toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64))
        shared = documents.sparkSession.sparkContext.broadcast(part)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            sums = np.zeros(len(wanted), dtype=np.int64)
            for batch in batches:
                h = np.sort(shingles(*raw(batch))[0])
                sums += np.searchsorted(h, wanted, side="right") - np.searchsorted(h, wanted, side="left")
            keep = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[keep].view(np.int64)), pa.array(sums[keep])], ["h", "n"])

        if len(part):
            df = texts.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= share * n)
            found |= {r["h"]: r["n"] for r in df.toLocalIterator()}
    return found


def idf_table(df: dict[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of the shingles that weigh less than 1."""
    h = np.array(sorted(df), dtype=np.int64)
    weight = np.array([min(1.0, max(IDF_FLOOR, math.log(max(1.0, n / df[k])) / math.log(1 / IDF_FULL))) for k in h.tolist()])
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], weight[order]


def weights(h: np.ndarray, count: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = count.astype(np.float32)
    if len(idf[0]) and len(h):
        at = np.minimum(np.searchsorted(idf[0], h), len(idf[0]) - 1)
        hit = idf[0][at] == h
        w[hit] *= idf[1][at[hit]].astype(np.float32)
    return w


def samples(h: np.ndarray, w: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """ICWS: one row of _SAMPLES keys for each text that has shingles.

    For weight w: t = floor(ln w / r + beta), y = exp(r (t - beta)), a = c / (y exp(r)); the shingle of the least a is
    the sample, with t. For w = 1, the usual weight, t is 0."""
    starts = (np.cumsum(per_text) - per_text)[per_text > 0]
    out = np.zeros((len(starts), _SAMPLES), dtype=np.uint64)
    if not len(h):
        return out
    odd = np.flatnonzero(w != 1)
    log_w, low = np.log(w[odd]), h & _LOW
    for k in range(_SAMPLES):
        x = h * _TIMES[k]
        at, c = (x >> np.uint64(48)).astype(np.int64), _C[k][(x >> np.uint64(32)).astype(np.uint16)]
        key = _bits(_unit(k)[at] * c) | low
        if len(odd):
            i = at[odd]
            r, beta = _R[k][i], _BETA[k][i]
            t = np.floor(log_w / r + beta)
            a = (c[odd] * np.exp(-r * (t - beta) - r)).astype(np.float32)
            other = mixed(low[odd] + t.astype(np.int64).view(np.uint64) * STEP) & _LOW
            key[odd] = _bits(a) | np.where(t == 0, low[odd], other)
        out[:, k] = np.minimum.reduceat(key, starts)
    return out


_units: dict[int, np.ndarray] = {}


def _unit(k: int) -> np.ndarray:
    """a / c for weight 1 by 16 bits of the hash."""
    if k not in _units:
        _units[k] = np.exp(_R[k] * _BETA[k] - _R[k]).astype(np.float32)
    return _units[k]


def _bits(a: np.ndarray) -> np.ndarray:
    """In the upper half of a key: positive floats sort as their bits."""
    return a.view(np.uint32).astype(np.uint64) << np.uint64(32)


def band_keys(keys: np.ndarray) -> np.ndarray:
    out = np.zeros((len(keys), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(keys), b + 1, dtype=np.uint64) * STEP
        for r in range(ROWS):
            h = mixed(h + keys[:, b * ROWS + r] * _LAG[r])
        out[:, b] = h
    return out


_SIGNED = "doc_id long, bands array<long>, h binary, w binary"


def signed(texts: DataFrame, idf: tuple[np.ndarray, np.ndarray], also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, bands, h, w): band keys, the low 32 bits of the shingles' hashes, their weights (empty: all 1). `also`
    names further columns of type long that are passed through."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)  # at most the average length / IDF_FULL entries

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                h, count, n = shingles(*raw(batch))
                w = weights(h, count, shared.value)
                bands = np.zeros((len(n), BANDS), dtype=np.uint64)
                bands[n > 0] = band_keys(samples(h, w, n))
                plain = np.zeros((len(n), BANDS), dtype=np.uint64)
                doc = np.repeat(np.arange(len(n)), n)
                again = np.bincount(doc[count != 1], minlength=len(n)) > 0
                if again.any():
                    use = again[doc]
                    plain[again] = band_keys(samples(h[use], weights(h[use], np.ones(int(use.sum())), shared.value), n[again]))
                both = np.concatenate([bands, plain], axis=1).view(np.int64)
                held = np.concatenate([np.ones_like(bands, dtype=bool), again[:, None] & (plain != bands)], axis=1)
                cuts = np.cumsum(n)[:-1]
                kept_h = [x.tobytes() for x in np.split((h & _LOW).astype(np.uint32), cuts)]
                kept_w = [b"" if (x == 1).all() else x.tobytes() for x in np.split(w, cuts)]
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(held.sum(1))).astype(np.int32), pa.array(both[held]))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists, pa.array(kept_h, pa.binary()), pa.array(kept_w, pa.binary()), *(column(batch, c) for c in also)], ["doc_id", "bands", "h", "w", *also]).filter(pa.array(n > 0))

    return texts.select("doc_id", "text", *also).mapInArrow(sign, ", ".join([_SIGNED, *(f"{c} long" for c in also)]))


class Pile:
    """Texts of one task by an inverted list of their shingles."""

    def __init__(self, h: list[np.ndarray], w: list[np.ndarray], similarity: float = SIMILARITY):
        self.n, self.similarity = len(h), similarity
        self.size = np.array([len(x) for x in h])
        doc, self.weight = np.repeat(np.arange(self.n), self.size), np.concatenate(w).astype(np.float64)
        _, self.term = np.unique(np.concatenate(h), return_inverse=True)
        order = np.argsort(self.term, kind="stable")
        self.by_doc, self.by_weight = doc[order], self.weight[order]
        self.listed = np.bincount(self.term)
        self.starts = np.cumsum(self.listed) - self.listed
        self.total, self.first = np.bincount(doc, self.weight, self.n), np.cumsum(self.size) - self.size
        self.unit = bool((self.weight == 1).all())

    def near(self, i: int) -> np.ndarray:
        """The texts, i among them, whose weighted or plain Jaccard similarity with i reaches the threshold."""
        own = slice(self.first[i], self.first[i] + self.size[i])
        terms = self.term[own]
        m = self.listed[terms]
        at = np.repeat(self.starts[terms], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        common = np.bincount(self.by_doc[at], None, self.n)
        found = common >= self.similarity * (self.size + self.size[i] - common) - 1e-9
        if not self.unit:
            shared = np.bincount(self.by_doc[at], np.minimum(self.by_weight[at], np.repeat(self.weight[own], m)), self.n)
            found |= shared >= self.similarity * (self.total + self.total[i] - shared) - 1e-9
        return np.flatnonzero(found)


def linked(pile: Pile, asks: np.ndarray | None = None) -> np.ndarray:
    """The component (smallest member) of each text, of all links of the texts that ask (all, if not given)."""
    root, done = np.arange(pile.n), np.zeros(pile.n, dtype=bool) if asks is None else ~asks
    while True:
        # Pairs within a component need no look: once all texts outside the largest have been compared with all, it is done.
        outside = np.flatnonzero(~done & (root != np.bincount(root, minlength=pile.n).argmax()))
        if not len(outside):
            return root
        i = int(outside[0])
        done[i] = True
        roots = np.unique(root[pile.near(i)])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]


def _pile(cell: pa.Table, similarity: float) -> Pile:
    h = [np.frombuffer(x, dtype=np.uint32) for x in cell.column("h").to_pylist()]
    w = [np.frombuffer(x, dtype=np.float32) if x else np.ones(len(k), dtype=np.float32) for x, k in zip(cell.column("w").to_pylist(), h)]
    return Pile(h, w, similarity)


def _star(ids: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    use = np.flatnonzero(ids[root] != ids)
    return ids[root[use]], ids[use]


def links(signatures: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, block: int = BUCKET_BLOCK) -> DataFrame:
    """(a, b): a spanning star for each component that a task finds. signatures: the texts that take part."""
    keys = signatures.select("doc_id", F.explode("bands").alias("key")).select("doc_id", F.xxhash64("key").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("members")).where("n > 1")
    # Buckets of the same members, as most bands of a group have them, are compared once.
    chosen = stored(buckets.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    blobs = texts.select("doc_id", "h", "w")

    def whole(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("doc_id")
        return pa.table(list(_star(cell.column("doc_id").to_numpy(), linked(_pile(cell, similarity)))), names=["a", "b"])

    small = keys.join(chosen.where(F.col("n") <= block).select("bucket"), "bucket").join(blobs, "doc_id")
    out = small.groupBy("bucket").applyInArrow(whole, "a long, b long")
    large = chosen.where(F.col("n") > block)
    if not large.limit(1).count():
        return out.distinct()
    parts = F.ceil(F.col("n") / block).cast("int")
    members = keys.join(large.select("bucket", parts.alias("parts")), "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int"))
    return out.unionByName(_large(members, blobs, similarity, block)).distinct()


def _large(members: DataFrame, blobs: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links in buckets of several blocks; members: (bucket, doc_id, part, parts).

    Each block is compared with some REPRESENTATIVES of its bucket. Texts near to one of the largest linked group of these
    are settled: they are one component, and pairs among them need no look. Each other text is compared with all of the
    bucket, block by block. A large group of near copies so takes as many rows as it has texts, not their square."""
    slot = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(REPRESENTATIVES))
    chosen = members.groupBy("bucket", slot.alias("slot")).agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts"))
    placed = chosen.select("bucket", "doc_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"))
    rows = members.select("bucket", "doc_id", "part", F.lit(False).alias("asks")).unionByName(placed)

    def represented(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("asks", "descending"), ("doc_id", "ascending")])
        ids, bucket = cell.column("doc_id").to_numpy(), cell.column("bucket")[0].as_py()
        n, pile = int(np.count_nonzero(cell.column("asks").to_numpy(zero_copy_only=False))), _pile(cell, similarity)
        near = [pile.near(i) for i in range(n)]
        group = np.arange(n)  # of representatives alone, so that all blocks of a bucket agree on it
        for i, found in enumerate(near):
            found = found[found < n]
            group[np.isin(group, group[found])] = group[found].min() if len(found) else group[i]
        most = np.bincount(group, minlength=n).argmax() if n else 0
        settled = np.zeros(len(ids), dtype=bool)
        for i, found in enumerate(near):
            if group[i] == most:
                settled[found] = True
        a = np.concatenate([np.full(len(f), ids[i]) for i, f in enumerate(near)]) if n else np.zeros(0, dtype=np.int64)
        b = ids[np.concatenate(near)] if n else np.zeros(0, dtype=np.int64)
        left = ids[n:][~settled[n:]]
        a, b, use = a.astype(np.int64), b.astype(np.int64), a != b
        nothing = pa.nulls(len(left), pa.int64())
        columns = [pa.concat_arrays([pa.array(a[use]), nothing]), pa.concat_arrays([pa.array(b[use]), pa.array(left)])]
        return pa.table([pa.array([bucket] * len(columns[0]), pa.int64()), *columns], names=["bucket", "a", "b"])

    first = stored(rows.join(blobs, "doc_id").groupBy("bucket", "part").applyInArrow(represented, "bucket long, a long, b long"), "represented")
    left = first.where("a is null").select("bucket", F.col("b").alias("doc_id"))
    counts = left.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("lots"))
    sized = members.join(counts, "bucket")
    asking = left.join(sized.groupBy("bucket").agg(F.first("parts").alias("parts"), F.first("lots").alias("lots")), "bucket")
    lot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("lots")).cast("int")
    cells = asking.select("bucket", "doc_id", lot.alias("lot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks")).unionByName(
        sized.select("bucket", "doc_id", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "part", F.lit(False).alias("asks"))
    )

    def rest(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("doc_id", "ascending"), ("asks", "ascending")])
        asks = cell.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        return pa.table(list(_star(cell.column("doc_id").to_numpy(), linked(_pile(cell, similarity), asks))), names=["a", "b"])

    others = cells.join(blobs, "doc_id").groupBy("bucket", "lot", "part").applyInArrow(rest, "a long, b long")
    return first.where("a is not null").select("a", "b").unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges is connected with."""
    edges = stored(edges, "links")
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "arcs")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), "labels")
        moved = after.where("label < was").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels


def _classed(documents: DataFrame, similarity: float, block: int) -> tuple[DataFrame, bool]:
    """doc_id, class_id, text_id, h1, h2 (hashes of the text) and stays for every row, and whether ids stand on several rows."""
    hashes = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), F.reverse("text")).alias("h2")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = ids.count()
    idf = idf_table(frequent(ids, n), n)
    hashed = stored(ids.select("doc_id", *hashes, (F.col("text").isNull() | F.col("doc_id").isNull()).alias("alone")), "texts")
    same = hashed.where("not alone").groupBy("h1", "h2").agg(F.min("doc_id").alias("text_id"))
    # One of the rows of equal text is signed. All are read, so that no text is shuffled; sets of copies are then left out.
    whole = ids.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    repeats = _repeats(hashed)
    if repeats:  # ids don't tell texts apart: texts are numbered in the order of their ids
        same = stored(same.orderBy("text_id", "h1", "h2").withColumn("text", F.monotonically_increasing_id()), "same")
        signatures = signed(whole.select("doc_id", "text", *hashes), idf, ("h1", "h2")).dropDuplicates(["h1", "h2"])
        signatures = stored(signatures.drop("doc_id").join(same.select("h1", "h2", F.col("text").alias("doc_id")), ["h1", "h2"]).select("doc_id", "bands", "h", "w"), "signatures")
        first = signatures.select("doc_id", "bands")
    else:
        same = stored(same.withColumn("text", F.col("text_id")), "same")
        signatures = stored(signed(whole, idf), "signatures")
        first = signatures.select("doc_id", "bands").join(same.select(F.col("text_id").alias("doc_id")), "doc_id", "left_semi")
    label = components(links(first, signatures, similarity, block)).withColumnRenamed("node", "text")
    if repeats:
        label = label.join(same.select(F.col("text").alias("label"), F.col("text_id").alias("class_id")), "label")
    else:
        label = label.withColumn("class_id", F.col("label"))
    # Rows without text are no key of the join, however many they are; AQE splits the one of a large group of copies.
    named = hashed.where("not alone").join(same, ["h1", "h2"], "left").join(label, "text", "left")
    named = named.unionByName(hashed.where("alone"), allowMissingColumns=True)
    mine = F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("text_id"))
    stays = F.col("alone") | (F.col("doc_id") == F.col("text_id")) & (F.coalesce("label", "text") == F.col("text"))
    return named.select("doc_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.coalesce("class_id", "text_id")).alias("class_id"), mine.alias("text_id"), "h1", "h2", stays.alias("stays")), repeats


def classes(documents: DataFrame, similarity: float = SIMILARITY, block: int = BUCKET_BLOCK) -> DataFrame:
    """doc_id, class_id, text_id for every row; text_id stands for the rows of equal text."""
    return _classed(documents, similarity, block)[0].select("doc_id", "class_id", "text_id")


def _repeats(hashed: DataFrame) -> bool:
    return hashed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def deduplicated(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class stays, the one whose doc_id is smallest; rows without id stay. All columns stay."""
    found, repeats = _classed(documents.select("doc_id", "text"), similarity, BUCKET_BLOCK)
    found = stored(found.where("doc_id is not null"), "classes")
    gone = found.where("not stays").select(F.col("doc_id").alias("gone_id"), *(["h1", "h2"] if repeats else [])).distinct()
    if gone.count() <= BROADCAST_IDS:  # else a join by shuffle
        gone = F.broadcast(gone)
    if not repeats:
        return documents.join(gone, documents["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    # Rows of one id and text are one document; another text of that id is another.
    rows = documents.withColumn("_h1", F.xxhash64("text")).withColumn("_h2", F.xxhash64(F.lit(17), F.reverse("text")))
    out = rows.join(gone, (rows["doc_id"].cast("long") == gone["gone_id"]) & (rows["_h1"] == gone["h1"]) & (rows["_h2"] == gone["h2"]), "left_anti")
    out = out.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "_h1", "_h2"]).unionByName(out.where(F.col("doc_id").isNull()))
    return out.select(*documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(tuned(spark), sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates stays."""
    tuned(spark)
    return deduplicated(docs)
