"""Deterministic splits, samples, held-out sets and leakage audits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.operators.text_search import top
from siltstone.sources.shared import stored


def bucket(c: Column, buckets: int = 100) -> Column:
    """The first 8 hex digits of the id's SHA-1, modulo `buckets`."""
    return F.pmod(F.conv(F.substring(F.sha1(c.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_split(c: Column) -> Column:
    """train, dev or test at 80, 10 and 10 per cent."""
    b = bucket(c)
    return F.when(b < 80, "train").when(b < 90, "dev").otherwise("test")


def order_key(c: Column, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), c.cast("string")), 256)


def fraction_split(df: DataFrame, id_col: str, fraction: float, seed: str) -> DataFrame:
    """dev for the first `fraction` of the ids in hash order (half to even; one row of each kind at least), else test.

    The cut is found as an order statistic of the hash, not by sorting in one task."""
    n = df.count()
    k = max(1, min(n - 1, round(n * fraction))) if n > 1 else n
    keyed = df.withColumn("_h", order_key(F.col(id_col), seed))
    last = keyed.select("_h", id_col).orderBy("_h", id_col).limit(k).agg(F.max("_h")).first()[0] if n else None
    return keyed.withColumn("split", F.when(F.col("_h") <= F.lit(last), "dev").otherwise("test")).drop("_h")


def stratified_sample(df: DataFrame, id_col: str, stratum: str, per: int, seed: str) -> DataFrame:
    """The first `per` of each stratum in hash order."""
    return top(df.withColumn("_h", order_key(F.col(id_col), seed)), stratum, ["_h", id_col], per).drop("_h")


def stratum(n_labels: Column, n_papers: Column) -> Column:
    """multi, sparse or dense by the numbers of labels and papers."""
    return F.when(n_labels >= 2, "multi").when(n_papers <= 1, "sparse").otherwise("dense")


def eligible(pairs: DataFrame, item: str, label: str, low: int, high: int) -> DataFrame:
    """(item, label) pairs whose label is on `low` to `high` different items."""
    df = pairs.groupBy(label).agg(F.count_distinct(item).alias("df")).where(F.col("df").between(low, high))
    return pairs.select(item, label).distinct().join(df.select(label), label, "left_semi")


def held_out(pairs: DataFrame, item: str, label: str, target: int, low: int, high: int, seed: str, rounds: int = 8) -> DataFrame:
    """Up to `target` items, such that no eligible label loses all its items.

    In each round an item is taken if it comes first in hash order for all its labels among the items left, and each of these
    labels has a further item left. Rounds go on until there are enough, none is found, or `rounds` are over; earlier rounds
    come first, then the hash. A round is one pass over the pairs that are left, which are stored."""
    left = stored(eligible(pairs, item, label, low, high).withColumn("_h", order_key(F.col(item), seed)), "eligible")
    taken, n = None, 0
    for k in range(rounds):
        spread = left.groupBy(label).agg(F.count(F.lit(1)).alias("_left"))
        first = left.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy("_h", item))).join(spread, label)
        good = first.groupBy(item, "_h").agg(F.max("_n").alias("worst"), F.min("_left").alias("least")).where("worst = 1 AND least > 1")
        chosen = stored(good.select(item, "_h", F.lit(k).alias("_round")), "chosen")
        found = chosen.count()
        taken, n = chosen if taken is None else taken.unionByName(chosen), n + found
        if not found or n >= target or k == rounds - 1:
            break
        left = stored(left.join(chosen.select(item), item, "left_anti"), "eligible")
    return taken.orderBy("_round", "_h", item).limit(target).select(item)


def ground_truth(pairs: DataFrame, held: DataFrame, item: str, label: str) -> DataFrame:
    """(held item, label, n_relevant): labels of held-out items with their number of items that stay in the index."""
    stay = pairs.select(item, label).distinct().join(held, item, "left_anti").groupBy(label).agg(F.count(F.lit(1)).alias("n_relevant"))
    return pairs.select(item, label).distinct().join(held, item, "left_semi").join(stay, label)


#: Characters of the queries in one automaton, which takes some 100 bytes for each.
AUTOMATON_CHARS = 2_000_000


def _patterns(queries: DataFrame, most: int = AUTOMATON_CHARS) -> Iterator[dict[str, list]]:
    """Different query texts with their ids, in blocks of bounded size. Empty and NULL texts are left out."""
    held, n = {}, 0
    for r in queries.where(F.length("query") > 0).select("query_id", "query").toLocalIterator():
        if held and n + len(r["query"]) > most:
            yield held
            held, n = {}, 0
        held.setdefault(r["query"], []).append(r["query_id"])
        n += len(r["query"])
    if held:
        yield held


def containment(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, id): texts that hold a whole query text. One pass over the texts with an automaton of all queries, built in
    each worker; queries beyond AUTOMATON_CHARS take further passes. Nothing is shuffled."""
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    out, schema = None, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {texts.schema['id'].dataType.simpleString()}"
    for block in _patterns(queries):
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for pattern in shared.value:
                automaton.add_word(pattern, pattern)
            automaton.make_automaton()
            for batch in batches:
                ids, found = batch.column(0), [({p for _, p in automaton.iter(t)} if t else ()) for t in batch.column(1).to_pylist()]
                rows = [(q, i) for i, patterns in enumerate(found) for p in sorted(patterns) for q in shared.value[p]]
                if rows:
                    q, i = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(q, kind), ids.take(pa.array(i))], ["query_id", "id"])

        part = texts.select("id", "text").mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def leakage(index: DataFrame, held: DataFrame, item: str, text: str) -> DataFrame:
    """One row: shared ids, shared whole texts and a verdict, GO or STOP."""
    h = held.select(F.col(item).alias("h_item"), F.sha2(F.col(text), 256).alias("h_text"))
    ids = index.join(h.select(F.col("h_item").alias(item)).distinct(), item, "left_semi").agg(F.count(F.lit(1)).alias("shared_ids"))
    same = index.withColumn("h_text", F.sha2(F.col(text), 256)).join(h.select("h_text").distinct(), "h_text", "left_semi").agg(F.count(F.lit(1)).alias("shared_texts"))
    return ids.crossJoin(same).withColumn("verdict", F.when((F.col("shared_ids") == 0) & (F.col("shared_texts") == 0), "GO").otherwise("STOP"))


def controlled_subset(df: DataFrame, positives: DataFrame, id_col: str, size: int, seed: str) -> DataFrame:
    """All positives and, in hash order, others up to `size` rows."""
    keep = df.join(positives, id_col, "left_semi")
    rest = df.join(positives, id_col, "left_anti")
    n = keep.count()
    return keep.unionByName(rest.withColumn("_h", order_key(F.col(id_col), seed)).orderBy("_h", id_col).limit(max(0, size - n)).drop("_h"))


def copies_held_out(df: DataFrame, id_col: str, group: str, least: int, per_group: int, seed: str) -> DataFrame:
    """Per group of `least` rows or more the first `per_group` in hash order, at least one row staying in the index."""
    sized = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group))).where(F.col("_n") >= max(least, per_group + 1))
    return top(sized.withColumn("_h", order_key(F.col(id_col), seed)), group, ["_h", id_col], per_group).drop("_h", "_n", "rank")


def cluster_held_out(membership: DataFrame, labels: DataFrame, target: int, seed: str) -> DataFrame:
    """(cluster) whole clusters in hash order, such that no label loses all its clusters: a cluster is taken if each of its
    labels has a further cluster, and it comes first in hash order for all of them."""
    rows = membership.join(labels, "node").select("cluster", "label").distinct().withColumn("_h", order_key(F.col("cluster"), seed))
    order = Window.partitionBy("label").orderBy("_h", "cluster")
    spread = rows.groupBy("label").agg(F.count(F.lit(1)).alias("clusters"))
    first = rows.withColumn("_n", F.row_number().over(order)).join(spread, "label")
    good = first.groupBy("cluster", "_h").agg(F.max("_n").alias("worst"), F.min("clusters").alias("least")).where("worst = 1 AND least > 1")
    return good.orderBy("_h", "cluster").limit(target).select("cluster")


def gc_bin(c: Column, bins: int) -> Column:
    """The bin, from 0, of a sequence's share of G and C."""
    gc = F.length(F.regexp_replace(c, "[^GC]", ""))
    return F.floor(bins * gc / F.greatest(F.length(c), F.lit(1))).cast("int")


def hard_negatives(df: DataFrame, id_col: str, group: str, bin_col: str, grams_of: Column, per: int = 1) -> DataFrame:
    """(id, negative, jaccard): rows of another group in the same bin that share most k-mers, by an inverted k-mer join."""
    grams = df.select(F.col(id_col), F.col(group), F.col(bin_col), F.array_distinct(grams_of).alias("k")).withColumn("n", F.size("k"))
    x = grams.select(id_col, group, bin_col, "n", F.explode("k").alias("g"))
    y = x.select(F.col(id_col).alias("negative"), F.col(group).alias("g2"), bin_col, F.col("n").alias("n2"), "g")
    pairs = x.join(y, [bin_col, "g"]).where(F.col(group) != F.col("g2")).groupBy(id_col, "negative").agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n"), F.first("n2").alias("n2"))
    scored = pairs.withColumn("jaccard", F.round(F.col("both") / (F.col("n") + F.col("n2") - F.col("both")), 6))
    return top(scored, id_col, [F.desc("jaccard"), "negative"], per).select(id_col, "negative", "jaccard")
