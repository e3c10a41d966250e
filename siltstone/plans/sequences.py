"""Sequence, text function and record queries. Sequences are the letters of the documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import sequence as seq
from siltstone.functions import text as tx
from siltstone.operators import alignment, corpus, splits, text_search
from siltstone.plans.catalog import query

_SEQ = "regexp_replace(upper(replace({}, 'ß', 'SS')), '[^\\p{{L}}*]', '', 'g')"


@query(f"SELECT doc_id, length({_SEQ.format('text')}) AS n, left({_SEQ.format('text')}, 40) AS head FROM documents")
def clean_sequences(t):
    s = seq.clean(F.col("text"))
    return t.documents.select("doc_id", F.length(s).cast("long").alias("n"), F.substring(s, 1, 40).alias("head"))


@query("""WITH x AS (SELECT doc_id, trim(text) AS raw FROM (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + p_partkey, translate(upper(p_name), ' #_0123456789', 'ACGTACGTACGTA') FROM part)),
 s AS (SELECT doc_id, raw, regexp_replace(upper(raw), '[^\\p{L}*]', '', 'g') AS s, len(list_filter(regexp_split_to_array(raw, '\\s+'), lambda w: w <> '')) AS n,
   list_max(list_transform(list_filter(regexp_split_to_array(raw, '\\s+'), lambda w: w <> ''), lambda w: length(w))) AS m FROM x),
 k AS (SELECT doc_id, CASE WHEN NOT (regexp_full_match(raw, '[A-Za-z*\\s]+') AND (n <= 1 OR m >= 12)) OR length(s) < 8 THEN NULL
   WHEN regexp_full_match(s, '[ACGTNRYKMSWBDHV]+') THEN 'dna' WHEN regexp_full_match(s, '[ACGUNRYKMSWBDHV]+') THEN 'rna'
   WHEN regexp_full_match(s, '[ABCDEFGHIKLMNPQRSTVWXYZ*]+') THEN CASE WHEN length(s) >= 25 THEN 'protein' ELSE 'peptide_fragment' END END AS kind FROM s)
SELECT doc_id, kind FROM k""")
def sequence_detect(t):
    """Kinds of the documents' texts and of sequences spelled from the part names."""
    made = t.part.select((F.lit(1000000000) + F.col("p_partkey")).alias("doc_id"), F.translate(F.upper("p_name"), " #_0123456789", "ACGTACGTACGTA").alias("text"))
    rows = t.documents.select("doc_id", "text").unionByName(made)
    return rows.select("doc_id", seq.detected(F.col("text")).alias("kind"))


@query(f"""WITH s AS (SELECT item_id, {_SEQ.format("text")} AS s FROM benchmark), n AS (SELECT item_id, s, length(s) AS n FROM s),
 w AS (SELECT item_id, s, n, unnest(CASE WHEN n <= 0 THEN []::BIGINT[] WHEN n <= 128 THEN [0::BIGINT] ELSE list_concat(list_filter(range(0, n, 64), lambda x: x + 128 < n), [n - 128]) END) AS start FROM n)
SELECT DISTINCT item_id, CAST(start AS INTEGER) AS start, CAST(least(start + 128, n) AS INTEGER) AS "end", substr(s, CAST(start AS BIGINT) + 1, 128) AS text FROM w""")
def sequence_windows(t):
    w = t.benchmark.select("item_id", F.explode(seq.windows(seq.clean(F.col("text")), 128, 64)).alias("w"))
    return w.select("item_id", "w.start", "w.end", "w.text")


@query(f"""WITH s AS (SELECT vec AS doc_id, s, length(s) AS n FROM (SELECT doc_id AS vec, {_SEQ.format("text")} AS s FROM documents)),
 w AS (SELECT doc_id, n, unnest(CASE WHEN n <= 0 THEN []::BIGINT[] WHEN n <= 128 THEN [0::BIGINT] ELSE list_concat(list_filter(range(0, n, 64), lambda x: x + 128 < n), [n - 128]) END) AS start FROM s)
SELECT doc_id AS parent, count(DISTINCT start) AS windows, CAST(max(least(start + 128, n)) AS INTEGER) AS last_end FROM w WHERE least(start + 128, n) - start >= 24 GROUP BY doc_id""")
def window_records(t):
    w = corpus.window_records(t.documents, "doc_id", F.col("text"), "dna_window")
    return w.groupBy("parent").agg(F.count(F.lit(1)).alias("windows"), F.max("end").alias("last_end"))


@query("""SELECT p_partkey, translate(reverse(s), 'ACGTNacgtn', 'TGCANtgcan') AS rc, translate(reverse(translate(reverse(s), 'ACGTNacgtn', 'TGCANtgcan')), 'ACGTNacgtn', 'TGCANtgcan') = s AS involution
 FROM (SELECT p_partkey, translate(upper(p_name), 'PART#_ 0123456789', 'ACGTNACGTACGTACGT') AS s FROM part)""")
def reverse_complement(t):
    s = F.translate(F.upper("p_name"), "PART#_ 0123456789", "ACGTNACGTACGTACGT")
    rc = seq.reverse_complement(s)
    return t.part.select("p_partkey", rc.alias("rc"), (seq.reverse_complement(rc) == s).alias("involution"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 117)) || '...' END AS snippet FROM t""")
def compact_text(t):
    return t.documents.select("doc_id", tx.compact(F.col("text"), 120).alias("snippet"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
 array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') AS links FROM pages""")
def header_kv_extract(t):
    """Scheme, host, title and links by patterns, as headers are read."""
    return t.pages.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))), " ").alias("links"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN trim(event_type) IN ('', '-') THEN NULL ELSE trim(event_type) END AS event_type FROM events""")
def json_fields(t):
    return t.events.select("event_id", tx.json_field(F.col("props"), "$.k").cast("long").alias("k"), tx.missing(F.col("event_type")).alias("event_type"))


@query("""SELECT doc_id, sha256(text) AS content_hash, 'doc:' || substr(sha1('doc' || chr(0) || text), 1, 16) AS token_id,
 substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
 FROM (SELECT doc_id, text, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)""")
def stable_ids(t):
    return t.documents.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.token_id("doc", F.col("text")).alias("token_id"), tx.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.col("doc_id").cast("string")).alias("uuid"))


@query(f"""WITH q AS (SELECT item_id, {_SEQ.format("text")} AS s FROM benchmark), d AS (SELECT doc_id, {_SEQ.format("text")} AS s FROM documents),
 qk AS (SELECT DISTINCT item_id, substr(s, i, 8) AS g FROM q, range(1, greatest(CAST(length(s) - 6 AS BIGINT), 1)) AS r(i) WHERE length(s) >= 8),
 dk AS (SELECT DISTINCT doc_id, substr(s, i, 8) AS g FROM d, range(1, greatest(CAST(length(s) - 6 AS BIGINT), 1)) AS r(i) WHERE length(s) >= 8),
 nq AS (SELECT item_id, count(*) AS nq FROM qk GROUP BY 1), nd AS (SELECT doc_id, count(*) AS nd FROM dk GROUP BY 1),
 j AS (SELECT item_id, doc_id, count(*) AS nb FROM qk JOIN dk USING (g) GROUP BY 1, 2),
 s AS (SELECT item_id, doc_id, round(nb / (nq + nd - nb), 6) AS score FROM j JOIN nq USING (item_id) JOIN nd USING (doc_id))
SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def kmer_jaccard_topk(t):
    """Documents by the Jaccard similarity of different 8-mers."""
    text = seq.clean(F.col("text"))
    return text_search.kmer_jaccard(t.documents, "doc_id", text, t.benchmark, "item_id", text, 8, 5)


@query("""SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS b FROM documents)""")
def hash_split_80_10_10(t):
    return t.documents.select("doc_id", splits.hash_split(F.col("doc_id")).alias("split"))


@query("""SELECT item_id, CASE WHEN row_number() OVER (ORDER BY sha256('s1:' || item_id), item_id) <= greatest(1, least(n - 1, round_even(n * 0.3, 0))) THEN 'dev' ELSE 'test' END AS split FROM benchmark, (SELECT count(*) AS n FROM benchmark)""")
def dev_test_split(t):
    return splits.fraction_split(t.benchmark.select("item_id"), "item_id", 0.3, "s1")


@query("""SELECT doc_id, lang, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s2:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 10""")
def stratified_sample(t):
    return splits.stratified_sample(t.documents.select("doc_id", "lang"), "doc_id", "lang", 10, "s2")


@query("""SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0""")
def leakage_containment(t):
    """Documents that hold a whole benchmark text."""
    return splits.containment(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 90 THEN 0 ELSE 1 END AS held, sha256(text) AS h FROM documents)
SELECT 0::BIGINT AS shared_ids, count(*) AS shared_texts, CASE WHEN count(*) = 0 THEN 'GO' ELSE 'STOP' END AS verdict FROM s WHERE held = 0 AND h IN (SELECT h FROM s WHERE held = 1)""")
def leakage_audit(t):
    b = splits.bucket(F.col("doc_id")) < 90
    return splits.leakage(t.documents.where(b).select("doc_id", "text"), t.documents.where(~b).select("doc_id", "text"), "doc_id", "text")


_PAIRS = "SELECT DISTINCT l_partkey AS item, l_suppkey AS label FROM lineitem"


@query(f"""WITH p AS ({_PAIRS}), e AS (SELECT label FROM p GROUP BY label HAVING count(*) BETWEEN 2 AND 100000), r AS (SELECT p.*, sha256('h:' || item) AS h FROM p JOIN e USING (label)),
 f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, item) AS n, count(*) OVER (PARTITION BY label) AS c FROM r), c1 AS (SELECT item, any_value(h) AS h FROM f GROUP BY item HAVING max(n) = 1 AND min(c) > 1),
 f2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, item) AS n, count(*) OVER (PARTITION BY label) AS c FROM r WHERE item NOT IN (SELECT item FROM c1)), c2 AS (SELECT item, any_value(h) AS h FROM f2 GROUP BY item HAVING max(n) = 1 AND min(c) > 1),
 held AS (SELECT item FROM (SELECT *, 1 AS k FROM c1 UNION ALL SELECT *, 2 FROM c2) ORDER BY k, h, item LIMIT 50), stay AS (SELECT label, count(*) AS n_relevant FROM p WHERE item NOT IN (SELECT item FROM held) GROUP BY label)
SELECT p.item, p.label, n_relevant FROM p JOIN held USING (item) JOIN stay USING (label)""")
def heldout_truth(t):
    """Parts held out so that all their suppliers stay reachable, and their ground truth."""
    pairs = t.lineitem.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("label")).distinct()
    held = splits.held_out(pairs, "item", "label", 50, 2, 100000, "h", 2)
    return splits.ground_truth(pairs, held, "item", "label").select("item", "label", "n_relevant")


@query("""SELECT n_nationkey, left(s, 12) AS prefix, right(s, 12) AS suffix, substr(s, greatest((length(s) - 12) // 2, 0) + 1, 12) AS middle FROM (SELECT n_nationkey, upper(n_name) || '_' || n_regionkey || '_' || lower(n_name) AS s FROM nation)""")
def query_fragments(t):
    s = F.concat(F.upper("n_name"), F.lit("_"), F.col("n_regionkey").cast("string"), F.lit("_"), F.lower("n_name"))
    return t.nation.select("n_nationkey", s.alias("s")).select("n_nationkey", *[seq.fragment(F.col("s"), r, 12).alias(r) for r in ("prefix", "suffix", "middle")])


@query("""SELECT p_partkey, '[TYPE=part]' || chr(10) || 'name: ' || p_name || chr(10) || 'brand: ' || p_brand AS text, 'part:' || p_partkey AS entity_id FROM part""")
def typed_records(t):
    return t.part.select("p_partkey", corpus.typed_text(F.lit("part"), {"name": F.col("p_name"), "brand": F.col("p_brand"), "note": F.lit("-")}).alias("text"), corpus.entity_id(F.lit("part"), F.col("p_partkey")).alias("entity_id"))


@query()
def lcs_overlap(t):
    """Overlap of each benchmark text with the documents of its best BM25 rank (no SQL: longest common substrings)."""
    from siltstone.plans.search import _bm25

    best = _bm25(t, 1).select("item_id", "doc_id").join(t.benchmark.select("item_id", seq.clean(F.col("text")).alias("a")), "item_id").join(t.documents.select("doc_id", seq.clean(F.col("text")).alias("b")), "doc_id")
    return best.select("item_id", "doc_id", F.round(alignment.overlap_score("a", "b"), 6).alias("overlap"))


@query()
def smith_waterman_rerank(t):
    """Benchmark texts aligned with their BM25 candidates, best first (no SQL: dynamic programming)."""
    from siltstone.plans.search import _bm25

    pairs = _bm25(t, 3).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("subject_id"))
    q = t.benchmark.select(F.col("item_id").alias("query_id"), seq.clean(F.col("text")).alias("query"))
    s = t.documents.join(pairs.select(F.col("subject_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("subject_id"), seq.clean(F.col("text")).alias("subject"))
    return alignment.search(q, s, limit=3, candidates=pairs)
