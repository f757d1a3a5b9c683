"""The queries that apply each operator to its whole table, with production parameters, and what SQL says of them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, licenses, line_dedup, periodic, prefix_trie, sharding, simhash, topk, toxicity, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_read(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.col("rejected").alias("toxic"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_read(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle(docs)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


#: The rules that op10 applies (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))
    judged = url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text that op11 reads: of every tenth document, by the CRC of its id, the words from one place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("words"))
    n = F.size("words")
    placed = words.select("doc_id", "text", "words", n.alias("n"), F.when(n > 0, F.col("g") % n).cast("int").alias("a"), (3 + F.col("g") % 8).cast("int").alias("parts"))
    placed = placed.withColumn("p", F.floor((F.col("n") - F.col("a")) / F.col("parts")).cast("int") + 1)
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.flatten(F.array_repeat(block, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    repeated = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_repeats(_read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), docs.where(~held_out))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.collect_turns(_read(spark, sf_dir, "conversations"))
    # each conversation begins with the first h turns of the one whose id is the next lower multiple of five
    base, h = F.col("conv_id") - F.pmod("conv_id", F.lit(5)), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8)), ignorenulls=True).over(Window.partitionBy("base"))
    both = turns.withColumn("base", base).withColumn("head", head).withColumn("h", h.cast("int"))
    none = F.slice("turns", F.lit(1), F.lit(0))
    rebuilt = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return prefix_trie.trie(both.select("conv_id", rebuilt.alias("turns")))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_decontamination, op4_toxicity, op5_topk, op6_simhash, op7_sharding, op8_line_dedup, op9_licenses, op10_url_filter, op11_periodic, op12_langid, op13_prefix_trie)}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(p.h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - i % 4 * 5 AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN g USING (h)""",
    "op3_decontamination": f"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, k, dw.m, item_id FROM dw JOIN win USING (m, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(k, k + m - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_topk": """
WITH e AS (SELECT row_number() OVER () AS r, * FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS (SELECT r, vec_id, unnest(generate_series(1, len(embedding))) AS k, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM e),
s AS (SELECT q.r, q.vec_id AS query_id, c.r AS c, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.k = c.k AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op8_line_dedup": f"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM d),
y AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM l),
bad AS (SELECT key, max(doc_id) AS keeper FROM y WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM y LEFT JOIN bad USING (key) GROUP BY r, doc_id""",
    "op10_url_filter": f"""
WITH r(rhost, rpath, ruled) AS (VALUES {', '.join(str(x) for x in RULES)}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_LOWER}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, coalesce(arg_max(ruled, length(rhost || rpath)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL""",
    # crc32 bit by bit: 3988292384 is its polynomial
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, generate_series(0, 8 * len(CAST(conv_id AS VARCHAR)) - 1)),
  lambda a, i: xor(xor(a, CASE WHEN i % 8 = 0 THEN ord(substr(CAST(conv_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END) >> 1, 3988292384 * (xor(a, CASE WHEN i % 8 = 0 THEN ord(substr(CAST(conv_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END) & 1))), 4294967295) % 9 AS h FROM t),
r AS (SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL SELECT c.conv_id, t.k + 1000, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, sha256(strlen(role) || ':' || role || text) AS x, strlen(text) AS b FROM r),
p AS (SELECT conv_id, d, b, string_agg(x, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS node, string_agg(x, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM s
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
m AS (SELECT *, CASE WHEN d > 0 THEN coalesce(up, '') END AS parent, max(d) OVER (PARTITION BY conv_id) AS most FROM p),
n AS (SELECT node, parent, d, min(conv_id) AS conv_id, count(*) AS n, max(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = most), '')) AS ends FROM m GROUP BY node, parent, d),
k AS (SELECT parent AS node, count(*) AS children FROM n WHERE parent IS NOT NULL GROUP BY parent),
f AS (SELECT node, d, (n - 1) * b AS saved, CASE WHEN children IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN k USING (node)),
below AS (SELECT a.node, sum(f.leaf) AS leaves, sum(f.saved) AS saved FROM n a JOIN f ON starts_with(f.node, a.node) GROUP BY a.node)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.children, 0) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n u ON u.node = n.parent LEFT JOIN k ON k.node = n.node JOIN below ON below.node = n.node""",
}
