"""Registered queries: each operator on its whole table, with the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import itq, merges, packing, phrases, quality, secret_scan, sharding, simhash, slots, suffixes, vbyte, warc, zfast
from wardlight.llm.common import read
from wardlight.llm.tokens import public_tokenizer
from wardlight.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(read(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, by_rank = vbyte.write_tokens(read(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=0)
    return vbyte.read_tokens(manifest, by_rank).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.count_tokens(read(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, carry=["doc_id"])
    return scored.select("row.doc_id", quality.held_out("row.doc_id").alias("held_out"), "score",
                         F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secret_scan.Words(secret_scan.vocabulary_words(public_tokenizer("word_bpe_49k.json")))
    found = secret_scan.scan(read(spark, sf_dir, "documents"), secret_scan.train(spark, words), carry=["doc_id", "source"], path_col="source")
    found = found.select("row.doc_id", F.explode("findings").alias("f"))
    return found.select("doc_id", F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.sha2("f.value", 256).alias("value_sha256"),
                        "f.probability", (F.col("f.probability") >= secret_scan.THRESHOLD).alias("is_secret"))


@query("op6_warc", """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, ''))
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, ''))
    THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    found = materialise(warc.look_up(spark, archive.directory, warc.keys_of(pages)), "found")
    return warc.read_records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_embedding_near_dedup", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (
  SELECT vec_id, label, x FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND list_sum(list_transform(x, lambda e: e * e)) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (
  WITH RECURSIVE r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
  SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(reach.b, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(reach.b, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN reach ON reach.a = v.vec_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itq.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


@query("op13_substring_dedup", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, r, unnest(range(1, len(ws) - 48)) AS s, ws FROM d WHERE len(ws) >= 50),
k AS (SELECT doc_id, r, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM w),
gone AS (SELECT r, s FROM (SELECT r, s, doc_id > min(doc_id) OVER (PARTITION BY h) AS again FROM k) WHERE again),
p AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM d),
c AS (SELECT p.r, p.place, p.word, max(gone.s) OVER (PARTITION BY p.r ORDER BY p.place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS removed
  FROM p LEFT JOIN gone ON gone.r = p.r AND gone.s = p.place),
t AS (SELECT r, count(*) FILTER (WHERE removed) AS n, string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT removed) AS kept FROM c GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(t.n, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.r = d.r
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = phrases.remove_repeats(read(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_TURN = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"


@query("op12_conversation_prefix_trie", rf"""
WITH o AS (SELECT conv_id, {_TURN} AS sym, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS place FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END)), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (
  SELECT i.conv_id, 0 AS part, o.place, sym, words FROM i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 20 AND o.place <= i.h
  UNION ALL SELECT i.conv_id, 1, o.place, sym, words FROM i JOIN o ON o.conv_id = i.conv_id AND o.place > i.h),
s AS (SELECT conv_id, row_number() OVER w AS d, words, md5(string_agg(sym, '') OVER w) AS k FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT conv_id, d, words, k FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM i),
u AS (SELECT conv_id, d, words, k, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up, lead(k) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM m),
n AS (SELECT k, any_value(d) AS d, any_value(words) AS words, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ending FROM u GROUP BY k),
c AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.k, b.k AS other FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
g AS (SELECT below.k, count(*) FILTER (WHERE c.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM below JOIN n ON n.k = below.other LEFT JOIN c ON c.k = below.other GROUP BY below.k)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, g.n_leaves,
  g.saved_tokens::BIGINT AS saved_tokens, sha256(n.ending) AS ends_sha256
FROM n JOIN g ON g.k = n.k LEFT JOIN c ON c.k = n.k LEFT JOIN n p ON p.k = n.up
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = zfast.with_shared_openings(zfast.conversations(read(spark, sf_dir, "conversations")))
    convs = materialise(zfast.with_prefixes(convs), "conversations")
    trie = zfast.prefix_trie(convs).join(zfast.end_digests(convs), "h", "left")
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                       F.coalesce("digest", F.lit(zfast.NO_ENDS)).alias("ends_sha256"))


@query("op11_hard_negative_mining", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return slots.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), anchors="vec_id % 100 = 0")
