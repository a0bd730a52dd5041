"""The registered queries of the ten operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fingerprints, mixing, near_dup, nearest, packing, quality, suffix_dedup, token_counts, url_filter, warc
from .common import keep, new_folder, table


def op1_mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.label_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (n - k)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50, digest=True)


OP3_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, i, b[i : i + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
h AS (SELECT g.doc_id, i FROM g JOIN f USING (s) WHERE first_id < g.doc_id),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
c AS (SELECT doc_id, min(i) AS first, max(i) + 50 AS past FROM r GROUP BY doc_id, run),
e AS (SELECT doc_id, first, past FROM c UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) + 1 FROM d),
k AS (SELECT doc_id, first, past, coalesce(lag(past) OVER (PARTITION BY doc_id ORDER BY first, past), 1) AS since FROM e)
SELECT d.doc_id, octet_length(any_value(b))::BIGINT AS n_bytes, sum(past - first)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
  sha256(unhex(string_agg(CASE WHEN first > since THEN hex(b[since : first - 1]) ELSE '' END, '' ORDER BY first, past))) AS kept_sha256
FROM d JOIN k USING (doc_id) GROUP BY d.doc_id
"""


def op4_token_counts(spark, sf_dir, limit: int = 4096):
    n = token_counts.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return n.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_warc(spark, sf_dir):
    folder = new_folder(spark, "warc")
    manifest = keep(warc.write_archives(warc.judged(table(spark, sf_dir, "pages")), folder), "manifest")
    c = warc.assemble(warc.read_records(warc.open_archives(manifest, folder), payloads=False))
    return c.select("page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("response.refers_to_page").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", window=2048, end=1)


def op7_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir, threshold: float = 0.3):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def op9_nearest(spark, sf_dir):
    return nearest.search(table(spark, sf_dir, "embeddings"), every=20, k=20).drop("query_row")


def op10_fingerprints(spark, sf_dir):
    f = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    like, fp = fingerprints.likeness, F.col("fp")
    return f.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_hex(fp).alias("fingerprint"), fingerprints.as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        like(fp, F.col("edited_fp")).alias("near_edited"), like(fp, F.col("next_fp")).alias("near_next"),
    )


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_near_dup, op3_suffix_dedup, op4_token_counts, op5_warc, op6_packing, op7_url_filter, op8_quality, op9_nearest, op10_fingerprints)}
SQL = {"op1_mix_sources": mixing.SQL, "op5_warc": OP5_SQL, "op2_near_dup": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op7_url_filter": url_filter.sql(), "op9_nearest": nearest.SQL}
