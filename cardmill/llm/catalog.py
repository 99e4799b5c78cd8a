"""The operators as registered queries, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm import bisectors, bpeautomaton, decontaminate, k2treap, langid, licenses, metricjoin, neardup, packing, secrets, tokenfile, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), path)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf_dir, "documents"))
    found = found.select("doc_id", F.concat("matches", "runs").alias("matches"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.split_part(m["template"], F.lit("/"), F.lit(1)))))
    spans = F.transform(
        "matches",
        lambda m: F.concat_ws(":", m["template"], m["unit"], m["start"], m["end"], F.round(m["dice"], 6).cast("string")),
    )
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(spans, ",").alias("matches"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(found).alias("held_out"), "lang_pred", "score")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in secrets.BASE_KINDS),
        F.sha2(secrets.span_list(F.col("spans"), secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = bisectors.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None).cast("string")
    for c, centroid in enumerate(centroids):
        text = hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
        digest = F.when(F.col("cluster") == c, F.lit(text)).otherwise(digest)

    def whole(name: str):  # null beyond 64 bits
        return F.expr(f"try_cast({name} AS long)").alias(name)

    return found.select(
        "vec_id", "cluster", whole("distance"), whole("cluster_inertia"), whole("inertia"), digest.alias("centroid_sha256")
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k2treap.search(k2treap.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpeautomaton.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op5_licenses": op5_licenses,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_token_files": op9_token_files,
    "op2_toxicity": op2_toxicity,
    "op3_near_vectors": op3_near_vectors,
    "op4_decontaminate": op4_decontaminate,
    "op10_secrets": op10_secrets,
    "op11_clusters": op11_clusters,
    "op12_ranked_search": op12_ranked_search,
    "op13_bpe": op13_bpe,
}

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
 FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Base32 digit by digit from the bits of the hex digest.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(('0x' || hex[i])::INTEGER), 4)), '') AS b FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
 16 * b[5 * i + 1]::INTEGER + 8 * b[5 * i + 2]::INTEGER + 4 * b[5 * i + 3]::INTEGER + 2 * b[5 * i + 4]::INTEGER + b[5 * i + 5]::INTEGER, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, true AS verified
FROM bits
"""

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""



def _nearest_sql(step: int, vectors: str = "v") -> str:
    """Cluster and distance of every vector under the centroids of a step."""
    return f"""a{step} AS MATERIALIZED (SELECT r, vec_id, e, arg_min(k, d * 64 + k) AS cluster, min(d) AS distance FROM (
 SELECT r, vec_id, v.e AS e, k, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::HUGEINT AS d
 FROM {vectors} v, c{step} c) GROUP BY 1, 2, 3)"""


def _moved_sql(step: int) -> str:
    """The centroids after a step: floor of the mean, by component; those without vectors stay."""
    return f"""c{step + 1} AS MATERIALIZED (SELECT k, coalesce(m.e, c.e) AS e FROM c{step} c LEFT JOIN (
 SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (
  SELECT cluster, i, sum(e[i])::HUGEINT AS s, count(*) AS n FROM a{step}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)
 GROUP BY 1) m ON m.cluster = c.k)"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::HUGEINT) AS e FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS k, e FROM (
 SELECT e, sha256('1:' || vec_id) AS h FROM v) ORDER BY h NULLS LAST, e LIMIT 16),
{_nearest_sql(0)}, {_moved_sql(0)}, {_nearest_sql(1)}, {_moved_sql(1)}, {_nearest_sql(2)}, {_moved_sql(2)}, {_nearest_sql(3)}
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
 sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
 sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.k = a3.cluster
"""

OP12_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nt FROM t WHERE len(w) > 0),
q AS MATERIALIZED (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (
 SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark)),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t)
 WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
f AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
 FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
h AS (SELECT i, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // nt)))))::BIGINT AS score
 FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2, 3, 4),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM h WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""

ORACLES = {
    "op12_ranked_search": OP12_SQL,
    "op11_clusters": OP11_SQL,
    "op3_near_vectors": OP3_SQL,
    "op7_warc": OP7_SQL,
    "op4_decontaminate": OP4_SQL,
}
