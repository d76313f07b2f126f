"""Queries over whole tables for the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, clusters, decontam, exact_dedup, line_dedup, lm, near_dedup, packing, pii, quality, sentencepiece_fst, toxicity, warc
from .store import documents as table


def tokenizer_file() -> str:
    """The tokenizer file that op12 is registered with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The key of these queries only, so that their results can be compared; whoever publishes texts keeps a key secret.
PII_KEY = "key of the registered query"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir), size=2)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(table(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir), PII_KEY)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir), tokenizer_file())


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clusters.ball_kmeans(table(spark, sf_dir, "embeddings"))
    return clusters.inertia(assigned, centroids)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_near_dedup, op3_decontamination, op4_lm_scores, op5_quality, op6_sentencepiece, op7_toxicity, op8_warc, op9_pii, op10_line_dedup,
        op11_filter_audit, op12_packing, op13_ball_kmeans,
    )
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _kmeans_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    """The rounds of k-means, each as an assignment of all vectors to all centroids and the floors of means."""
    finite = f"len(embedding) = {size} AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND {finite}),
        parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept),
        c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k}))"""
    ]
    for t in range(rounds + 1):
        steps.append(f"""d{t} AS MATERIALIZED (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM parts JOIN c{t} USING (j) GROUP BY r, c),
        a{t} AS MATERIALIZED (SELECT r, min_by(c, d * {k} + c) AS c, min(d) AS d FROM d{t} GROUP BY r)""")
        if t < rounds:
            steps.append(f"""m{t} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM parts JOIN a{t} USING (r) GROUP BY c, j),
        c{t + 1} AS MATERIALIZED (SELECT c{t}.c, c{t}.j, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{t} LEFT JOIN m{t} ON c{t}.c = m{t}.c AND c{t}.j = m{t}.j)""")
    return f"""WITH {", ".join(steps)},
        told AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} a JOIN kept USING (r) JOIN told ON a.c = told.c"""


ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), best AS (
            SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
            FROM rows
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
    """,
    "op8_warc": """
        WITH rows AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), told AS (
            SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, n) ELSE page_id END AS answer FROM rows
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN answer = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN answer <> page_id THEN answer END AS refers_to
        FROM told
    """,
    "op10_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents
        ), keyed AS (
            SELECT doc_id, i, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), shared AS (
            SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), told AS (
            SELECT k.doc_id, k.i, k.line, s.key IS NOT NULL AND s.first_id <> k.doc_id AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM told GROUP BY doc_id
    """,
    "op11_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), marks AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), tested AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                   coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false) AS e
            FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
            WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x
        ), docs AS (
            SELECT part, good, toxic, a, b, c, d, e, count(*) AS n, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS fails FROM tested GROUP BY ALL
        ), stepped AS (
            SELECT *, substr(filter_order, CAST(step AS BIGINT), 1) AS letter, least(CASE WHEN a THEN instr(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN instr(filter_order, 'B') ELSE 6 END,
                   CASE WHEN c THEN instr(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN instr(filter_order, 'D') ELSE 6 END, CASE WHEN e THEN instr(filter_order, 'E') ELSE 6 END) AS gone_at
            FROM docs, orders, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS step)
        ), told AS (
            SELECT *, CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails_it FROM stepped
        ), counted AS (
            SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE gone_at > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE gone_at = step), 0) AS removed,
                   coalesce(sum(n) FILTER (WHERE fails_it AND gone_at < step), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails_it AND fails = 1), 0) AS unique_fails,
                   coalesce(sum(n) FILTER (WHERE gone_at = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE gone_at = step AND toxic), 0) AS toxic_lost
            FROM told GROUP BY part, filter_order, step, letter
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM counted
    """,
    "op13_ball_kmeans": _kmeans_sql(),
}
