"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from heddle.llm.common import crc_mod, table
from heddle.llm.decontaminate import contaminated
from heddle.llm.exact_dedup import exact_dedup
from heddle.llm.langid import held_out_languages
from heddle.llm.near_dedup import near_classes
from heddle.llm.packing import pack
from heddle.llm.quality import score_quality
from heddle.llm.sstable import token_shards
from heddle.llm.toxicity import score_toxicity
from heddle.llm.urls import judge
from heddle.llm.warc import archive_round_trip


def op1_warc_round_trip(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("chunks")


def op7_host_reputation(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).drop("bad_low")


def op8_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return held_out_languages(docs, crc_mod(docs["doc_id"], 4) == 2)


def op4_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_shards(spark, sf_dir):
    return token_shards(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_warc_round_trip, op2_exact_dedup, op3_language_id, op4_best_fit_packing, op5_quality, op6_token_shards, op7_host_reputation, op8_decontamination, op9_minhash_near_dedup, op10_toxicity, pipeline)
}

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op7_host_reputation": r"""
        WITH u AS (
            SELECT page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/' END AS rule FROM u),
        v AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
        h AS (SELECT host, split_part(host, '.', -1) AS suffix,
                CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain,
                count(ruled) AS n, count(*) FILTER (ruled = 'block') AS k FROM v GROUP BY host),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
        s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
        w AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k)::DOUBLE / sum(n) ELSE 0 END AS up FROM s),
        s0 AS (SELECT s.*, up FROM s, w),
        sm AS (SELECT CASE WHEN coalesce(below, 0) <= 0 THEN 10 WHEN above <= 0 THEN 1000 ELSE greatest(0.1, least(1000, (1 - above / below) / (above / below))) END AS m FROM (
            SELECT sum(s - v * (g - 1)) AS above, sum(v * (t - nn / t - (g - 1))) AS below FROM (
                SELECT any_value(up * (1 - up)) AS v, sum(n * (k / n - up) ^ 2) AS s, sum(n * n)::DOUBLE AS nn, sum(n)::DOUBLE AS t, count(*) AS g FROM s0 WHERE n > 0 GROUP BY up))),
        s1 AS (SELECT suffix, (k + m * up) / (n + m) AS up FROM s0, sm),
        d0 AS (SELECT d.*, up FROM d JOIN s1 USING (suffix)),
        dm AS (SELECT CASE WHEN coalesce(below, 0) <= 0 THEN 10 WHEN above <= 0 THEN 1000 ELSE greatest(0.1, least(1000, (1 - above / below) / (above / below))) END AS m FROM (
            SELECT sum(s - v * (g - 1)) AS above, sum(v * (t - nn / t - (g - 1))) AS below FROM (
                SELECT any_value(up * (1 - up)) AS v, sum(n * (k / n - up) ^ 2) AS s, sum(n * n)::DOUBLE AS nn, sum(n)::DOUBLE AS t, count(*) AS g FROM d0 WHERE n > 0 GROUP BY suffix))),
        d1 AS (SELECT domain, (k + m * up) / (n + m) AS up FROM d0, dm),
        h0 AS (SELECT h.*, up FROM h JOIN d1 USING (domain)),
        hm AS (SELECT CASE WHEN coalesce(below, 0) <= 0 THEN 10 WHEN above <= 0 THEN 1000 ELSE greatest(0.1, least(1000, (1 - above / below) / (above / below))) END AS m FROM (
            SELECT sum(s - v * (g - 1)) AS above, sum(v * (t - nn / t - (g - 1))) AS below FROM (
                SELECT any_value(up * (1 - up)) AS v, sum(n * (k / n - up) ^ 2) AS s, sum(n * n)::DOUBLE AS nn, sum(n)::DOUBLE AS t, count(*) AS g FROM h0 WHERE n > 0 GROUP BY domain))),
        h1 AS (SELECT host, k + m * up AS a, n - k + m * (1 - up) AS b FROM h0, hm),
        low AS (SELECT host, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_low FROM h1)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bad_low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM v JOIN low USING (host)""",
    "op1_warc_round_trip": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        bits AS (SELECT page_id, html, list_transform(range(0, 32), lambda i: (
            list_reduce(list_transform(range(0, 5), lambda j: ((instr('0123456789abcdef', substr(hex, ((i * 5 + j) // 4)::INT + 1, 1)) - 1) >> (3 - (i * 5 + j) % 4)::INT) & 1), lambda a, x: a * 2 + x))) AS five FROM p),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(list_transform(five, lambda f: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', f::INT + 1, 1)), '') AS payload_digest FROM bits)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
        FROM d WINDOW same AS (PARTITION BY payload_digest)""",
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM d),
        bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM i),
        n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
        c AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, shared, item_shingles, shared::DOUBLE / item_shingles AS containment
        FROM c JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
