"""The registered queries of these operators: each applies one with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard, language, mixing, quality, secrets, suffix_dedup, topk, toxicity
from .common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 5) == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, fold(docs["doc_id"], 4) == 2)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 3) == 1)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_decontaminate, op4_language_id, op5_jaccard_join, op6_html_text, op7_mix_sources, op8_exact_topk, op9_quality, op10_secret_scan)
}
#: SQL by the definitions alone: all windows grouped (op2, bytes as hex digits), joined (op3), all shared shingles counted (op5), the
#: level of the targets as the largest of what each set of full sources leaves and one running sum a source (op7), all pairs (op8).
ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": """
        WITH t AS (
            SELECT row_number() OVER (ORDER BY doc_id) AS d, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
        ), w AS (
            SELECT d, p, md5_number(substr(h, (2 * p + 1)::BIGINT, 200)) AS k FROM (SELECT d, h, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100)
        ), again AS (
            SELECT d, p FROM (SELECT d, p, row_number() OVER (PARTITION BY k ORDER BY d, p) AS i FROM w) WHERE i > 1
        ), cut AS (
            SELECT d, p, CASE WHEN p <= lag(p) OVER (PARTITION BY d ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM again
        ), run AS (
            SELECT d, r, min(p) AS a, max(p) + 100 AS b FROM (SELECT d, p, sum(new) OVER (PARTITION BY d ORDER BY p) AS r FROM cut) GROUP BY d, r
        ), gap AS (
            SELECT run.d, a, b, coalesce(lag(b) OVER (PARTITION BY run.d ORDER BY a), 0) AS kept_from FROM run
        ), per AS (
            SELECT t.d, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
                   string_agg(substr(h, (2 * kept_from + 1)::BIGINT, (2 * (a - kept_from))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS kept
            FROM gap JOIN t ON t.d = gap.d GROUP BY t.d
        )
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM t LEFT JOIN per ON per.d = t.d
    """,
    "op3_decontaminate": r"""
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), item AS (
            SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[p : p + least(8, len(w)) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS p FROM b WHERE len(w) > 0)
        ), size AS (SELECT DISTINCT n FROM item
        ), place AS (
            SELECT k, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
            FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, size WHERE len(w) >= n)
        ), hit AS (
            SELECT k, p, place.n AS n, item_id FROM place JOIN item ON item.s = place.s AND item.n = place.n
        ), hit_words AS (
            SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM hit) GROUP BY k
        ), hit_items AS (
            SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY k
        )
        , row_item AS (SELECT row_number() OVER () AS j, w FROM b WHERE len(w) > 0
        ), item_place AS (
            SELECT j, least(8, len(w)) AS n, q, array_to_string(w[q : q + least(8, len(w)) - 1], ' ') AS s FROM (SELECT j, w, unnest(range(1, greatest(len(w) - 6, 2))) AS q FROM row_item)
        ), diagonal AS (
            SELECT k, j, place.n AS n, p, p - q AS g, p - row_number() OVER (PARTITION BY k, j, p - q ORDER BY p) AS island FROM place JOIN item_place i ON i.s = place.s AND i.n = place.n
        ), stretch AS (
            SELECT k, min(p) AS p, (count(*) + any_value(n) - 1)::INTEGER AS m FROM diagonal GROUP BY k, j, g, island
        ), longest AS (
            SELECT k, max(m) AS m, min(p) FILTER (m = top)::INTEGER AS p FROM (SELECT *, max(m) OVER (PARTITION BY k) AS top FROM stretch) GROUP BY k
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(longest.m, 0) AS longest_match, longest.p - 1 AS longest_at
        FROM d LEFT JOIN hit_words USING (k) LEFT JOIN hit_items USING (k) LEFT JOIN longest USING (k)
    """,
    "op5_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x85\p{Z}]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT k, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)
        ), sets AS (
            SELECT k, list(g ORDER BY g) AS grams FROM s GROUP BY k
        ), c AS (
            SELECT grams, min(doc_id) AS copy_id, count(*) AS copies, len(grams) AS n, row_number() OVER () AS c FROM sets JOIN d USING (k) GROUP BY grams
        ), g AS (
            SELECT c, n, unnest(grams) AS g FROM c
        ), shared AS (
            SELECT a.c AS a, b.c AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c
        ), link AS (
            SELECT a, b FROM shared WHERE 5 * common >= 4 * (an + bn - common)
        ), reach AS (
            SELECT c AS a, c AS b FROM c UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
        ), cls AS (
            SELECT reach.a AS c, min(copy_id) AS class_id FROM reach JOIN c ON c.c = reach.b GROUP BY reach.a
        ), n_links AS (
            SELECT link.a AS c, sum(copies) AS links FROM link JOIN c ON c.c = link.b GROUP BY link.a
        )
        SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(copy_id, doc_id) AS copy_id, (coalesce(links, 0) + coalesce(copies, 1) - 1)::BIGINT AS n_links
        FROM d LEFT JOIN sets USING (k) LEFT JOIN c USING (grams) LEFT JOIN cls USING (c) LEFT JOIN n_links USING (c)
    """,
    "op7_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   greatest(0.1::DOUBLE, coalesce(1 - 5 * (length(text) - length(translate(text, '#$%&*@^~|<>{}[]=_+\!', ''))) / greatest(length(text), 1), 0.1::DOUBLE)) AS w,
                   md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')) AS h FROM documents
        ), k AS (
            SELECT *, -ln((('0x' || h[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE) / w AS key, ('0x' || h[14:28])::BIGINT AS tie FROM d
        ), s AS (
            SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos FROM d GROUP BY source
        ), p AS (
            SELECT *, 2 * n AS cap, (CASE pos % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS f FROM s
        ), level AS (
            SELECT max(x) AS x FROM (
                SELECT (1.5::DOUBLE * sum(o.n) - coalesce(sum(o.cap) FILTER (o.cap / o.f < p.cap / p.f), 0)) / sum(o.f) FILTER (o.cap / o.f >= p.cap / p.f) AS x FROM p, p AS o GROUP BY p.pos
            )
        ), t AS (
            SELECT source, n, least(cap::DOUBLE, f * x) AS target FROM p, level
        ), r AS (
            SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole,
                   coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, n AS source_size, target, (whole * size + greatest(0, least(size, floor(target - whole * n)::BIGINT - before)))::BIGINT AS taken FROM r
    """,
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                   list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i]))::BIGINT AS score
            FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
