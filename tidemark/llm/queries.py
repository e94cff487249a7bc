"""The registered queries of this folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import centroids, decontamination, hard_negatives, language_id, license_scan, ngram_join, packing, quality_rules, suffix_dedup, token_counts, token_files, url_filter, warc
from tidemark.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Sites of gambling, pills, trackers, spam and adult pages, under every top-level domain of the pages: a production list comes as a table of the same form.
BLOCKED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{site}.example.{top}/" for site in BLOCKED_SITES for top in ("com", "net", "org"))


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op2_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, url_filter.entry_table(spark, URL_RULES, BLOCKED_HOSTS))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.token_counts(docs.select("doc_id", "text"), PIECE_BPE)
    return counts.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs, ~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), model).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_license_scans(spark, sf_dir):
    """The documents as files: the source is the repository, with a folder for each thousand of ids."""
    number = F.col("doc_id")
    path = F.concat_ws("/", "source", F.floor(number / 1000), F.concat(number, F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    found = license_scan.scan(files)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("row.path").alias("path"), "own_licence", F.round("cosine", 6).alias("cosine"), "licence_file", "licence", "licence_from")


def op7_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_ngram_join(spark, sf_dir):
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_centroid_clustering(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_license_scans": op6_license_scans,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_files": op9_token_files,
    "op10_ngram_join": op10_ngram_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_warc": op13_warc,
}

def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and exact floored means, one after another."""

    def nearest(centroids: str) -> str:
        return f"""SELECT vec_id, v, c AS cluster, distance FROM (SELECT p.vec_id, p.v, z.c,
            list_sum(list_transform(list_zip(p.v, z.v), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT AS distance FROM points p CROSS JOIN {centroids} z)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1"""

    steps = [f"""points AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""z0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS c, v FROM points
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {k})"""]
    for i in range(rounds):
        steps += [f"a{i} AS MATERIALIZED ({nearest(f'z{i}')})",
                  f"m{i} AS (SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY ALL)",
                  f"""z{i + 1} AS MATERIALIZED (SELECT c, coalesce(list_sort_v, v) AS v FROM z{i} LEFT JOIN (SELECT cluster,
            list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS list_sort_v FROM m{i} GROUP BY cluster) ON c = cluster)"""]
    steps.append(f"a AS MATERIALIZED ({nearest(f'z{rounds}')})")
    return "WITH " + ",\n        ".join(steps) + f"""
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(z.v, ',')) AS centroid_sha256
        FROM a JOIN z{rounds} z ON z.c = a.cluster"""


_A, _a = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op2_url_filters": f"""
        WITH rules(rule, action) AS (VALUES {", ".join(f"('{r}', '{a}')" for r, a in URL_RULES.items())}),
        listed(entry) AS (VALUES {", ".join(f"('{e}')" for e in BLOCKED_HOSTS)}),
        parts AS (SELECT page_id, row_number() OVER () AS at,
            translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_A}', '{_a}') AS host,
            regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        fits AS (SELECT p.at, r.rule, r.action, row_number() OVER (PARTITION BY p.at ORDER BY length(r.rule) DESC) AS n
            FROM parts p JOIN rules r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
            AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))),
        hits AS (SELECT DISTINCT p.at FROM parts p JOIN listed l
            ON (p.host = split_part(l.entry, '/', 1) OR ends_with(p.host, '.' || split_part(l.entry, '/', 1)))
            AND starts_with(p.path, substr(l.entry, strpos(l.entry, '/'))))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, CASE WHEN h.at IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM parts p LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON p.at = f.at LEFT JOIN hits h ON p.at = h.at""",
    "op11_hard_negatives": """
        WITH kept AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
                list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, p.positive_id, (row_number() OVER best)::INTEGER AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.alike
            AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
        QUALIFY row_number() OVER best <= 10""",
    "op12_centroid_clustering": _clustering_sql(),
    "op13_warc": """
        WITH read AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS payload FROM pages),
        grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS newest FROM read)
        SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to, NULL::VARCHAR AS problem
        FROM grouped""",
}
