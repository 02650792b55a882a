"""The query of each operator over the given tables, and the SQL text where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafspark.llm import alignment, bpe, decontam, exact_dedup, mixing, pii, quality, secret_scan, simhash, toxicity, url_filter, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def note(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return note


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_byte_bpe")
def op1(spark, folder):
    ranks = bpe.rank_file("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, folder, "documents"), ranks).drop("exact")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op2_url_filter", r"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT u.host, u.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM u JOIN r ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path""")
def op2(spark, folder):
    return url_filter.judge(table(spark, folder, "pages"), url_filter.rule_table(spark, RULES))


@query("op3_simhash")
def op3(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op6_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op6(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to FROM q""")
def op9(spark, folder):
    return warc.archive_round_trip(table(spark, folder, "pages"))


@query("op8_rule_quality")
def op8(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, folder, "labels")))


@query("op10_decontamination")
def op10(spark, folder):
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_secret_scan")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    return secret_scan.secret_report(docs, secret_scan.learn(docs))


@query("op4_pii")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    return pii.pii_report(docs, pii.learn(docs))


@query("op7_toxicity")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))


@query("op13_source_mix")
def op13(spark, folder):
    return mixing.mix_report(table(spark, folder, "documents"))


@query("op11_whitening")
def op11(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op12_token_alignment")
def op12(spark, folder):
    return alignment.align_documents(table(spark, folder, "documents"), bpe.rank_file("byte_bpe_50k.json"), bpe.rank_file("piece_bpe_32k.model"))
