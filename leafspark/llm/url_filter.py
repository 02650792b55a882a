"""URL filters: each URL is expanded into host-suffix and path-prefix expressions, which meet the rules by hash.

Only DataFrame functions. A distinct URL gives one expression for each of its host suffixes and each path length that
some rule has; those meet the rules by the first bytes of a digest, and the full digest decides. The suffixes of a host
and the path lengths are limited by what the rules have, so a very long URL gives no more expressions than they can meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafspark.llm.shared import pick

#: Most path lengths, and labels of a host, that rules may have between them: both become part of the plan.
MAX_LENGTHS = 4096
#: Up to so many rules (some 200 bytes each) are broadcast; more are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A to Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) from (verdict, host, path) rows."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules: host, path, verdict. A rule fits its host and the host's subdomains if the path starts with the rule's. The
    longest rule text wins; of equally long ones the one with the longer host, then block before allow. Without a rule
    the verdict is the default. A null URL, or one without ://, has an empty host and path and no rule. Rules with a
    null host or path are ignored; repeated rules count once; rules of an empty table fit nothing.
    """
    src = pick(pages, page_id=id_col, url=url_col)
    rules = pick(rules, rule_host="host", rule_path="path", rule_verdict="verdict").where("rule_host is not null and rule_path is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block is after allow
    digest = _expression(F.col("rule_host"), F.col("rule_path"))
    table = rules.select(F.substring(digest, 1, 8).alias("short"), digest.alias("full"), F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "rule_verdict")
    # What comes to the driver is bounded by the lengths and depths that the rules' texts have, not by their number.
    facts = rules.agg(F.count("*"), F.collect_set(F.length("rule_path")), F.collect_set(F.size(F.split("rule_host", r"\.")))).first()
    count, lengths, labels = facts[0], sorted(facts[1]), sorted(facts[2])
    if len(lengths) > MAX_LENGTHS or len(labels) > MAX_LENGTHS:
        raise ValueError("the rules have too many different path lengths or host depths")
    if count <= BROADCAST_RULES:
        table = F.broadcast(table)
    urls = src.select("url").where("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    numbers = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    depth = F.size(F.split("host", r"\."))
    suffixes = F.transform(F.filter(numbers(labels), lambda n: n <= depth), lambda n: F.array_join(F.slice(F.split("host", r"\."), depth - n + 1, n), "."))
    prefixes = F.transform(F.filter(numbers(lengths), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    spread = urls.where("host <> ''").select("url", F.explode(suffixes).alias("suffix"), "path").select("url", "suffix", F.explode(prefixes).alias("prefix"))
    spread = spread.select("url", _expression(F.col("suffix"), F.col("prefix")).alias("expression"))
    met = spread.join(table, F.substring("expression", 1, 8) == table.short).where("expression = full")
    best = met.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), "rule_verdict", "rule")).alias("best")).select(F.col("url").alias("best_url"), "best")
    joined = src.join(best, src.url == best.best_url, "left")
    return joined.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
