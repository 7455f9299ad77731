"""URL filter: hashed host-suffix and path-prefix expressions joined to a rule table.

Every URL is expanded into the expressions (host suffix, path prefix) that a rule could equal. Only
suffixes with a label count, and prefixes with a length, that some rule has are formed, so nothing
that could match is left out and a URL with thousands of dots stays small. An expression's SHA-256
is joined to the rules on its first four bytes (equi-join), then the full digests are compared, and
of the rules that fit, the longest wins (same length: block before allow, then the rule's text).

Defined results: null, empty or ``://``-less URL: empty host and path, no rule, the default verdict.
Repeated rows come back as often as they came; an empty rule table gives the default everywhere; only
the id and the URL column are read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import LOWER, UPPER

PREFIX_HEX = 8  # four bytes of the digest are the join key
BROADCAST_RULES = 200_000  # a rule row is under 1 KB; above this count the join shuffles both sides


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    # the length in front keeps ("a", "b/") and ("ab", "/") apart
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "\\.", -1))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict. ``rules``: host, path, verdict."""
    rules = rules.select(
        "host", "path", "verdict", F.concat("host", "path").alias("rule"),
        (F.length("host") + F.length("path")).alias("rule_len"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    ).withColumn("rule_key", F.substring("rule_digest", 1, PREFIX_HEX))
    # bounded: host names have at most 127 labels, and URL paths a few thousand lengths
    n, counts, lengths = rules.agg(
        F.count("*"), F.collect_set(_labels(F.col("host"))), F.collect_set(F.length("path"))).first()

    host, path = split_url(F.col(url_col))
    pages = pages.select(F.col(id_col).alias("page_key"), host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.", -1)
    suffixes = [F.when(F.size(labels) >= c, F.array_join(F.slice(labels, -c, c), ".")) for c in sorted(counts)]
    prefixes = [F.when(F.length("path") >= k, F.substring(F.col("path"), 1, k)) for k in sorted(lengths)]
    made = [F.when(s.isNotNull() & p.isNotNull(), _digest(s, p)) for s in suffixes for p in prefixes]
    digests = F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")

    exprs = pages.withColumn("part", F.spark_partition_id()).select(
        "part", "page_key", "host", "path", F.posexplode_outer(digests).alias("pos", "digest"))
    exprs = exprs.withColumn("expr_key", F.substring("digest", 1, PREFIX_HEX))
    # one row per key: rules that share the four bytes stand in one short list, so a join adds no rows
    by_key = rules.groupBy("rule_key").agg(F.collect_list(F.struct(
        "rule_len", (F.col("verdict") == "block").alias("is_block"), "rule", "verdict", "rule_digest")).alias("cands"))
    by_key = F.broadcast(by_key) if n <= broadcast_rules else by_key
    hits = exprs.join(by_key, exprs.expr_key == by_key.rule_key, "left")
    # the full digest confirms; of the rules left, the longest is the largest struct
    best = F.array_max(F.filter("cands", lambda c: c["rule_digest"] == F.col("digest")))
    # a page's expressions start in one partition: with its number in the key, repeated rows are
    # counted per partition and an often repeated row is spread over the reducers
    judged = hits.groupBy("part", "page_key", "host", "path").agg(
        F.max(best).alias("best"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).cast("int").alias("n"))
    return judged.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select(
        F.col("page_key").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
