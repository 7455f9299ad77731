"""Registered queries of this package: name -> callable(spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# fixed values: the contract's rules
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

URL_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
       ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
               THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
urls AS (SELECT row_number() OVER () AS k, page_id,
                translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
hits AS (SELECT k, page_id, host, path, rhost || rpath AS rule, rverdict,
                row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC NULLS LAST) AS r
         FROM urls LEFT JOIN rules
           ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM hits WHERE r = 1
"""


@query("op10_url_filter", URL_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


@query("op7_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op8_decontaminate", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'),
             lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'),
             lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, len(win) AS k, array_to_string(win, ' ') AS win FROM (
          SELECT item_id, unnest([ws[i:i + 12] FOR i IN generate_series(1, greatest(1, len(ws) - 12))]) AS win
          FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, sizes WHERE len(ws) >= k)),
hit AS (SELECT DISTINCT d.doc_id, d.k, d.i, win.item_id FROM dw d JOIN win USING (k, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
          SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.decontaminate import contamination, is_contaminated

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op6_substring_dedup", r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS ws FROM documents),
s AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS win
      FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM s JOIN rep USING (win)),
each AS (SELECT r, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT each.r, string_agg(word, ' ' ORDER BY each.p) AS body, count(*) AS n
         FROM each ANTI JOIN cov ON each.r = cov.r AND each.p = cov.p GROUP BY each.r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.substring_dedup import substring_dedup

    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def sentencepiece_model() -> bytes:
    """The public BPE model with byte fallback that this machine offers (LLM_SENTENCEPIECE_MODEL names another)."""
    import os

    from churnlens.llm.sentencepiece_tokens import read_model

    return read_model(os.environ.get("LLM_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model"))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.sentencepiece_tokens import encode

    docs = table(spark, sf_dir, "documents")
    rows = encode(docs, sentencepiece_model())
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "same")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.toxicity import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, labels.where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.quality import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality(docs, labels.where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")


@query("op5_html_extract")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.html_extract import extract

    rows = extract(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.pii import find_pii, joined

    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """The contract's rounds spelt out, one pair of common tables each."""
    square = "list_sum(list_transform(range(1, 65), lambda j: (v.c[j] - m.c[j]) * (v.c[j] - m.c[j])))"
    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), c) - 1 AS k, c FROM v QUALIFY k < {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, any_value(vc) AS c, min(d * {k} + k) % {k} AS k, min(d * {k} + k) // {k} AS d
FROM (SELECT v.r, v.vec_id, v.c AS vc, m.k, {square} AS d FROM v, m{i} m) GROUP BY r, vec_id)""")
        if i < rounds:
            ctes.append(f"""m{i + 1} AS MATERIALIZED (SELECT m.k, coalesce(n.c, m.c) AS c FROM m{i} m LEFT JOIN (
SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
  SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(c) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j) GROUP BY k) n USING (k))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, a.k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m USING (k)"""


@query("op11_centroids", centroid_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.centroids import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def mixture_sql(near: float = 0.001, fills: int = 8) -> str:
    """Targets in closed form; each threshold by a running sum in hash order over the documents still open."""
    ctes = [r"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15) AS key, size
FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x{20}\x{09}-\x{0D}]+')), 0) AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (place - 1) % 3] AS weight FROM s),
-- the sources that fill up first come first; the share is found where the next one no longer fills up
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, place) AS f FROM w),
c AS (SELECT 0 AS f, 0::BIGINT AS filled, (SELECT sum(weight) FROM w)::BIGINT AS still
      UNION ALL SELECT f, sum(3 * source_size) OVER p, (SELECT sum(weight) FROM w) - sum(weight) OVER p FROM o
      WINDOW p AS (ORDER BY f ROWS UNBOUNDED PRECEDING)),
h AS (SELECT c.f, ((SELECT sum(source_size) FROM w) - filled)::BIGINT::DOUBLE / nullif(still, 0)::DOUBLE AS share FROM c),
q AS (SELECT first(share ORDER BY h.f) AS share FROM h LEFT JOIN o ON o.f = h.f + 1
      WHERE o.f IS NULL OR (3 * source_size)::DOUBLE > weight::DOUBLE * share),
t AS (SELECT source, place, source_size, least((3 * source_size)::DOUBLE, weight::DOUBLE * (SELECT share FROM q)) AS target FROM w),
b AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
e AS MATERIALIZED (SELECT r, doc_id, size, key, place FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
r0 AS (SELECT place, target, target - whole * source_size AS rest FROM b WHERE source_size > 0 AND target - whole * source_size > 0),
x0 AS (SELECT r FROM e WHERE false)"""]
    for i in range(fills):
        fits = "" if not i else " AND e.size <= n.rest AND n.rest > n.target * " + str(near)
        ctes.append(f"""u{i} AS MATERIALIZED (SELECT e.r, e.place, sum(e.size) OVER (PARTITION BY e.place ORDER BY e.key, e.r)::BIGINT AS upto, n.rest
FROM e JOIN r{i} n USING (place) WHERE e.size > 0 AND e.r NOT IN (SELECT r FROM x{i}){fits}),
x{i + 1} AS MATERIALIZED (SELECT r FROM x{i} UNION ALL SELECT r FROM u{i} WHERE upto <= rest),
r{i + 1} AS MATERIALIZED (SELECT n.place, n.target, n.rest - coalesce(max(u.upto) FILTER (u.upto <= u.rest), 0) AS rest
FROM r{i} n LEFT JOIN u{i} u USING (place) GROUP BY n.place, n.target, n.rest)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN x.r IS NULL THEN 0 ELSE 1 END) AS taken
FROM e JOIN b USING (place) LEFT JOIN x{fills} x ON x.r = e.r"""


@query("op12_mixture", mixture_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'),
             lambda x: x <> '') AS ws FROM documents),
it AS (SELECT q, item_id, t, count(*) AS qf FROM (SELECT row_number() OVER () AS q, item_id, unnest(list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')) AS t FROM benchmark) GROUP BY q, item_id, t),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY r, t),
nl AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
wt AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, nl GROUP BY t, n_docs),
sc AS (SELECT q, item_id, d.r, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ws) * n_docs) // n_terms))))::BIGINT AS score
       FROM it JOIN tf USING (t) JOIN wt USING (t) JOIN d USING (r), nl GROUP BY q, item_id, d.r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 20
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnlens.llm.lexical_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
