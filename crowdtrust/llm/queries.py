"""The operators applied to their whole tables with production parameters;
the digest columns of each contract are derived from the operators' outputs.

SQL: DuckDB's form of the queries that it can express.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from . import (ann_hilbert, bpe, chat_repair, exact_topk, grammar, langid, lexical_search, packing, secret_scan, simhash_dedup, suffix_dedup, url_filter,
               whitening)
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_hilbert_ann(spark, sf_dir):
    return ann_hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), min_words=50)


def op3_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=3)


def op4_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY), end_id=0, capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in secret_scan.BASE), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


def op6_token_files(spark, sf_dir):
    ids = grammar.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY), end_id=2)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_chat_repair(spark, sf_dir):
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op8_compression_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark, sf_dir):
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op10_bpe(spark, sf_dir):
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_max_sketch_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_url_filter(spark, sf_dir):
    out = url_filter.judge(table(spark, sf_dir, "pages"))
    return out.withColumns({c: F.concat_ws(",", c) for c in ("strict_hits", "soft_hits")})


SPARK = {f.__name__: f for f in (
    op1_hilbert_ann, op2_suffix_dedup, op3_simhash_dedup, op4_packing, op5_secret_scan, op6_token_files, op7_chat_repair, op8_compression_langid,
    op9_exact_topk, op10_bpe, op11_max_sketch_search, op12_whitening, op13_url_filter)}


def _secret_sql() -> str:
    def either_case(names: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names)

    value = r"""["'']?\x20*[:=]\x20*["'']?"""
    patterns = {
        "assign": (either_case("(?:password|passwd|secret|token|api_?key)") + value + "([A-Za-z0-9+/_.=-]+)", 1),
        "access": ("AKIA[A-Z0-9]+", 0),
        "hex": ("[0-9a-f]+", 0),
        "id": (either_case("(?:user_?name|user_?id|user|login|account|client_?id|key_?id)") + value + "([A-Za-z0-9@+_.-]{3,})", 1),
        "blob": ("[A-Za-z0-9+/]{40,}", 0),
        "endpoint": (r"""https?://[^\x00-\x20"''<>]+|""" + either_case("(?:host|hostname|endpoint|server)") + value + "[A-Za-z0-9.:/-]{4,}", 0),
    }
    matches = " UNION ALL ".join(
        f"SELECT r, '{kind}' AS p, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS own, regexp_extract_all(t, '{p}', {g}) AS part "
        f"FROM docs WHERE regexp_matches(t, '{p}')" for kind, (p, g) in patterns.items())
    listing = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n, e){}, '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({matches}),
each AS (SELECT r, p, i, length(gaps[i]) AS gap, length(own[i]) AS own, length(part[i]) AS part
         FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM matches)),
placed AS (SELECT *, sum(gap + own) OVER (PARTITION BY r, p ORDER BY i) AS e FROM each),
parts AS (
  SELECT r, CASE WHEN p = 'assign' AND part < 8 THEN 'short' ELSE p END AS kind, (e - own)::BIGINT AS s, e::BIGINT AS e FROM placed
  WHERE NOT (p = 'assign' AND part < 4) AND NOT (p = 'access' AND own < 16) AND NOT (p = 'hex' AND own < 32)),
secrets AS (SELECT * FROM parts WHERE kind IN ('assign', 'hex', 'short', 'blob')),
identifiers AS (SELECT * FROM parts WHERE kind IN ('access', 'id')),
spans AS (
  SELECT *, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 WHEN 'id' THEN 3 WHEN 'short' THEN 4 WHEN 'blob' THEN 5 ELSE 6 END AS n
  FROM parts WHERE kind IN ('assign', 'access', 'hex')
    OR (kind NOT IN ('short', 'blob') OR EXISTS (SELECT 1 FROM identifiers i WHERE i.r = parts.r AND i.s < parts.e + {secret_scan.SCOPE} AND i.e > parts.s - {secret_scan.SCOPE}))
   AND (kind <> 'id' OR EXISTS (SELECT 1 FROM secrets x WHERE x.r = parts.r AND x.s < parts.e + {secret_scan.SCOPE} AND x.e > parts.s - {secret_scan.SCOPE}))
   AND (kind <> 'endpoint' OR (EXISTS (SELECT 1 FROM identifiers i WHERE i.r = parts.r AND i.s < parts.e + {secret_scan.SCOPE} AND i.e > parts.s - {secret_scan.SCOPE})
                           AND EXISTS (SELECT 1 FROM secrets x WHERE x.r = parts.r AND x.s < parts.e + {secret_scan.SCOPE} AND x.e > parts.s - {secret_scan.SCOPE}))))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex, sha256({listing.format(" FILTER (n < 3)")}) AS base_sha256, {listing.format(" FILTER (n IS NOT NULL)")} AS spans
FROM docs LEFT JOIN spans USING (r) GROUP BY r
"""


def _lexical_sql() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
g AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
w AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), g),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ts) * n) // l AS m FROM d, g WHERE len(ts) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, {terms} AS ts FROM benchmark),
asked AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(ts) AS t FROM i) GROUP BY ALL),
scored AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM asked JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY q, r)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 20
"""


def _url_sql() -> str:
    from .url_filter import RULES, SEVERAL, SOFT, STRICT

    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    edge = r"[^a-z0-9\x{80}-\x{10FFFF}]"
    alone = f"lambda t: regexp_matches(low, '(^|{edge})' || t || '({edge}|$)')"
    listed = lambda terms: f"list_filter([{', '.join(repr(t) for t in sorted(terms))}], {alone})"
    host = low.format("regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1)")
    return f"""
WITH rules(verdict, host, path) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u FROM pages),
parts AS (SELECT r, page_id, {low.format("u")} AS low, {host} AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
fits AS (SELECT r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(verdict, length(rules.host || rules.path)) AS verdict
         FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path) GROUP BY r),
found AS (SELECT *, {listed(STRICT)} AS strict, {listed(SOFT)} AS soft FROM parts)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN len(strict) > 0 OR len(soft) >= {SEVERAL} THEN 'block' ELSE 'allow' END) AS verdict,
       array_to_string(strict, ',') AS strict_hits, array_to_string(soft, ',') AS soft_hits
FROM found LEFT JOIN fits USING (r)
"""


SQL = {
    "op11_max_sketch_search": _lexical_sql(),
    "op13_url_filter": _url_sql(),
    "op5_secret_scan": _secret_sql(),
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, min([x::DOUBLE FOR x IN embedding]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id),
q AS (SELECT vec_id, [floor(256 * x) FOR x IN e] AS e FROM v),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
""",
}
