"""Queries of the training-data operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import ann, fingerprints, language_id, mixing, near_dedup, packing, quality, secrets, url_filter, warc

#: Target weights of the sources, as shares; sources that are not listed have share 1.
SHARES = {"src0": 8, "src1": 4, "src2": 4, "src3": 2, "src4": 2}
#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The vocabulary's files.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> packing.Vocabulary:
    import public_tokenizers

    return packing.Vocabulary(public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARES).drop("source")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS t(host, path, verdict)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("intact")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).withColumn("found", F.sha2(F.col("found").cast("binary"), 256)).withColumnRenamed("found", "found_sha256")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_language_id, op2_mixing, op3_fingerprints, op4_url_filter, op5_packing, op6_near_dedup, op7_warc, op8_quality, op9_secrets, op10_ann)
    return {f.__name__: f for f in named}


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(rh, rp, v) AS (VALUES {rules}),
parts AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT p.*, r.rh || r.rp AS rule, r.v,
    row_number() OVER (PARTITION BY p.row ORDER BY length(r.rh) + length(r.rp) DESC NULLS LAST, length(r.rh) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1"""


def _mixing_sql() -> str:
    share = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SHARES.items()) + " ELSE 1 END"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '<null>') AS s, row_number() OVER (PARTITION BY coalesce(source, '<null>') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS block FROM documents),
c AS (SELECT s, count(*) AS n, {share} AS a FROM d GROUP BY s),
cuts AS (SELECT DISTINCT unnest([0, n // a, n // a + 1]) AS first FROM c),
f AS (SELECT first, coalesce(lead(first) OVER (ORDER BY first), first + 1) AS after FROM cuts),
p AS (
  SELECT first, after, list(struct_pack(s := s, c := least(a, n - first * a)) ORDER BY s) AS parts, CAST(sum(least(a, n - first * a)) AS BIGINT) AS len
  FROM f JOIN c ON first * a < n GROUP BY first, after),
q AS (SELECT *, CAST(coalesce(sum((after - first) * len) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM p),
sim AS (
  SELECT first, len, parts, CAST(0 AS BIGINT) AS t, list_transform(parts, lambda x: CAST(0 AS BIGINT)) AS done, CAST(-1 AS BIGINT) AS pick FROM q
  UNION ALL
  SELECT first, len, parts, t + 1, list_transform(done, lambda x, i: CASE WHEN i - 1 = m THEN x + 1 ELSE x END), m FROM (
    SELECT *, CAST(list_min(list_filter(list_transform(parts, lambda x, i: CASE WHEN done[i] < x.c AND done[i] * len // x.c <= t THEN ((done[i] + 1) * len + x.c - 1) // x.c * 1000000 + i - 1 END), lambda z: z IS NOT NULL)) % 1000000 AS BIGINT) AS m
    FROM sim WHERE t < len)),
slots AS (SELECT first, t - 1 AS pos, parts[pick + 1].s AS s, parts[pick + 1].c AS c, done[pick + 1] - 1 AS r FROM sim WHERE t > 0),
g AS (SELECT d.*, d.block // c.a AS frame, d.block % c.a AS r FROM d JOIN c USING (s))
SELECT g.doc_id, g.s AS source_name, g.block, CAST(g.frame AS BIGINT) AS frame, base + (g.frame - q.first) * len + pos AS slot,
  base + (g.frame - q.first) * len + g.r * len // slots.c AS released, base + (g.frame - q.first) * len + ((g.r + 1) * len + slots.c - 1) // slots.c AS due
FROM g JOIN q ON g.frame >= q.first AND g.frame < q.after JOIN slots ON slots.first = q.first AND slots.s = g.s AND slots.r = g.r"""


#: Brute force on digests in one window; the archives must give the same after the round trip.
_WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY d) AS head FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n < 100 OR k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR k = 1 THEN NULL ELSE head END AS refers_to
FROM r"""

#: The same tree by list functions: sections, paragraphs, leaves, and Jaccard similarity of distinct leaves.
_LEAVES = """list_transform(regexp_extract_all({t}, '(?s).+?(?:\\n{{2,}}|\\z)'), lambda s: list_transform(regexp_extract_all(s, '[^\\n]*\\n|[^\\n]+'),
    lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,96}}?(?:[.!?]+[ \\n\\r\\t]+|\\z)|.{{1,96}}'), lambda x: sha256('0' || x))))"""
_ROOT = "sha256('3' || array_to_string(list_transform({t}, lambda s: sha256('2' || array_to_string(list_transform(s, lambda p: sha256('1' || array_to_string(p, ''))), ''))), ''))"
_LIKE = """CASE WHEN len(list_distinct(flatten(flatten({a}))) || list_distinct(flatten(flatten({b})))) = 0 THEN 1.0
    ELSE CAST(len(list_intersect(list_distinct(flatten(flatten({a}))), list_distinct(flatten(flatten({b}))))) AS DOUBLE)
      / len(list_distinct(flatten(flatten({a})) || flatten(flatten({b})))) END"""
_FINGERPRINT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 4) || left(nxt, length(text) // 4) AS edited FROM n),
t AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_LEAVES.format(t="text")} AS t, {_LEAVES.format(t="edited")} AS e, {_LEAVES.format(t="nxt")} AS x FROM e)
SELECT doc_id, n_chars, edited_sha256, {_ROOT.format(t="t")} AS fingerprint, {_ROOT.format(t="e")} AS edited_fingerprint,
  {_LIKE.format(a="t", b="e")} AS near_edited, {_LIKE.format(a="t", b="x")} AS near_next
FROM t"""

#: Exact links and components by joins and recursion; slow on large tables.
_NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, hash(u) AS h FROM (SELECT doc_id, s, unnest(s) AS u FROM s)),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.node = s.doc_id"""

#: Exact search, which the index need not equal: it is not registered, tests measure recall against it.
EXACT_NEAREST_SQL = """
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
FROM x q JOIN x c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": _mixing_sql(), "op3_fingerprints": _FINGERPRINT_SQL, "op4_url_filter": _url_sql(), "op6_near_dedup": _NEAR_SQL, "op7_warc": _WARC_SQL}
