"""The operators' queries over the driver tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import ann, collocations, merkle, mixing, neardup, packing, pieces, pii, tokencount, tokenfile, topk, toxicity, urls

RULES = [urls.Rule(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]

#: Domains are made of the sources' numbers; the tables have none.
DOMAIN = "case pmod(cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as int), 3) when 0 then 'web' when 1 then 'books' when 2 then 'code' else '' end"
WEIGHTS = [{"web": 5, "books": 3, "code": 2}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {"*": 1}]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(docs: DataFrame) -> DataFrame:
    """Six tenths of all tokens to the target weights, of no document more than twice."""
    levels = {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, WEIGHTS, F.expr("total * 6 div 10"), max_epochs=2, seed=11)


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "epoch", "tokens")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op4_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_and_read(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_nearest_vectors, op2_mix_sources, op3_near_duplicates, op4_filter_urls, op5_token_files, op6_token_counts, op7_personal_data, op8_pack_sequences, op9_toxicity, op10_exact_top_k, op11_merkle_manifest, op12_phrases, op13_sentence_pieces)}

_URL_SQL = """
WITH parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rule, rule_host, rule_path) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('block', 'net/de/', 'net', '/de/'),
  ('allow', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fits AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM parsed p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The checksum of an id's digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))), 4294967295), 4294967295)"""
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{0}")) + ")"

_MERKLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS now,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM documents),
nodes AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS digest FROM docs
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, pos, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (
  SELECT d.doc_id, s.lvl, s.pos, d.pos // (3 ** s.lvl)::BIGINT AS own, s.digest
  FROM docs d JOIN nodes s ON s.source IS NOT DISTINCT FROM d.source AND s.n > 1 AND s.pos // 3 = d.pos // (3 ** (s.lvl + 1))::BIGINT
  UNION ALL
  SELECT d.doc_id, 1000 + s.lvl, s.pos, r.pos // (3 ** s.lvl)::BIGINT, s.digest
  FROM docs d JOIN subroots r ON r.source IS NOT DISTINCT FROM d.source JOIN tops s ON s.n > 1 AND s.pos // 3 = r.pos // (3 ** (s.lvl + 1))::BIGINT),
sides AS (
  SELECT doc_id, lvl, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < own), '') AS l, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > own), '') AS r
  FROM steps GROUP BY doc_id, lvl),
proofs AS (SELECT doc_id, list(l || '|' || r ORDER BY lvl) AS proof, string_agg(l || r, '' ORDER BY lvl) AS whole FROM sides GROUP BY doc_id),
folded AS (
  SELECT d.doc_id, d.leaf, r.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(p.whole, '')) AS proof_sha256,
    CASE WHEN p.proof IS NULL THEN d.now ELSE list_reduce(p.proof, lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2)), d.now) END AS folded_root
  FROM docs d JOIN subroots r ON r.source IS NOT DISTINCT FROM d.source LEFT JOIN proofs p ON p.doc_id = d.doc_id)
SELECT *, folded_root = root AS verified FROM folded
"""

_PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
found AS (SELECT * FROM f WHERE k > 1 AND n >= 100),
kept AS (
  SELECT * FROM found p
  WHERE NOT EXISTS (SELECT 1 FROM found q WHERE q.lang = p.lang AND q.k > p.k AND 100 * q.n >= 100 * p.n AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
cuts AS (
  SELECT lang, k, phrase, n AS a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.n AS l, y.n AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = c.rest JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL = {"op4_filter_urls": _URL_SQL, "op10_exact_top_k": _TOP_SQL, "op11_merkle_manifest": _MERKLE_SQL, "op12_phrases": _PHRASES_SQL}
