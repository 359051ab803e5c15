"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_topk, mixing, ngram_join, packing, prefix_trie, quality, sharding, spelling, token_counts, token_output, toxicity, url_filter
from .common import scratch_path

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks", "n_chunks")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "margin")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), scratch_path(spark, "token-files"), end_id=1)
    return token_output.read_tokens(spark, path, with_ids=False)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_model(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_ngram_jaccard, op3_token_counts, op4_embedding_dedup, op5_quality_rules, op6_mixing, op7_packing, op8_url_filter, op9_token_output, op10_toxicity, op11_prefix_trie, op12_spelling_variants, op13_exact_topk)
}
#: Every pair that shares a 5-word shingle, its exact overlap, and the closure of the links.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

#: CRC-32 by bytes: tab from its rule, then one step for each byte of a list.
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), n)) AS tab"


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a DuckDB text expression; tab must be in scope."""
    octets = f"list_transform(range(1, length(hex({text})) // 2 + 1), lambda i: (strpos('0123456789ABCDEF', hex({text})[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex({text})[2 * i]) - 1)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


OP11_SQL = f"""
WITH crc AS ({CRC_TABLE_SQL}),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY i) AS x FROM t GROUP BY c),
h AS (SELECT c, x, {crc_sql("c::VARCHAR")} % 9 AS h FROM own, crc),
built AS (SELECT h.c, list_concat(coalesce(b.x[1:h.h], []), h.x[h.h + 1:]) AS x FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5),
pre AS (SELECT c, len(x) AS n, d, x[1:d] AS k FROM built, unnest(range(0, len(x) + 1)) AS u(d)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM pre GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
cost AS (SELECT n.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(n.k[d].t)) ELSE 0 END AS saved FROM node n LEFT JOIN kids ON kids.k = n.k),
sums AS (SELECT k[1:a] AS k, a AS d, sum(saved)::BIGINT AS saved_tokens, (count(*) FILTER (n_children = 0))::BIGINT AS n_leaves FROM cost, unnest(range(0, d + 1)) AS u(a) GROUP BY 1, 2)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM cost c JOIN sums s ON s.k = c.k AND s.d = c.d LEFT JOIN node p ON c.d > 0 AND p.k = c.k[1:c.d - 1] AND p.d = c.d - 1
"""
OP12_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents),
occ AS (SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k FROM run WHERE length(r) >= 7 GROUP BY ALL),
hashed AS (SELECT r, k, {crc_sql("(id || ':' || r)")} AS h FROM occ, crc),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
rest AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS r FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
link AS (SELECT a.word AS x, b.word AS y FROM rest a JOIN rest b ON a.r = b.r AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word FROM rest a JOIN v ON v.word = a.r UNION SELECT v.word, a.word FROM rest a JOIN v ON v.word = a.r),
near AS (SELECT x, y, v.n, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, y) AS p, count(*) OVER (PARTITION BY x) AS n_near FROM link JOIN v ON v.word = y),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near.n >= 10 * v.n THEN y END AS form, CASE WHEN near.n >= 10 * v.n THEN near.n END AS form_n FROM v LEFT JOIN near ON x = word AND p = 1),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.at AS root FROM f JOIN walk ON walk.word = f.word JOIN f g ON g.word = walk.at AND g.form IS NULL
"""
OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS r, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0),
o AS (SELECT *, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, r))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10
"""
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": OP2_SQL, "op11_prefix_trie": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_exact_topk": OP13_SQL}
