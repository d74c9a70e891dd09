"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, collocations, langid, lm_scoring, merkle, mixing, pii, sharding, simhash, token_counts, topk, toxicity
from .common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
UNIGRAM_RANKS = "byte_bpe_50k.tiktoken"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lm_scoring.score_documents(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_tokens", "n_seen", F.round("log_score", 3).alias("log_score"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(UNIGRAM_RANKS), public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "class_size")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, digest=True)


def op10_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.inspect_documents(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_scoring, op2_token_counts, op3_simhash, op4_toxicity, op5_topk, op6_mixing, op7_sharding, op8_langid, op9_bpe, op10_avi, op11_merkle, op12_collocations, op13_pii, pipeline)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos
           FROM (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS l FROM documents)),
u AS (SELECT word, count(*) AS c FROM t GROUP BY word),
total AS (SELECT count(*) AS n FROM t),
b AS (SELECT doc_id, pos, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS v, word AS w FROM t),
dn AS (SELECT doc_id, v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY ALL),
bc AS (SELECT v, w, sum(n) AS c FROM dn GROUP BY ALL),
s AS (SELECT doc_id, CASE WHEN bc.c > dn.n THEN dn.n ELSE 0 END AS seen,
             dn.n * CASE WHEN bc.c > dn.n THEN ln((bc.c - dn.n)::DOUBLE) - ln(uv.c::DOUBLE)
                         ELSE ln(0.4::DOUBLE) + ln(uw.c::DOUBLE) - ln((SELECT n FROM total)::DOUBLE) END AS part
      FROM dn JOIN bc USING (v, w) JOIN u uv ON uv.word = v JOIN u uw ON uw.word = w
      UNION ALL
      SELECT doc_id, 0, ln(u.c::DOUBLE) - ln((SELECT n FROM total)::DOUBLE) FROM b JOIN u ON u.word = w WHERE v IS NULL),
sc AS (SELECT doc_id, sum(seen) AS n_seen, sum(part) AS log_score FROM s GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_tokens FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_seen, 0)::BIGINT AS n_seen, round(coalesce(log_score, 0), 3) AS log_score
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id) LEFT JOIN sc USING (doc_id)
"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = rf"""
WITH h AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size, md5(coalesce(text, '')) AS hash FROM documents),
e AS (SELECT *, concat_ws(':', coalesce(doc_id::VARCHAR, ''), hash, coalesce(source, ''), (row_number() OVER (PARTITION BY doc_id, source, hash) - 1)::VARCHAR) AS key FROM h),
d AS (SELECT doc_id, source, size, key, (('0x' || substr(md5('20240229:' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS goal FROM s),
f AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, cap, w, (SELECT arg_min(level, cap / w) FROM f WHERE level * w < cap) AS level FROM f),
g AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM g),
k AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS words FROM r),
x AS (SELECT d.*, k.source_size, k.target, k.whole, k.p, k.words, greatest(least(k.p, 1 - 1e-12), 1e-12) AS q FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
o AS (SELECT *, ln(u) - ln(1 - u) - ln(q) + ln(1 - q) AS rank FROM x),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, key ROWS UNBOUNDED PRECEDING) AS upto FROM o),
st AS (SELECT *, coalesce(min(CASE WHEN upto > words THEN rank END) OVER (PARTITION BY source), 1e300) AS stop FROM c),
pk AS (SELECT *, p > 0 AND rank < stop AS picked FROM st),
gp AS (SELECT *, words - sum(CASE WHEN picked THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM pk),
cl AS (SELECT source, arg_min(key, (abs(size - gap), rank, key)) AS closing_key FROM gp WHERE NOT picked AND size > 0 AND p > 0 AND size < 2 * gap GROUP BY source)
SELECT gp.doc_id, gp.size, gp.source_size, gp.target,
       CASE WHEN gp.size > 0 THEN ((gp.whole + (gp.picked OR coalesce(gp.key = cl.closing_key, false))::INTEGER) * gp.size)::BIGINT ELSE 0 END AS taken
FROM gp LEFT JOIN cl ON gp.source IS NOT DISTINCT FROM cl.source
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

_CRC32 = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""

OP11_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
l AS MATERIALIZED (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format("changed")} AS subject,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_LEAF.format("text")}) - 1 AS pos FROM t),
up AS (SELECT source, 0 AS level, list(leaf ORDER BY pos) AS hs FROM l GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(list_slice(hs, i + 1, i + 3), ''))) FROM up WHERE len(hs) > 1),
sub AS MATERIALIZED (SELECT source, hs[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM up WHERE len(hs) = 1),
tops AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS hs FROM sub
  UNION ALL SELECT level + 1, list_transform(range(0, len(hs), 3), lambda i: sha256(array_to_string(list_slice(hs, i + 1, i + 3), ''))) FROM tops WHERE len(hs) > 1),
steps AS (
  SELECT l.source, l.pos, 0 AS part, level, hs, (l.pos // (3 ** level)::BIGINT)::BIGINT AS i FROM l JOIN up ON l.source IS NOT DISTINCT FROM up.source WHERE len(hs) > 1
  UNION ALL SELECT l.source, l.pos, 1, level, hs, (sub.pos // (3 ** level)::BIGINT)::BIGINT FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source, tops WHERE len(hs) > 1),
step AS (SELECT source, pos, part, level, array_to_string(list_slice(hs, 3 * (i // 3) + 1, i), '') || '|' || array_to_string(list_slice(hs, i + 2, 3 * (i // 3) + 3), '') AS s FROM steps),
path AS (SELECT source, pos, list(s ORDER BY part, level) AS p FROM step GROUP BY source, pos),
f AS (SELECT l.*, sub.subroot, (SELECT hs[1] FROM tops WHERE len(hs) = 1) AS root, coalesce(p, []) AS p
      FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source LEFT JOIN path ON path.source IS NOT DISTINCT FROM l.source AND path.pos = l.pos),
g AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: replace(x, '|', '')), '')) AS proof_sha256,
             list_reduce(p, lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)), subject) AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM g
"""


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+'), lambda w: w <> '') AS ws FROM documents),
g AS (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, 6) AS r(m) WHERE len(ws) >= m)),
f AS (SELECT lang, phrase, m, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT *, array_to_string(ws[1:k], ' ') AS fst, array_to_string(ws[k + 1:], ' ') AS rst FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = fst JOIN f y ON y.lang = k.lang AND y.phrase = rst JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(ws[j:j + h - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - h + 2)) AS j FROM c, range(2, 5) AS r(h) WHERE h < m) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM d)
SELECT * FROM o WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": OP1_SQL, "op5_topk": OP5_SQL, "op6_mixing": OP6_SQL, "op11_merkle": OP11_SQL, "op12_collocations": OP12_SQL}
