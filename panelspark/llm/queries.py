"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, byte_bpe, cover_tree, dac, edit_counts, kneser_ney, licences, mixing, near_dedup, quality_rules, ranked_search, sharding, util, word_runs

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % cover_tree.EVERY == 0)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    scored = backoff_lm.score(table(spark, sf_dir, "documents"), remainder != 2)
    rounded = [F.round(c, 6).alias(c) for c in ("base_score", "score")]  # sums of logarithms in any order
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *rounded)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = util.scratch(spark, "op13")
    return dac.digests(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_sharding, op4_quality_classifier, op5_top_k, op6_licences, op7_near_dedup, op8_byte_bpe, op9_lm_scoring, op10_token_counts, op11_word_runs, op12_ranked_search, op13_token_files, pipeline)}

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size,
         md5('7/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source
), capped AS (
  SELECT source, source_size, CAST(w AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap, CAST(source_size * 3 AS DOUBLE) / CAST(w AS DOUBLE) AS ratio FROM sources
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM capped
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT rest / open FROM levels WHERE rest / open <= ratio ORDER BY ratio, rest / open LIMIT 1), 'inf') * w) AS target FROM levels
), quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), rests AS (
  SELECT *, target - whole * source_size AS rest FROM quotas
), cells AS (
  SELECT source, substr(h, 1, 3) AS cell, sum(size) AS words FROM d GROUP BY ALL
), before AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cells
), edges AS (
  SELECT b.source, b.cell AS edge, r.rest - b.before AS edge_rest
  FROM before b JOIN rests r ON b.source IS NOT DISTINCT FROM r.source
  WHERE b.before <= r.rest AND b.before + b.words > r.rest
), subs AS (
  SELECT d.source, substr(h, 4, 3) AS sub, edge_rest, sum(size) AS words
  FROM d JOIN edges e ON d.source IS NOT DISTINCT FROM e.source AND substr(h, 1, 3) = e.edge GROUP BY ALL
), ends AS (
  SELECT source, min(sub) AS sub_end FROM (
    SELECT source, sub, coalesce(sum(words) OVER (PARTITION BY source ORDER BY sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2 > edge_rest AS out FROM subs
  ) WHERE out GROUP BY source
), plan AS (
  SELECT r.*, CASE WHEN edge IS NOT NULL THEN edge WHEN rest > 0 THEN 'g' ELSE '' END AS edge, coalesce(sub_end, 'g') AS sub_end
  FROM rests r LEFT JOIN edges e ON r.source IS NOT DISTINCT FROM e.source LEFT JOIN ends n ON r.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(whole + CASE WHEN substr(h, 1, 3) < edge OR (substr(h, 1, 3) = edge AND substr(h, 4, 3) < sub_end) THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents
), t AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d
), runs AS (
  SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), own AS (
  SELECT DISTINCT doc_id, g FROM runs WHERE i <= greatest(n - 4, 1)
), sizes AS (
  SELECT doc_id, count(g) AS n FROM d LEFT JOIN own USING (doc_id) GROUP BY doc_id
), shingles AS (
  SELECT * FROM own JOIN sizes USING (doc_id)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS id, doc_id AS m FROM sizes
  UNION
  SELECT links.b, reached.m FROM reached JOIN links ON reached.id = links.a
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT id, min(m) AS component_id FROM reached GROUP BY id) ON id = doc_id
"""

#: The usual CRC-32, bit by bit.
CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda x, y: list_reduce(list_concat([xor(x, y)], [CAST(0 AS UBIGINT) FOR i IN range(8)]), lambda p, q: xor(p >> 1, (p & 1) * CAST(3988292384 AS UBIGINT)))), CAST(4294967295 AS UBIGINT))"

OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out, list_append(regexp_extract_all({LOWER}, {WORDS}), ' end') AS w FROM documents
), t AS (
  SELECT r, held_out, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d
), g AS (
  SELECT *, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), ' start') AS u, CASE WHEN i = 2 THEN ' start' ELSE lag(w, 2) OVER (PARTITION BY r ORDER BY i) END AS t FROM t
), one AS (
  SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w
), contexts AS (
  SELECT w AS u, c FROM one UNION ALL SELECT ' start', count(*) FROM d WHERE NOT held_out
), two AS (
  SELECT u, w, count(*) AS c FROM g WHERE NOT held_out GROUP BY u, w
), three AS (
  SELECT t, u, w, count(*) AS c FROM g WHERE NOT held_out AND t IS NOT NULL GROUP BY t, u, w
), total AS (
  SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM one
), p AS (
  SELECT g.r, coalesce(one.c, 0) > 0 AS known, g.t, (coalesce(one.c, 0) + 1) / CAST(n + v + 1 AS DOUBLE) AS p1, coalesce(two.c, 0) AS c2, coalesce(x.c, 0) AS cu, coalesce(three.c, 0) AS c3, coalesce(y.c, 0) AS ctu
  FROM g CROSS JOIN total LEFT JOIN one ON one.w = g.w LEFT JOIN two ON two.u = g.u AND two.w = g.w LEFT JOIN contexts x ON x.u = g.u
  LEFT JOIN three ON three.t = g.t AND three.u = g.u AND three.w = g.w LEFT JOIN two y ON y.u = g.t AND y.w = g.u
), q AS (
  SELECT *, (c2 + {backoff_lm.MU} * p1) / (cu + {backoff_lm.MU}) AS p2 FROM p
), s AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, sum(log10(p1)) AS base_score,
         sum(log10(CASE WHEN t IS NULL THEN p2 ELSE (c3 + {backoff_lm.MU} * p2) / (ctu + {backoff_lm.MU}) END)) AS score
  FROM q GROUP BY r
)
SELECT doc_id, held_out, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_known AS BIGINT) AS n_known, CAST(n AS BIGINT) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM d JOIN s USING (r) CROSS JOIN total
"""

#: Words q apart that are identical in stretches; a run's stretch holds at least six, so groups of six are joined.
OP11_SQL = f"""
WITH a AS (
  SELECT row_number() OVER () AS r, doc_id, CAST({CRC.format("CAST(doc_id AS VARCHAR)")} AS BIGINT) AS h, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents
), b AS (
  SELECT *, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM a
), d AS (
  SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM b
), t AS (
  SELECT r, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d
), six AS (
  SELECT r, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o) AS s FROM t WINDOW o AS (PARTITION BY r ORDER BY i)
), same AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM six x JOIN six y ON x.r = y.r AND x.s = y.s AND x.i < y.i WHERE x.i <= x.n - 6 AND y.i <= y.n - 6
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + 5 AS same FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island
), runs AS (
  SELECT r, start, same + q AS length, min(q) AS period FROM stretches WHERE same >= greatest(12 - q, q) GROUP BY r, start, same + q
), of_text AS (
  SELECT r, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, max(length) AS length, arg_min(period, (-length, start, period)) AS period,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs
  FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN of_text USING (r) LEFT JOIN kept USING (r)
"""

TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {TERMS}) AS w FROM documents
), total AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d
), items AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all({LOWER}, {TERMS})) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT i, item_id, unnest(w) AS t FROM items
), held AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY t, n_docs
), impacts AS (
  SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)) AS x FROM held, total
), scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * x) AS BIGINT) AS score FROM asked JOIN weights USING (t) JOIN impacts USING (t) GROUP BY ALL
), ranks AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranks WHERE rank <= 10
"""

ORACLE_SQL = {"op1_mixing": OP1_SQL, "op5_top_k": OP5_SQL, "op7_near_dedup": OP7_SQL, "op9_lm_scoring": OP9_SQL, "op11_word_runs": OP11_SQL, "op12_ranked_search": OP12_SQL}
