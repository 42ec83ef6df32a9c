"""The registered queries of this subpackage: thin digests over each operator's own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pulsegrid.llm import media, mixing, pii, quality, sentencepiece_codec, sharding, substring_dedup, toxicity, topk_search
from pulsegrid.llm.ngram_join import ngram_join
from pulsegrid.llm.shared import documents


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = toxicity.screened(docs, _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_junk", "p_toxic", "toxic")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join(documents(spark, sf_dir), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM t),
u AS (SELECT DISTINCT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g) AS k FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.k + q.k - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.k::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir), length=35)


OP3_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35),
x AS (SELECT p.r, p.i, array_to_string(t.w[p.i:p.i + 34], ' ') AS s FROM p JOIN t USING (r)),
d AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY s) > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM d),
k AS (SELECT t.r, t.doc_id, t.w, list(g.j) AS gone FROM t LEFT JOIN g USING (r) GROUP BY ALL),
z AS (SELECT doc_id, len(w) AS n, len(list_filter(gone, lambda v: v IS NOT NULL)) AS m,
  list_filter(w, lambda v, i: NOT coalesce(list_contains(gone, i), false)) AS kept FROM k)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM z
"""


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_media(media.text_media(documents(spark, sf_dir)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP5_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(documents(spark, sf_dir), shards=8)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return found.select("doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), _read(spark, sf_dir, "labels"))


#: The mixture aimed at: languages and topics by share, all sources alike.
TARGETS = {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": {"0": 0.2, "1": 0.4, "2": 0.4}}
RATE, ROUNDS, SEED = 0.5, 15, 17


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(documents(spark, sf_dir), targets=TARGETS, rate=RATE, rounds=ROUNDS, seed=SEED, keep=("doc_id",))
    return found.select("doc_id", "m_words", "m_topic", F.round("m_p", 9).alias("m_p"), "m_kept")


def mixing_sql() -> str:
    share = lambda dim: "CASE " + " ".join(f"WHEN m_{dim} = '{k}' THEN {v}" for k, v in TARGETS[dim].items()) + f" ELSE {1 / len(TARGETS[dim])!r} END" if dim in TARGETS else "1.0"
    count = lambda i: f"len(t) - len(replace(t, '{i}', ''))"
    parts = [
        rf"w AS (SELECT doc_id, coalesce(source, '') AS m_source, coalesce(lang, '') AS m_lang, regexp_extract_all(coalesce(text, ''), '{mixing.WORD}') AS w FROM documents)",
        f"a AS (SELECT doc_id, m_source, m_lang, len(w) AS m_words, translate(array_to_string(list_transform(list_distinct(w), lambda x: substr(md5(x), 1, 1)), ''), '{mixing.BUCKETS}', '{mixing.CENTROIDS}') AS t FROM w)",
        f"b AS (SELECT doc_id, m_source, m_lang, m_words, CASE greatest({count(0)}, {count(1)}, {count(2)}) WHEN {count(0)} THEN '0' WHEN {count(1)} THEN '1' ELSE '2' END AS m_topic FROM a)",
        "c AS (SELECT m_source, m_lang, m_topic, sum(m_words)::DOUBLE AS total FROM b GROUP BY ALL HAVING sum(m_words) > 0)",
    ]
    for dim in ("source", "lang", "topic"):
        parts.append(f"t_{dim} AS MATERIALIZED (SELECT m_{dim}, a, s / sum(s) OVER () AS t FROM (SELECT m_{dim}, sum(total) AS a, any_value({share(dim)}) AS s FROM c GROUP BY 1))")
    least = " UNION ALL ".join(f"SELECT a / t AS x FROM t_{dim}" for dim in ("source", "lang", "topic"))
    levels = mixing.LEVELS
    parts.append(f"r AS MATERIALIZED (SELECT level, least({RATE}, coalesce(min(x) / (SELECT sum(total) FROM c), {RATE})) * ({levels} - level) / {levels} AS rate, (SELECT sum(total) FROM c) AS whole FROM ({least}), (SELECT unnest(range({levels})) AS level) GROUP BY level)")
    parts.append("f0 AS MATERIALIZED (SELECT c.*, r.*, t_source.t AS t_source, t_lang.t AS t_lang, t_topic.t AS t_topic, total * rate AS fit FROM c JOIN t_source USING (m_source) JOIN t_lang USING (m_lang) JOIN t_topic USING (m_topic), r)")
    n = 0
    for _ in range(ROUNDS):
        for dim in ("source", "lang", "topic"):
            parts.append(f"f{n + 1} AS MATERIALIZED (SELECT * REPLACE (least(total, fit * (t_{dim} * rate * whole) / sum(fit) OVER (PARTITION BY level, m_{dim})) AS fit) FROM f{n})")
            n += 1
    sums = " UNION ALL ".join(f"SELECT level, sum(fit) AS w, any_value(t_{dim}) AS t FROM f{n} GROUP BY level, m_{dim}" for dim in ("source", "lang", "topic"))
    parts.append(f"o AS (SELECT level, max(abs(w / s - t)) AS off FROM ({sums}) JOIN (SELECT level, sum(fit) AS s FROM f{n} GROUP BY level) USING (level) GROUP BY level)")
    parts.append(f"v AS MATERIALIZED (SELECT coalesce(min(level) FILTER (off < {mixing.TOLERANCE}), {levels - 1}) AS level FROM o)")
    parts.append("e AS MATERIALIZED (SELECT rate FROM r JOIN v USING (level))")
    parts.append(f"p AS (SELECT m_source, m_lang, m_topic, fit / total AS p FROM f{n} JOIN v USING (level))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, m_words::BIGINT AS m_words, m_topic, round(coalesce(p, rate, {RATE}), 9) AS m_p,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < coalesce(p, rate, {RATE}) AS m_kept
FROM b LEFT JOIN p USING (m_source, m_lang, m_topic), e"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_ngram_join, op3_substring_dedup, op4_media, op5_topk_search, op6_sentencepiece, op7_sharding, op8_pii, op9_quality, op10_mixing, pipeline)
    return {f.__name__: f for f in own}


def oracles() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_topk_search": OP5_SQL, "op10_mixing": mixing_sql()}
