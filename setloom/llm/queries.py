"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm import chat, embedding, html, langid, media, mixing, packing, sharding, simhash, tokens
from setloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(table(spark, sf_dir, "conversations"), chat.LINE_TOOL, chat.line_events)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.dictionaries(docs), keep=["doc_id"])
    held = F.coalesce(langid.held_out("doc_id"), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_sharding, op3_simhash, op4_packing, op5_embedding_dedup, op6_html, op7_chat, op8_mixing, op9_language_id, op10_media, pipeline)
}

ORACLE: dict[str, str] = {}

ORACLE["op2_sharding"] = f"""
WITH RECURSIVE names AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS shard FROM range({sharding.SHARDS}) t(i)
), hashed AS (
  SELECT i, ('0x' || substr(md5(shard), 1, 8))::BIGINT % {sharding.SLOTS} AS o,
    ('0x' || substr(md5(shard), 9, 8))::BIGINT % {sharding.SLOTS - 1} + 1 AS k FROM names
), lists AS (SELECT list(o ORDER BY i) AS os, list(k ORDER BY i) AS ks FROM hashed),
fill AS (
  SELECT 0 AS turn, list_transform(range({sharding.SLOTS}), lambda x: -1) AS owner FROM lists
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, p: CASE WHEN p - 1 = s THEN turn % {sharding.SHARDS} ELSE x END)
  FROM (SELECT turn, owner, list_filter(
      list_transform(range({sharding.SLOTS}), lambda j: (os[turn % {sharding.SHARDS} + 1] + j * ks[turn % {sharding.SHARDS} + 1]) % {sharding.SLOTS}),
      lambda q: owner[q + 1] = -1)[1] AS s
    FROM fill, lists WHERE turn < {sharding.SLOTS})
), owners AS (
  SELECT unnest(range({sharding.SLOTS})) AS slot, unnest(owner) AS i FROM fill WHERE turn = {sharding.SLOTS}
), keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents
)
SELECT doc_id, slot, shard FROM keyed JOIN owners USING (slot) JOIN names USING (i)
"""

ORACLE["op5_embedding_dedup"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {embedding.COSINE}
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
FROM v
"""

ORACLE["op7_chat"] = r"""
WITH m AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
calls AS (SELECT conv_id, turn, unnest(lines) AS line, unnest(range(len(lines)))::INTEGER AS position FROM m WHERE role = 'user'),
asked AS (
  SELECT *, turn || ':' || position AS call_id, len(regexp_extract_all(line, '[^ \t\r\x0b\x0c]+')) AS words FROM calls
), given AS (
  SELECT conv_id, call_id, min({'t': turn, 'i': i, 'c': to_json(line)::VARCHAR}) AS r
  FROM (SELECT conv_id, turn, (turn - 1) || ':' || i AS call_id, i, line FROM (SELECT conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM m WHERE role = 'assistant'))
  GROUP BY ALL
), both_sides AS (
  SELECT coalesce(a.conv_id, g.conv_id) AS conv_id, coalesce(a.turn, g.r.t) AS turn, coalesce(a.call_id, g.call_id) AS call_id, position, line, words, g.r.c AS content,
    CASE WHEN line IS NULL THEN NULL WHEN length(line) < 1 OR length(line) > 4000 THEN '$.line: length' WHEN words < 1 OR words > 40 THEN '$.words: out of range' END AS error
  FROM asked a FULL JOIN given g ON a.conv_id = g.conv_id AND a.call_id = g.call_id
)
SELECT conv_id, turn, call_id, position,
  CASE WHEN line IS NULL THEN 'orphan' WHEN content IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  line IS NOT NULL AND error IS NULL AS valid, error,
  CASE WHEN line IS NULL THEN '{"id":"' || call_id || '","result":' || content || '}'
    ELSE '{"arguments":{"line":' || to_json(line)::VARCHAR || ',"words":' || words || '},"id":"' || call_id || '","name":"reply_line","result":' || coalesce(content, 'null') || '}' END AS json
FROM both_sides
"""

ORACLE["op8_mixing"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, greatest(octet_length(encode(coalesce(text, ''))), 1)::BIGINT AS bytes,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS digest FROM documents
), streamed AS (
  SELECT *, coalesce(sum(bytes) OVER (PARTITION BY src ORDER BY ('0x' || substr(digest, 1, 8))::BIGINT, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), sizes AS (SELECT src, sum(bytes)::BIGINT AS total FROM d GROUP BY src),
shared AS (
  SELECT src, total, greatest(floor(w / sum(w) OVER () * {mixing.PERIOD})::BIGINT, 1) AS a, row_number() OVER (ORDER BY src) AS i
  FROM (SELECT *, pow(total::DOUBLE, {mixing.TEMPER}) AS w FROM sizes)
), lists AS (SELECT list(a ORDER BY i) AS al, sum(a)::BIGINT AS period FROM shared),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(al, lambda x: 0::BIGINT) AS nxt, NULL::BIGINT AS pick FROM lists
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda n, p: CASE WHEN p = chosen THEN n + 1 ELSE n END), chosen
  FROM (SELECT t, nxt, list_min(list_filter(list_transform(al, lambda a, p: CASE WHEN nxt[p] * period // a <= t
      THEN {{'d': ((nxt[p] + 1) * period + a - 1) // a, 'i': p}} END), lambda x: x IS NOT NULL)).i AS chosen
    FROM edf, lists WHERE t < period)
), taken AS (SELECT pick AS i, list(t - 1 ORDER BY t) AS slots FROM edf WHERE pick IS NOT NULL GROUP BY pick),
planned AS (
  SELECT src, a, period, slots, (total + {mixing.BLOCK_BYTES - 1}) // {mixing.BLOCK_BYTES} AS blocks FROM shared JOIN taken USING (i), lists
), ended AS (SELECT *, max((blocks - 1) // a * period + slots[(blocks - 1) % a + 1] + 1) OVER () AS finish FROM planned),
placed AS (SELECT *, finish // period * a + len(list_filter(slots, lambda x: x < finish % period)) AS placed FROM ended),
every AS (
  SELECT doc_id, source, a, period, slots, blocks, start // {mixing.BLOCK_BYTES} AS b, unnest(range((placed - 1 - start // {mixing.BLOCK_BYTES}) // blocks + 1)) AS epoch
  FROM streamed JOIN placed USING (src)
)
SELECT doc_id, source, epoch::BIGINT AS epoch, (epoch * blocks + b)::BIGINT AS block,
  ((epoch * blocks + b) // a * period + slots[(epoch * blocks + b) % a + 1])::BIGINT AS slot FROM every
"""
