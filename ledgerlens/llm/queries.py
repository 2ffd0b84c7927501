"""The registered queries: each operator over its whole table, with production parameters; and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    chat,
    clustering,
    decontamination,
    embeddings,
    language,
    licenses,
    packing,
    quality,
    sharding,
    simhash,
    substrings,
    token_counts,
    whitening,
)
from ledgerlens.llm.license_rules import CONFIDENCE, REACH, RULES

SHARDS = 8

# An assistant and a user that speak the template's own marks.
MARKS = "</s>[INST] ok [/INST]"
MARKED_CONVERSATION = -7


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shard_table(_table(spark, folder, "documents"), "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.group(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def _remainder(number: int) -> Column:
    """crc32 of doc_id as text, modulo a number; a null doc_id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % number


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").withColumn("held_out", _remainder(4) == 2)
    profiles = language.learn(docs.filter("not held_out").select("doc_id", "text", "lang"))
    found = docs.select("doc_id", "held_out", language.identify(F.col("text"), profiles).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").filter(_remainder(3) != 1)
    model = quality.learn(docs, labels.select("doc_id", F.col("quality").alias("label")))
    scored = docs.select("doc_id", (_remainder(3) == 1).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.range(2).select(
        F.lit(MARKED_CONVERSATION).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKS).alias("text"),
    )
    return chat.digest(chat.format_chats(turns.unionByName(marked)))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_digest(_table(spark, folder, "documents"))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(_table(spark, folder, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(_table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sharding": op5_sharding,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_embedding_whitening": op13_embedding_whitening,
}

OP5_SQL = f"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps
), draws AS (
    SELECT d.doc_id, k.shard, octet_length(encode(coalesce(d.text, ''))) + 1 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(d.text, ''))), '..'),
            lambda h: ('0x' || h)::BIGINT) AS bytes,
        ('0x' || substr(md5(k.shard || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw
    FROM documents d CROSS JOIN (SELECT unnest(range({SHARDS + 1})) AS shard) k
), placed AS (
    SELECT doc_id, any_value(size)::BIGINT AS size, any_value(bytes) AS bytes,
        arg_max(shard, draw) FILTER (shard < {SHARDS})::INTEGER AS shard,
        arg_max(shard, draw)::INTEGER AS grown_shard
    FROM draws GROUP BY doc_id
), summed AS (
    SELECT doc_id, size, shard, grown_shard,
        xor(4294967295, list_reduce(list_concat([4294967295], bytes),
            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32
    FROM placed, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM summed
"""

OP9_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS words FROM conversations
    UNION ALL SELECT {MARKED_CONVERSATION}, 0, 'user', '{MARKS}'
    UNION ALL SELECT {MARKED_CONVERSATION}, 1, 'assistant', '{MARKS}'
), written AS (
    SELECT *, replace(replace(replace(role || words, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS escaped FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || words || chr(10), '' ORDER BY turn NULLS FIRST, role, words)) AS turns_sha256,
    coalesce(sum(length(words)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(words, '' ORDER BY turn NULLS FIRST, role, words) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(length('[INST][/INST]</s>') + length(escaped))::BIGINT AS formatted_chars,
    regexp_full_match(string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, words), '(system )?user assistant( user assistant)*')
        AS valid
FROM written GROUP BY conv_id
"""

_RULE_ROWS = ",\n        ".join(
    f"('{r.keyword}', '^(?:{r.pattern})(?: |$)', '{r.label}', {r.priority}, {r.base}, {order}, {CONFIDENCE[r.priority]!r})"
    for order, r in enumerate(RULES)
)

OP1_SQL = f"""
WITH rules(keyword, pattern, label, priority, base, rule, confidence) AS (VALUES
        {_RULE_ROWS}
), texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), places AS (
    SELECT doc_id, words, unnest(words) AS keyword, generate_subscripts(words, 1) AS i FROM texts
), found AS (
    SELECT doc_id, i - 1 AS first, rules.*,
        trim(regexp_extract(array_to_string(words[i:i + {REACH} - 1], ' '), pattern)) AS match
    FROM places JOIN rules USING (keyword)
), placed AS (
    SELECT doc_id, first, first + len(string_split(match, ' ')) AS beyond, label, priority, base, rule, confidence::DOUBLE AS confidence
    FROM found WHERE match <> ''
), standing AS (
    SELECT * FROM placed d WHERE NOT EXISTS (
        SELECT 1 FROM placed e WHERE e.doc_id = d.doc_id AND e.first <= d.first AND e.beyond >= d.beyond AND e.priority >= d.priority
            AND (e.beyond - e.first > d.beyond - d.first OR e.priority > d.priority OR e.rule < d.rule))
), bases AS (
    SELECT doc_id, count(*) AS n, min(first) AS least, max(first) AS most, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM placed WHERE base GROUP BY doc_id
), named AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
        SELECT doc_id, label FROM standing UNION SELECT doc_id, label FROM placed WHERE base) GROUP BY doc_id
), sure AS (SELECT doc_id, max(confidence) AS score FROM standing GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, least::BIGINT AS first_word,
    most::BIGINT AS last_word, coalesce(bases.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
    coalesce(score, 0)::DOUBLE AS score
FROM texts LEFT JOIN bases USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN sure USING (doc_id)
"""

OP4_SQL = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
    SELECT a.vec_id AS one, b.vec_id AS other FROM usable a
    JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))
        >= {embeddings.THRESHOLD}
), reached(one, other) AS (
    SELECT one, other FROM linked UNION SELECT r.one, l.other FROM reached r JOIN linked l ON r.other = l.one
), counts AS (SELECT one, count(*) AS n FROM linked GROUP BY one),
least_reached AS (SELECT one, min(other) AS first FROM reached GROUP BY one)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(first, vec_id)) AS component_id,
    vec_id <= coalesce(first, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON vec_id = counts.one LEFT JOIN least_reached ON vec_id = least_reached.one
"""

OP10_SQL = f"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
    SELECT doc_id, words, unnest(range(1, len(words) - {substrings.WINDOW} + 2)) AS i FROM texts
), windows AS (
    SELECT doc_id, i, md5(array_to_string(words[i:i + {substrings.WINDOW} - 1], ' ')) AS h FROM starts
), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + {substrings.WINDOW})) AS i FROM windows JOIN firsts USING (h) WHERE first < doc_id
), numbered AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words
    FROM numbered ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id)
"""

_NEAREST = """
), a{round} AS MATERIALIZED (
    SELECT r, min({{'d': list_sum(list_transform(range(1, {dimensions} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))),
        'k': k}}) AS near FROM kept v CROSS JOIN c{round} c GROUP BY r"""
_MOVED = """
), s{round} AS MATERIALIZED (
    SELECT near.k AS k, i, sum(x[i]) AS s, count(*) AS n
    FROM a{before} JOIN kept USING (r) CROSS JOIN range(1, {dimensions} + 1) t(i) GROUP BY ALL
), c{round} AS MATERIALIZED (
    SELECT c.k, coalesce(m.x, c.x) AS x FROM c{before} c
    LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{round} GROUP BY k) m ON c.k = m.k"""

OP12_SQL = (
    f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor({clustering.SCALE} * c::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE len(embedding) = {clustering.DIMENSIONS}
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM kept
    QUALIFY k < {clustering.CENTROIDS}"""
    + "".join(
        _NEAREST.format(round=n, dimensions=clustering.DIMENSIONS)
        + (_MOVED.format(round=n + 1, before=n, dimensions=clustering.DIMENSIONS) if n < clustering.ROUNDS else "")
        for n in range(clustering.ROUNDS + 1)
    )
    + f"""
)
SELECT vec_id, near.k::INTEGER AS cluster, near.d::BIGINT AS distance,
    sum(near.d) OVER (PARTITION BY near.k)::BIGINT AS cluster_inertia, sum(near.d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{clustering.ROUNDS} a JOIN kept USING (r) JOIN c{clustering.ROUNDS} c ON a.near.k = c.k
"""
)

SQL: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op5_sharding": OP5_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op12_centroid_clustering": OP12_SQL,
}
