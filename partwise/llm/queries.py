"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm import bpe, chat, dedup, html, licences, lines, mixing, neighbours, quality, toxicity
from partwise.llm.common import remainder, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "kept")


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.filtered(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


@cache
def vocabulary(path: str) -> dict[bytes, int]:
    return bpe.read_ranks(path)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    space = quality.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), remainder("doc_id", 4) != 2)
    scored = quality.score(docs, space)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text")
    )
    return chat.digests(chat.messages(chat.log_of(turns.unionByName(more))))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "source", "block", "epoch", "slot", "release", "deadline", "nth", F.length("text").cast("long").alias("n_chars"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_line_frequency, op3_byte_bpe, op4_licences, op5_quality, op6_main_text, op7_toxicity, op8_chat, op9_mixture, op10_neighbours, pipeline)}

_SPACE = "[\\x20\\x09-\\x0D]"
#: Lines and hosts as in the operator; its parameters are 50, 0.02 and 0.5.
_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT uid, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT uid, i, concat_ws(chr(1), w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT uid, count(DISTINCT j) AS n_repeat_words FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY uid, g) AS c FROM g) WHERE c > 1) GROUP BY uid),
l AS (SELECT uid, source, t, line, len(list_filter(regexp_split_to_array(line, '{_SPACE}+'), lambda x: x <> '')) AS n FROM (SELECT uid, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '\\b[0-9]+\\b', '0', 'g'), '\\s+', ' ', 'g')) AS h FROM l WHERE n > 0),
dup AS (SELECT uid, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY uid),
size AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
above AS (SELECT source, h FROM k JOIN size USING (source) GROUP BY source, h, texts HAVING count(DISTINCT t) > 50 AND count(DISTINCT t) > 0.02 * texts),
gone AS (SELECT uid, sum(n) AS removed FROM k JOIN above USING (source, h) GROUP BY uid),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 CAST(coalesce(removed, 0) AS BIGINT) AS removed_words FROM d JOIN w USING (uid) LEFT JOIN r USING (uid) LEFT JOIN dup USING (uid) LEFT JOIN gone USING (uid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words FROM b"""
_OP8 = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN x ELSE '' END, '' ORDER BY turn, role, x)) AS loss_sha256,
 CAST(sum(length(x) + len(regexp_extract_all(x, '\\\\|</?s>|\\[/?(?:SYS|INST|TURN)')) + CASE role WHEN 'user' THEN 16 WHEN 'system' THEN 14 WHEN 'assistant' THEN 10 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
ORACLE_SQL: dict[str, str] = {"op2_line_frequency": _OP2, "op8_chat": _OP8}
