"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import chat_format, katz, mixing, neighbours, packing, pii, quality_rules, simhash, token_counts, toxicity
from sievelight.llm.texts import table

CONFLICT = "</s>[INST] ok [/INST]"


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_of_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "copy", "source", F.round("repetition", 9).alias("repetition"), "shuffle_key", "text")


OP2_SQL = """
with sizes as (select source, sum(length(coalesce(text, '')) + 1)::bigint as size from documents group by source),
total as (select sum(size) as size, sum(sqrt(size)) as weight from sizes),
rates as (select source, total.size::double * (sqrt(sizes.size) / weight) / sizes.size as rate from sizes, total),
cdf as (
    with recursive steps as (
        select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
        union all select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from steps where k < ceil(rate + 12 * sqrt(rate) + 20)
    ) select source, rate, list(c order by k) as cdf from steps group by source, rate
),
counted as (
    select d.*, rate, len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('42:0:' || doc_id), 1, 13))::bigint / 4503599627370496.0)) as n
    from documents d join cdf on cdf.source is not distinct from d.source
),
copies as (select *, unnest(range(n)) as copy from counted)
select doc_id, copy::integer as copy, source, round(rate, 9) as repetition,
    ('0x' || substr(md5('42:shuffle:' || doc_id || ':' || copy), 1, 15))::bigint as shuffle_key, text
from copies
"""

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = pii.protect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return safe.select("doc_id", "text", *map(of, pii.KINDS))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.components(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id", "n_same")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra)))


OP6_SQL = r"""
with source as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked as (
    select *, regexp_matches(text, '\[/?INST\]|</?s>|\[/?ROLE|\\[bolc]') or (role = 'user' and suffix(text, '[INST]'))
        or (role not in ('user', 'assistant') and suffix(text, '[ROLE')) as clash,
        length(text) + length(text) - length(translate(text, '\[<]', '')) as escaped_chars,
        case when role in ('user', 'assistant') then 0 else 2 * length(role) - length(translate(role, '\[<]', '')) end as role_chars
    from source
), sized as (
    select *, case when clash then escaped_chars else length(text) end
        + case role when 'user' then 15 when 'assistant' then 8 else 16 + role_chars end as chars from marked
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(chars)::bigint as formatted_chars, count(*) filter (where clash) as n_escaped
from sized group by conv_id
"""


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out"))
    return katz.score(docs)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"), "votes",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_chat_format": op6_chat_format,
    "op7_katz": op7_katz,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}
SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op6_chat_format": OP6_SQL,
}
