"""A corpus from several sources: clean, filter, deduplicate, cap, split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.functions import labels, text
from sievelight.operators import near_duplicates
from sievelight.storage import materialise


@dataclass(frozen=True)
class SourceSpec:
    """A named source: a class, an era, a reader that gives (row_ord, subject, body), and an optional cap."""

    name: str
    label: str
    modern: bool
    read: Callable[[SparkSession], DataFrame]
    cap: int | None = None
    noisy: bool = False


def gather(spark: SparkSession, sources: list[SourceSpec]) -> DataFrame:
    """All sources as one table, in their order."""
    each = [
        s.read(spark).select("row_ord", "subject", "body", F.lit(s.name).alias("source"), F.lit(i).alias("source_ord"), F.lit(s.label).alias("class"), F.lit(s.modern).alias("modern"), F.lit(s.noisy).alias("noisy"))
        for i, s in enumerate(sources)
    ]
    return reduce(DataFrame.unionByName, each)


def clean(rows: DataFrame, plain: bool = False) -> DataFrame:
    """Adds text, language, content hash and thread key."""
    normal = text.normalise_plain if plain else text.normalise
    body = text.visible_body(text.strip_format_artifacts(F.col("body")))
    cleaned = rows.withColumn("text", text.strip(F.regexp_replace(text.scrub_corpus_words(normal(F.col("subject"), body)), r"\s+", " ")))
    hashed = cleaned.withColumn("hash", text.content_hash(F.col("text")))
    return hashed.withColumn("language", text.detect_language(F.col("text"))).withColumn("group_key", text.group_key(F.col("subject"), F.col("hash")))


def status(rows: DataFrame, least_chars: int = 20) -> DataFrame:
    """Adds status, the first reason that holds: too_short, non_english, duplicate or kept. Only rows that pass the others
    can be a first copy."""
    passes = (F.length("text") >= least_chars) & (F.col("language") == "en")
    nth = F.row_number().over(Window.partitionBy("hash", passes).orderBy("source_ord", "row_ord"))
    return rows.withColumn("_n", nth).withColumn(
        "status", F.when(F.length("text") < least_chars, "too_short").when(F.col("language") != "en", "non_english").when(F.col("_n") > 1, "duplicate").otherwise("kept")
    ).drop("_n")


def source_stats(judged: DataFrame) -> DataFrame:
    """Per source: rows read and how many of each status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return judged.groupBy("source").agg(F.count("*").alias("read"), n("too_short"), n("non_english"), n("duplicate"), n("kept"))


def first_copies(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the first by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def seeded_cap(rows: DataFrame, cap: Column | int, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each group, drawn by a hash of seed and key."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order, key))
    return rows.withColumn("_n", nth).where(F.col("_n") <= cap).drop("_n")


def balanced_sample(rows: DataFrame, per_group: int, by: list[str], modern: str, key: str, seed: int = 11) -> DataFrame:
    """At most ``per_group`` rows of each group, modern ones first, otherwise drawn by a hash of seed and key."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(modern), order, key))
    return rows.withColumn("_n", nth).where(F.col("_n") <= per_group).drop("_n")


def capped_unless(rows: DataFrame, cap: int, by: list[str], scarce: Column, order: str) -> DataFrame:
    """The first ``cap`` rows of each group, and all that are ``scarce`` besides. Scarce rows take no places."""
    common = rows.where(~F.coalesce(scarce, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return common.withColumn("_n", nth).where(F.col("_n") <= cap).drop("_n").unionByName(rows.where(scarce))


def unknown_domains(domains: DataFrame, cache: DataFrame, key: str = "domain") -> DataFrame:
    """Distinct domains that no cache row answers."""
    return domains.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def campaign_groups(rows: DataFrame) -> DataFrame:
    """Rows whose group_key is that of their campaign: the smallest one of all kept rows that a subject or near-equal text
    joins. Rows that are not kept join nothing and keep their own."""
    rows = materialise(rows, "judged")
    kept = F.col("status") == "kept"
    keyed = rows.where(kept).select("source_ord", "row_ord", "text", "group_key", F.struct("source_ord", "row_ord").alias("_row"))
    found = near_duplicates.campaigns(keyed, "_row").select("source_ord", "row_ord", F.col("group_key").alias("_campaign"))
    joined = rows.join(found, ["source_ord", "row_ord"], "left")
    return joined.withColumn("group_key", F.when(kept, F.coalesce("_campaign", "group_key")).otherwise(F.col("group_key"))).select(*rows.columns)


def split(rows: DataFrame, group: str = "group_key", modern: str = "modern") -> DataFrame:
    """Adds split. Judged rows (with a status and text) are first grouped by campaign, so that each falls on one side."""
    if {"status", "text", "source_ord", "row_ord"} <= set(rows.columns) and group == "group_key":
        rows = campaign_groups(rows)
    return rows.withColumn("split", labels.split_of(F.col(group), F.col(modern)))


def counts_by(rows: DataFrame, by: list[str], pivot: str, values: list[str]) -> DataFrame:
    """A cross table with zeros filled in."""
    return rows.groupBy(*by).pivot(pivot, values).count().fillna(0, values)


def interleave(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Rows of all groups mixed in proportion: adds ``position``, by which to sort."""
    w = Window.partitionBy(group)
    return rows.withColumn("position", (F.row_number().over(w.orderBy(key)) - 1) / F.count("*").over(w))


def balance(rows: DataFrame, cap: int, label: str, modern: str, language: str, key: str, repeat: int) -> DataFrame:
    """Old rows capped per class; Arabic rows repeated."""
    old, new = rows.where(~F.col(modern)), rows.where(F.col(modern))
    kept = seeded_cap(old, cap, [label], key).union(new)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col(language) == "ar", repeat).otherwise(1))))


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumable job has yet to do."""
    return plan.join(done.select(key).distinct(), key, "left_anti")


def translated_splits(translations: DataFrame, originals: DataFrame) -> DataFrame:
    """A translation ``<id>-ar`` follows its original's split; without one it trains."""
    base = F.regexp_replace("id", "-ar$", "")
    o = originals.select(F.col("id").alias("_id"), F.col("split").alias("_split"))
    return translations.withColumn("_base", base).join(o, F.col("_base") == F.col("_id"), "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_base", "_id", "_split")
