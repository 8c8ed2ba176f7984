"""Campaign clustering: MinHash signatures of sampled word shingles, banded, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text
from sievelight.operators.components import connected_components
from sievelight.storage import materialise

HASHES, BANDS, ROWS = 64, 16, 4
MOST_FREQUENT, LEAST_SHINGLES = 50, 3


def shingle_rows(docs: DataFrame, key: str = "row_id", column: str = "text", size: int = 5) -> DataFrame:
    """(key, shingle): the distinct sampled shingles (MD5) of each row."""
    return docs.select(key, F.explode(text.sampled_shingles(text.words(F.col(column)), size)).alias("shingle"))


def usable_shingles(rows: DataFrame, key: str = "row_id", most: int = MOST_FREQUENT, least: int = LEAST_SHINGLES) -> DataFrame:
    """Without shingles of over ``most`` rows, and without rows that then have under ``least``."""
    common = rows.groupBy("shingle").count().where(F.col("count") > most).select("shingle")
    rare = rows.join(common, "shingle", "left_anti")
    enough = rare.groupBy(key).count().where(F.col("count") >= least).select(key)
    return rare.join(enough, key, "left_semi")


def signatures(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, signature): the minimum of each of 64 seeded hashes; one aggregate with a map-side part."""
    mins = [F.min(F.xxhash64(F.lit(seed), F.col("shingle"))).alias(f"m{seed}") for seed in range(HASHES)]
    return rows.groupBy(key).agg(*mins).select(key, F.array(*(F.col(f"m{s}") for s in range(HASHES))).alias("signature"))


def band_edges(signed: DataFrame, key: str = "row_id") -> DataFrame:
    """(src, dst): each row linked to the smallest row of each of its band buckets, however large the bucket."""
    band = lambda b: F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("signature", b * ROWS + 1, ROWS)).alias("key"))
    each = signed.select(key, F.explode(F.array(*(band(b) for b in range(BANDS)))).alias("x")).select(key, "x.band", "x.key")
    least = each.groupBy("band", "key").agg(F.min(key).alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    return each.join(least, ["band", "key"]).where(F.col(key) != F.col("_least")).select(F.col("_least").alias("src"), F.col(key).alias("dst")).distinct()


def group_edges(docs: DataFrame, key: str = "row_id", group: str = "group_key") -> DataFrame:
    """(src, dst): each row linked to the smallest row of its group; a null group links nothing."""
    least = docs.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(key).alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    return docs.select(key, group).join(least, group).where(F.col(key) != F.col("_least")).select(F.col("_least").alias("src"), F.col(key).alias("dst"))


def cluster(docs: DataFrame, key: str = "row_id", column: str = "text", group: str | None = None) -> DataFrame:
    """(key, cluster): rows joined by a shared band, or by an equal ``group`` where one is named; the cluster is its
    smallest key, and a row alone is its own."""
    rows = materialise(shingle_rows(docs, key, column), "shingles")
    edges = band_edges(signatures(usable_shingles(rows, key), key), key)
    if group:
        edges = edges.union(group_edges(docs, key, group))
    linked = connected_components(edges).select(F.col("node").alias(key), F.col("component").alias("cluster"))
    return docs.select(key).join(linked, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def campaigns(docs: DataFrame, key: str = "row_id", column: str = "text", group: str = "group_key") -> DataFrame:
    """``docs`` with ``group`` replaced by the smallest one of all rows that a group or a band joins, so that a split by it
    keeps a campaign under several subjects on one side. ``key`` is unique."""
    found = docs.select(key, group).join(cluster(docs, key, column, group), key)
    # In the order of UTF-8 bytes, which is that of code points.
    smallest = found.groupBy("cluster").agg(F.min(group).alias("_campaign"))
    return docs.join(found.join(smallest, "cluster").select(key, "_campaign"), key).withColumn(group, F.col("_campaign")).drop("_campaign")


def containment(test: DataFrame, train: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, n_shingles, contained): the share of a test row's shingles that occur in training."""
    known = train.select("shingle").distinct().withColumn("hit", F.lit(1))
    joined = test.join(known, "shingle", "left")
    return joined.groupBy(key).agg(F.count("*").alias("n_shingles"), (F.count("hit") / F.count("*")).alias("contained"))


def novelty_bucket(n_shingles: str = "n_shingles", contained: str = "contained"):
    c = F.col(contained)
    return F.when(F.col(n_shingles) < 5, "too short").when(c < 0.5, "new").when(c < 0.8, "partly known").otherwise("near copy")
