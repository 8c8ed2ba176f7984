"""Mixing sources to target weights by Poisson replication.

A document of a source with mean repetition rate r is repeated k times, where k is the Poisson(r) quantile of a number in
[0, 1) that a hash of (seed, doc_id) gives: the same document always gets the same count, on any cluster and in any
order. Each copy gets a hash of (seed, doc_id, copy) as ``shuffle_key``; copies are dealt out by it and sorted by it in each
partition, so that every output file is a random sample of the mix and ``shuffle_key`` is one global random order.

Rates: source s of size z_s (code points of its texts, and one for each document's end) with target weight w_s gets
``r_s = budget * w_s / z_s``, the weights summing to 1. By default w_s is proportional to the square root of z_s (which
damps large sources) and the budget is the size of the input: one epoch in expectation.

Nothing is keyed by source but the small table of rates, so a source with a third of all rows costs no more than others.

Defined results: a null source is a source; one that ``weights`` does not name has weight 0 and drops out. Null and empty
texts count by their end alone. Rows that repeat an id get the same count and the same keys; a null id hashes as empty. An
empty table gives an empty result. All columns are passed on; ``copy``, ``repetition`` and ``shuffle_key`` are added, and
replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.storage import materialise

SEED = 42
#: Largest mean of one inversion; larger means are split into equal parts, whose counts add up.
MOST_MEAN = 500
#: A table of rates with more sources is joined by a shuffle, salted against hot sources.
BROADCAST_SOURCES = 100_000
_SALTS = 32
ADDED = ("copy", "repetition", "shuffle_key")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts joined by a colon."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def poisson_table(mean: Column) -> Column:
    """P(K <= 0), P(K <= 1), ... as an array<double>, far enough for any 52-bit number (mean up to MOST_MEAN)."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"),
    )
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, repetition) per source."""
    size = F.length(F.coalesce(F.col(text), F.lit(""))) + 1
    sizes = materialise(docs.groupBy(F.col(source).alias("source")).agg(F.sum(size.cast("long")).alias("size")), "sources")  # read three times
    if weights is None:
        weighted = sizes.withColumn("weight", F.sqrt("size"))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return weighted.select("source", "size", F.lit(0.0).alias("repetition"))
    spend = float(budget if budget is not None else total["size"])
    return weighted.select("source", "size", (F.lit(spend) * (F.col("weight") / F.lit(float(total["weight"]))) / F.col("size")).alias("repetition"))


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, seed: int = SEED,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """The copies of all documents, globally shuffled."""
    r = F.col("repetition")
    parts = F.greatest(F.ceil(r / MOST_MEAN), F.lit(1)).cast("int")
    table = rates(docs, weights, budget, source, text).select("source", "repetition", parts.alias("parts")).withColumn("cdf", poisson_table(r / F.col("parts")))
    table = table.select(F.col("source").alias("_source"), F.struct("repetition", "parts", "cdf").alias("_rate"))
    # The row travels as one column, so that no column of its own can clash with those used here.
    columns = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(source).alias("_key"), _id(F.col(doc_id)).alias("_id"))
    if table.count() <= BROADCAST_SOURCES:
        rated = rows.join(F.broadcast(table), F.col("_key").eqNullSafe(F.col("_source")))
    else:
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = rows.withColumn("_at", F.pmod(F.xxhash64("_id"), F.lit(_SALTS)).cast("int"))
        rated = salted.join(table, F.col("_key").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")))
    name = F.col("_id")
    units = F.transform(F.sequence(F.lit(0), F.col("_rate.parts") - 1), lambda j: unit_hash(F.lit(str(seed)), j.cast("string"), name))
    count = F.aggregate(units, F.lit(0), lambda n, u: n + F.size(F.filter("_rate.cdf", lambda c: c <= u)))
    counted = rated.withColumn("_n", count).where("_n > 0")
    copies = counted.select("row", "_id", F.col("_rate.repetition").alias("repetition"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:shuffle"), name, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    dealt = copies.withColumn("shuffle_key", key).select("row.*", *ADDED)
    return dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
