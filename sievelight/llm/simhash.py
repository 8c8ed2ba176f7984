"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 if that bit is set in over half
of them. Fingerprints that differ in at most ``RADIUS`` = 4 bits are linked.

Two values at distance d share a variant that lies within half of d (rounded up) of either. A ball of radius 2 around a
64-bit fingerprint holds 2,081 variants, so shuffling whole balls would multiply the input. Instead the balls are drawn
around *halves*: of two linked fingerprints one 32-bit half differs in at most 2 bits, so that the two meet in a variant
within 1 bit of either half: 33 variants a half, 66 a fingerprint. Variants are shuffled, colliding pairs are verified
on all 64 bits. The result is the same, with no link lost.

A variant on which more than ``BUCKET`` fingerprints would meet is found beforehand from the counts of halves, and its
fingerprints go by whole balls of radius 2 instead: all that meet there lie within 4 bits of one another, so each is
linked to the smallest and no pairs are formed. Work and memory are thus bounded in every bucket.

Documents with equal fingerprints are one node throughout. Defined results: a null or empty text, or one without words,
has fingerprint zero and is linked like any other; fewer words than a shingle are one shingle; repeated shingles count
as often as they occur; a null id is kept as a member, but is no component's name unless it stands alone. An empty table
gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.texts import byte_words, column_type
from sievelight.operators.components import connected_components
from sievelight.storage import materialise

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Most fingerprints on one variant of a half that are compared pair by pair.
BUCKET = 2000
_SLICE = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())), np.uint64, len(words) - size + 1)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[i : i + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long of the same bits."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter(map(fingerprint, b["text"]), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(each, f"doc_id {column_type(docs, doc_id)}, fp long")


def _masks(bits: int, radius: int) -> list[int]:
    """XOR masks of all values within ``radius`` (1 or 2) of zero, as signed longs."""
    one = [1 << i for i in range(bits)]
    found = [0, *one] + ([a | b for i, a in enumerate(one) for b in one[i + 1 :]] if radius == 2 else [])
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _halves(fps: DataFrame) -> DataFrame:
    """(fp, side, half) twice a fingerprint."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("half")), F.struct(F.lit(1).alias("side"), high.alias("half")))).alias("x")).select("fp", "x.side", "x.half")


def _variants(halves: DataFrame) -> DataFrame:
    """Adds ``variant``: all values within one bit of ``half``."""
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(32, 1)))
    return halves.withColumn("mask", F.explode(masks)).withColumn("variant", F.col("half").bitwiseXOR(F.col("mask"))).drop("mask")


def _crowded(halves: DataFrame, bucket: int) -> DataFrame | None:
    """(side, variant) on which more than ``bucket`` fingerprints meet; None if there are none.

    One of the 33 halves around such a variant has at least a 33rd of them, so that only frequent halves need a look.
    """
    counts = halves.groupBy("side", "half").count()
    frequent = materialise(counts.where(F.col("count") > bucket // 33), "halves")
    if frequent.isEmpty():
        return None
    near = _variants(frequent.select("side", "half")).select("side", "variant").distinct()
    around = _variants(near.select("side", F.col("variant").alias("half"), F.col("variant").alias("centre")))
    sums = around.select("side", F.col("variant").alias("half"), "centre").join(counts, ["side", "half"]).groupBy("side", "centre").agg(F.sum("count").alias("n"))
    crowded = materialise(sums.where(F.col("n") > bucket).select("side", F.col("centre").alias("variant")), "crowded")
    return None if crowded.isEmpty() else crowded


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) edges between distinct fingerprints ``fps`` (column fp) that connect all that differ in ``radius`` bits
    at most. Every edge is a true link; within a bucket edges that follow from others are left out."""
    halves = _halves(fps)
    variants = _variants(halves)
    crowded = _crowded(halves, bucket)
    found = []
    if crowded is not None:
        members = variants.join(crowded, ["side", "variant"], "left_semi").select("fp").distinct()
        variants = variants.join(crowded, ["side", "variant"], "left_anti")
        masks = F.array(*(F.lit(m).cast("long") for m in _masks(64, 2)))
        balls = members.withColumn("mask", F.explode(masks)).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
        least = balls.groupBy("variant").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
        found.append(balls.join(least, "variant").where("fp != least").select(F.col("least").alias("src"), F.col("fp").alias("dst")).distinct())
    # A bucket's size is bounded by now.
    groups = variants.groupBy("side", "variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            src, dst = [], []
            for fps in b["fps"]:
                for x, y in spanning_forest(np.sort(np.asarray(fps, np.int64)), radius):
                    if (x, y) not in seen:
                        seen.add((x, y))
                        src.append(x)
                        dst.append(y)
            if len(seen) > 200_000:
                seen.clear()
            yield pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    found.append(groups.mapInPandas(forest, "src long, dst long").distinct())
    return found[0] if len(found) == 1 else found[0].union(found[1])


def spanning_forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A forest over ``fps`` (ascending) that joins just what pairs within ``radius`` join. Verifies pairs row by row."""
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(a, b)] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius else []
    left = fps
    edges = []
    while len(left) > 1:
        # Grow one tree from the first value that is left.
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count((left ^ front[0]).view(np.uint64)) <= radius
            got = left[near]
            edges += [(min(int(front[0]), int(g)), max(int(front[0]), int(g))) for g in got]
            left = left[~near]
            front = np.concatenate((front[1:], got))
    return edges


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, n_same): the smallest id that can be reached by links, the document's own included;
    n_same counts the documents of equal fingerprint."""
    marked = materialise(fingerprints(docs, doc_id, text), "simhash")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same")), "simhash_classes")
    edges = links(classes.select("fp"))
    linked = materialise(connected_components(edges), "simhash_components")
    named = linked.join(classes, linked["node"] == classes["fp"]).groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = linked.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    full = classes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n_same")
    return _join_classes(marked, full)


def _join_classes(marked: DataFrame, full: DataFrame, hot: int = 1000) -> DataFrame:
    """Joins documents to their classes. Classes with over ``hot`` documents number at most rows / hot; they are spread by
    a salt on both sides, the rest by the fingerprint alone."""
    salts = 64
    salted = full.withColumn("salt", F.explode(F.when(F.col("n_same") > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    hot_fps = full.where(F.col("n_same") > hot).select(F.col("fp").alias("hot_fp"))
    if hot_fps.isEmpty():
        return marked.join(full, "fp").select("doc_id", "fp", "component_id", "n_same")
    if hot_fps.count() <= 100_000:
        hot_fps = F.broadcast(hot_fps)
    flagged = marked.join(hot_fps, marked["fp"] == hot_fps["hot_fp"], "left") if isinstance(hot_fps, DataFrame) else marked
    spread = flagged.withColumn("salt", F.when(F.col("hot_fp").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("hot_fp")
    return spread.join(salted, ["fp", "salt"]).select("doc_id", "fp", "component_id", "n_same")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names its component: the smallest id of each group of near-duplicates.

    An id is taken to name one document: rows that share the id which names a group stay together.
    """
    firsts = components(docs, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(firsts, docs[doc_id].eqNullSafe(firsts["_first"]), "left_semi")
