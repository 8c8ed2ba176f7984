"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

1. Each document is tokenized whole, ended with ``END_ID`` and, only if it is longer than the capacity, cut into pieces.
2. The pieces' lengths are counted: at most ``capacity`` numbers, whatever the corpus. ``bin_packing`` turns them into
   patterns on the driver (best-fit incumbents, bin completion by branch and bound). The search is exact; ``seconds`` bounds
   it, and a packing that is not proven best is told by a warning with its bins and the lower bound.
3. Each piece gets a rank among the pieces of its length. The ranks are counted in salted groups, none larger than a
   quarter of a partition's share, whose sizes are summed up to offsets: a length that a third of all pieces have is
   spread like any other.
4. Length and rank name the pattern, the bin and the place in it by arithmetic on the pattern table.

Defined results: a null or empty text is its end token alone, one piece of length 1. Very long texts are cut into pieces of
exactly the capacity, the last one shorter. Repeated rows are packed once each. A null id is an id. An empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm import bin_packing
from sievelight.llm.texts import column_type
from sievelight.llm.tokenizing import word_tokenizer
from sievelight.storage import materialise

CAPACITY = 4096
END_ID = 1
#: How long the driver may look for a better packing than best-fit's, where that is above the lower bound; None: to the proof.
SEARCH_SECONDS = 60.0


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece, its ``ids`` (binary, little-endian u32) if asked for, and ``row``,
    a long column that tells rows of equal ids apart, if there is one."""
    end = np.array([end_id], "<u4")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_tokenizer(tokenizer).ids
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            many = []
            for name, t in zip(b["doc_id"], b["text"]):
                ids = np.concatenate((encode(t), end))
                many.append(-(-len(ids) // capacity))
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    for k, v in zip(out, (name, i, at, len(part) // 4, zlib.crc32(part), part)):
                        out[k].append(v)
            if not with_ids:
                del out["ids"]
            frame = pd.DataFrame(out)
            if row:
                frame["row"] = b["row"].to_numpy().repeat(many)
            frame["doc_id"] = frame["doc_id"].astype(b["doc_id"].dtype) if len(frame) else b["doc_id"][:0]
            yield frame

    schema = f"doc_id {column_type(docs, doc_id)}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", row long" * bool(row)
    extra = [F.col(row).cast("long").alias("row")] if row else []
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *extra).mapInPandas(each, schema)


class Placement:
    """Where the item of a given length and rank stands: arithmetic on a table with a row for each length of a pattern."""

    def __init__(self, packing: bin_packing.Packing):
        rows, taken, first = [], {}, 0
        for bins, pattern in packing:
            offset = 0
            for length, items in pattern:
                begin = taken.get(length, 0)
                rows.append((length, begin, items, first, offset))
                taken[length] = begin + bins * items
                offset += length * items
            first += bins
        self.bins = first
        self.length, self.begin, self.items, self.first, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.key = self.length << 42 | self.begin

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length << 42 | rank, side="right") - 1
        bin_no, slot = np.divmod(rank - self.begin[i], self.items[i])
        return self.first[i] + bin_no, self.offset[i] + slot * length


def _ranked(parts: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the rows of equal length. ``parts`` has a length, and a number of its own for each row in
    _row."""
    spark = parts.sparkSession
    share = max(64, sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = spark.createDataFrame([(n, -(-c // share)) for n, c in counts.items()], "length long, _salts long")  # at most ``capacity`` rows
    salted = parts.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))  # at most ``capacity`` rows and four a partition
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row"))
    return salted.join(F.broadcast(offsets), ["length", "_salt"]).withColumn("rank", F.col("_before") + within - 1).drop("_salts", "_salt", "_before")


def sequences(parts: DataFrame, capacity: int = CAPACITY, seconds: float | None = SEARCH_SECONDS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``; other columns are passed on,
    whatever their names, but these two, which are replaced."""
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    # The row travels as one column, so that no column of its own can clash with those used here.
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    rows = materialise(parts.select(F.col("length").cast("long").alias("length"), row, F.monotonically_increasing_id().alias("_row")), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not counts:
        return rows.select("row.*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    found = bin_packing.solve(counts, capacity, seconds)
    if not found.proven:
        warnings.warn(f"the packing has {found.bins} sequences, the lower bound is {found.bound}; more seconds may find a better one", stacklevel=2)
    place = Placement(found.packing)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = _ranked(rows, counts).withColumn("_at", placed("length", "rank"))
    return at.select("row.*", "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """The pieces of ``docs`` with their places: doc_id, piece, start, length, ids_crc32, (ids, row,) sequence_id, offset."""
    return sequences(pieces(docs, tokenizer, capacity, end_id, with_ids, doc_id, text, row), capacity)
