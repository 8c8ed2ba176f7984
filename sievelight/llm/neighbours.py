"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors form one class, named by its smallest id; the graph is one of classes, so that a vector that a third of all
rows share is one node. NN-descent starts from neighbours within large groups, cut by hyperplanes halfway between pairs of
sampled nodes (``sample`` bounds these; a group that is too large is dealt by a hash). It then joins neighbours of neighbours:
around each node its neighbours in either direction meet, each pair with a new link is measured, and whoever comes nearer
than a node's farthest neighbour takes its place. Rounds end when few links change; bounds on rounds and steps raise.

What travels: every node has a *home*, a coarser cell of the first grouping. The nodes of one home are joined in one task, to which each
vector that they need is sent once, however many of them it is a neighbour of; links travel as ids. Nodes with very many
reverse links are split into blocks that each hold all forward links, so no task gathers a hub and no link is left out. A
search sends the vectors of a home and of the queries that reach it together once a step; a home that very many queries
reach is dealt over several tasks by query.

Scales: vectors travel in the precision of the table. Distances are computed in double precision on vectors scaled by the
largest component of their group and centred within it; pairs that cancel there are taken by differences, scaled pair by
pair. So nearly equal vectors are told apart, and neither tiny nor huge components (nor both in one table) under- or overflow.
Links of equal distance are kept by a hash of both ends, not by id, so that ties make no hubs.

A search keeps a beam of the nearest classes found for each query, expands those not expanded yet by all their links in
either direction, and ends when no beam changes. Queries that are rows of the table start at their own class and its
links, others at seeds spread over the table. Each class in the beam gives its smallest ids, as many as a result may hold.

Defined results: vectors that are null, zero or of another length than most, or that hold a null or non-finite
component, take no part, as queries or candidates. Ties go to the smaller id. A query never finds its own row. With fewer
candidates than asked for all that are found are returned. Ids are longs; of rows that share one the smallest vector counts. An empty
table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.storage import collect_spent, discard, materialise


@dataclass(frozen=True)
class Settings:
    degree: int = 28  # links of a node
    tables: int = 4  # groupings at the start
    group: int = 2048  # nodes in a group at the start
    home: int = 1 << 19  # vector components in a home
    sample: int = 4000
    block: int = 256  # reverse links of a node that meet in one task
    rounds: int = 100  # more raise
    settled: float = 0.02  # share of links that still change when rounds end
    beam: int = 256
    steps: int = 1000  # more raise
    pairs: int = 2_000_000  # of queries and nodes of one home that one task measures
    seed: int = 11


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part; vec is array<float> where the table has that, else array<double>."""
    kind = "array<float>" if rows.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("vec")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("vec")).where(F.col("vec_id").isNotNull() & fine)
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (lengths["n"] if lengths else -1))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """(node, vec, members): one row for equal vectors, with their ``ids`` smallest ids."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("_n") <= ids)
    grouped = ranked.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))  # at most ``ids`` rows each
    return grouped.select(F.get("members", F.lit(0)).alias("node"), "vec", F.array_distinct("members").alias("members"))


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of one group of ``key`` each, from batches sorted by it."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        keys = b[key].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if rest and rest[-1][key].iloc[-1] != keys[i]:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            if j > i:
                rest.append(b.iloc[i:j])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.concatenate(list(vectors)).reshape(len(vectors), -1).astype(np.float64)


def _apart(diff: np.ndarray) -> np.ndarray:
    """Lengths of the rows of ``diff``, each scaled by its own largest component."""
    most = np.abs(diff).max(axis=1, initial=0)
    scale = np.where(most > 0, most, 1)
    return most * np.sqrt(((diff / scale[:, None]) ** 2).sum(axis=1))


def _distances(x: np.ndarray) -> np.ndarray:
    """Distances of all pairs of rows; those that cancel in the centred products are taken by differences."""
    most = np.abs(x).max(initial=0)
    exponent = np.frexp(most)[1] + 1 if most > 0 else 0
    half = x / 2  # so that a difference is finite
    c = np.ldexp(x, -exponent)
    c = c - c.mean(0)
    square = (c * c).sum(1)
    both = square[:, None] + square[None, :]
    d = np.maximum(both - 2 * (c @ c.T), 0)
    i, j = np.nonzero(np.triu(d <= 1e-6 * both, 1))
    d = np.sqrt(d)
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        d[a, b] = d[b, a] = np.ldexp(_apart(half[a] - half[b]), 1 - exponent)
    np.fill_diagonal(d, 0)
    return np.ldexp(d, exponent)


def _per_key(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable:
    """A mapInPandas function that calls ``work`` with the rows of each ``key``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, "key"):
            yield work(rows)

    return each


def _by_key(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_per_key(work), schema)


LINKS = "u long, v long, home int, d double"


def _place(nodes: DataFrame, n: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(node, vec, members, home) and (key, node, home, vec): the nodes, and the groups at the start."""
    sampled = nodes.orderBy(F.xxhash64("node", F.lit(s.seed))).select("vec").limit(s.sample).toPandas()["vec"]
    bits = max(0, (n // s.group).bit_length())
    points = _matrix(sampled)
    points = np.ldexp(points, -int(np.frexp(np.abs(points).max())[1]))
    rng = np.random.default_rng(s.seed)
    planes = (points[rng.integers(len(points), size=s.tables * bits)] - points[rng.integers(len(points), size=s.tables * bits)]).T
    size = np.sqrt((planes**2).sum(0))
    planes = np.where(size > 0, planes / np.where(size > 0, size, 1), rng.normal(size=planes.shape))
    middle = np.median(_matrix(sampled) @ planes, axis=0)
    powers = (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(0, np.int64)

    @F.pandas_udf("array<long>")
    def signature(vec: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):  # a component near the largest double may overflow here; that is a side, too
            sides = (_matrix(vec) @ planes > middle).reshape(len(vec), s.tables, bits)
        return pd.Series(list((sides * powers).sum(axis=2).astype(np.int64)))

    celled = materialise(nodes.withColumn("cells", signature("vec")), "cells")
    def parts_of(cells: DataFrame, by: list[str], most: int, name: str) -> DataFrame:
        """How many parts the cells with over twice ``most`` nodes are dealt to: a row for each of these few."""
        return materialise(cells.groupBy(*by).count().where(F.col("count") > 2 * most).select(*by, F.ceil(F.col("count") / most).cast("int").alias("parts")), name)

    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    each = celled.select("node", "vec", F.posexplode("cells").alias("table", "cell"))
    large = parts_of(each, ["table", "cell"], s.group, "large")
    home = max(s.group // 16, s.home // points.shape[1])
    homes = celled.select("node", "vec", "members", F.get("cells", F.lit(0)).bitwiseAND((1 << max(0, (n // home).bit_length())) - 1).alias("cell"))
    placed = materialise(homes.join(parts_of(homes, ["cell"], home, "homes"), "cell", "left").select("node", "vec", "members", F.hash("cell", part).alias("home")), "nodes")
    dealt = each.join(large, ["table", "cell"], "left").withColumn("key", F.xxhash64("table", "cell", part))
    return placed, dealt.select("key", "node", "vec").join(placed.select("node", "home"), "node")


def _start(groups: DataFrame, s: Settings) -> DataFrame:
    """(u, v, home, d): the nearest of each node within its groups; home is that of v."""
    share = -(-s.degree // 2)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        ids, homes = rows["node"].to_numpy(), rows["home"].to_numpy()
        d = _distances(_matrix(rows["vec"]))
        np.fill_diagonal(d, np.inf)
        k = min(share, len(ids) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
        return pd.DataFrame({"u": np.repeat(ids, k), "v": ids[near].ravel(), "home": homes[near].ravel(), "d": np.take_along_axis(d, near, 1).ravel()})

    return _by_key(groups, work, LINKS)


def _state(links: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """(u, at, vec, worst, links): one row a node with its home and its ``degree`` nearest links; worst is null while there
    are fewer. All that is grouped here is grouped by the node, after one shuffle."""
    once = links.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"), F.first("home").alias("home"))
    kept = once.withColumn("_r", F.row_number().over(Window.partitionBy("u").orderBy("d", F.xxhash64("u", "v"), "v"))).where(F.col("_r") <= s.degree)
    rows = kept.groupBy("u").agg(F.collect_list(F.struct("v", "home", "d", "new")).alias("links"), F.when(F.count("*") >= s.degree, F.max("d")).alias("worst"))
    return materialise(rows.join(nodes.select(F.col("node").alias("u"), F.col("home").alias("at"), "vec"), "u"), "graph")


def _members(state: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(key, centre, fresh, known): the neighbours of the nodes in either direction, by whether their link is new, where any
    is; key names the centre's home and a block of its reverse neighbours. And a table behind it."""
    split = lambda links, of: [F.transform(F.filter(links, lambda x: x["new"] == new), of).alias(name) for name, new in (("fresh", True), ("known", False))]
    forward = state.select(F.col("u").alias("centre"), "at", *split("links", lambda x: x["v"]))
    reverse = state.select(F.explode("links").alias("l"), F.col("u").alias("id")).select(F.col("l.v").alias("centre"), "id", F.col("l.new").alias("new"))
    # For every centre, so that the plan is one with or without hubs.
    blocks = materialise(reverse.groupBy("centre").count().select("centre", F.ceil(F.col("count") / s.block).cast("int").alias("blocks")), "blocks")
    dealt = reverse.join(blocks, "centre")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # A block holds about ``block`` reverse links; all of its centre's forward links come to each.
    grouped = dealt.groupBy("centre", block.alias("block")).agg(F.collect_list(F.when(F.col("new"), F.col("id"))).alias("r_fresh"), F.collect_list(F.when(~F.col("new"), F.col("id"))).alias("r_known"))
    none = F.array().cast("array<long>")
    both = forward.join(grouped, "centre", "left").select("centre", "at", F.coalesce("block", F.lit(0)).alias("block"), *(F.concat(c, F.coalesce(f"r_{c}", none)).alias(c) for c in ("fresh", "known")))
    return materialise(both.where(F.size("fresh") > 0).select(F.xxhash64("at", "block").alias("key"), "centre", "fresh", "known"), "members"), blocks


def _round(state: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """One round of NN-descent."""
    members, spent = _members(state, s)
    needed = members.select("key", F.explode(F.concat("fresh", "known")).alias("id")).distinct()
    points = needed.join(state.select(F.col("u").alias("id"), F.col("at").alias("home"), "vec", "worst"), "id")
    vector = state.schema["vec"].dataType.simpleString()
    none = F.array().cast("array<long>")
    # Empty arrays, not null ones: Arrow's writer takes a time for each null that grows with the batch.
    rows = members.select("key", F.lit(False).alias("point"), F.col("centre").alias("id"), "fresh", "known", F.lit(0).alias("home"), F.lit(0.0).alias("worst"), F.array().cast(vector).alias("vec"))
    rows = rows.union(points.select("key", F.lit(True), "id", none, none, "home", F.coalesce("worst", F.lit(float("inf"))), "vec"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        is_point = rows["point"].to_numpy(bool)
        known = rows[is_point]
        order = np.argsort(known["id"].to_numpy())
        ids, homes, worst = (known[c].to_numpy()[order] for c in ("id", "home", "worst"))
        x = _matrix(known["vec"])[order]
        met = rows[~is_point]
        lists = [*met["fresh"], *met["known"]]
        centre, new = np.tile(met["id"].to_numpy(), 2), np.repeat([True, False], len(met))
        many = [len(t) for t in lists]
        centre, at, new = np.repeat(centre, many), np.searchsorted(ids, np.concatenate(lists)), np.repeat(new, many)
        # A neighbour in both directions is met once, as new if either link is.
        order = np.lexsort((~new, at, centre))
        centre, at, new = centre[order], at[order], new[order]
        first = np.ones(len(at), bool)
        first[1:] = (centre[1:] != centre[:-1]) | (at[1:] != at[:-1])
        centre, at, new = centre[first], at[first], new[first]
        cuts = [0, *(np.flatnonzero(np.diff(centre)) + 1).tolist(), len(centre)]
        found: list[tuple] = []
        for i, j in zip(cuts, cuts[1:]):
            who, fresh = at[i:j], new[i:j]
            if len(who) < 2 or not fresh.any():
                continue
            d = _distances(x[who])
            np.fill_diagonal(d, np.inf)
            a, b = np.nonzero((fresh[:, None] | fresh[None, :]) & (d < worst[who][:, None]))
            found.append((who[a], who[b], d[a, b]))
        a, b, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        order = np.lexsort((b, a))
        a, b, d = a[order], b[order], d[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, d = a[first], b[first], d[first]
        order = np.lexsort((d, a))  # of each node the nearest, as many as it can keep
        a, b, d = a[order], b[order], d[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        few = rank < s.degree
        return pd.DataFrame({"u": ids[a[few]], "v": ids[b[few]], "home": homes[b[few]], "d": d[few]})

    found = _by_key(rows, work, LINKS)
    old = state.select("u", F.explode("links").alias("l")).select("u", "l.v", "l.home", "l.d", F.lit(False).alias("new"))
    after = _state(old.union(found.withColumn("new", F.lit(True))), nodes, s)
    discard(state, members, spent)
    return after


def build_graph(nodes: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph over ``nodes`` (node, vec, members): (node, vec, members, home), and (u, at, links) with
    ``degree`` links (v, home, d, new) a node, where at and home are the homes of either end."""
    n = nodes.count()
    if n < 2:
        return nodes.withColumn("home", F.lit(0)), nodes.select(F.col("node").alias("u"), F.lit(0).alias("at"), F.array().cast("array<struct<v:long,home:int,d:double,new:boolean>>").alias("links"))
    placed, groups = _place(nodes, n, s)
    state = _state(_start(groups, s).withColumn("new", F.lit(True)), placed, s)
    for _ in range(s.rounds):
        state = _round(state, placed, s)
        changed, links = state.agg(F.sum(F.size(F.filter("links", lambda x: x["new"]))), F.sum(F.size("links"))).first()
        if changed <= s.settled * links:
            return placed, state.select("u", "at", "links")
        collect_spent(state.sparkSession)
    raise RuntimeError(f"the graph did not settle in {s.rounds} rounds")


def _ways(graph: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(u, block, to): all links of each node in either direction, dealt to blocks; and (u, blocks) of the nodes with several."""
    pairs = graph.select("u", "at", F.explode("links").alias("l"))
    ends = pairs.select("u", F.col("l.v").alias("v"), F.col("l.home").alias("home")).union(pairs.select(F.col("l.v"), "u", "at")).distinct()
    hubs = materialise(ends.groupBy("u").count().where(F.col("count") > s.block).select("u", F.ceil(F.col("count") / s.block).cast("int").alias("blocks")), "hubs")
    dealt = ends.join(hubs, "u", "left").withColumn("block", F.pmod(F.xxhash64("v"), F.coalesce("blocks", F.lit(1))).cast("int"))
    return materialise(dealt.groupBy("u", "block").agg(F.collect_list(F.struct("v", "home")).alias("to")), "ways"), hubs


def _measured(pairs: DataFrame, nodes: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """(query_id, v, home, d) of ``pairs`` (query_id, home, vs, bound: a row for each home that a query reaches, with the nodes
    there) that are nearer than the bound, for queries ``asked`` (query_id, q); of each query the nearest in each task, as many
    as a beam holds."""
    pairs = materialise(pairs, "pairs")
    parts = pairs.groupBy("home").agg(F.ceil(F.sum(F.size("vs")) / s.pairs).cast("int").alias("parts"))
    parts = materialise(parts, "parts")  # a row a home
    part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")
    vector = nodes.schema["vec"].dataType.simpleString()
    queries = pairs.join(parts, "home").join(asked, "query_id").select(F.xxhash64("home", part).alias("key"), F.lit(False).alias("point"), F.col("query_id").alias("id"), "vs", "home", "bound", F.col("q").cast(vector).alias("vec"))
    points = nodes.join(parts, "home").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.xxhash64("home", "part").alias("key"), F.lit(True), "node", F.array().cast("array<long>"), "home", F.lit(0.0), "vec")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        is_point = rows["point"].to_numpy(bool)
        point, query = rows[is_point], rows[~is_point]
        if not len(query):  # no query was dealt to this part of the home
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), "home": np.zeros(0, np.int32), "d": np.zeros(0)})
        v, q = point["id"].to_numpy(), query["id"].to_numpy()
        by_v = np.argsort(v)
        x, y = _matrix(point["vec"])[by_v], _matrix(query["vec"])
        a, b = np.repeat(np.arange(len(q)), query["vs"].map(len)), np.searchsorted(v[by_v], np.concatenate(list(query["vs"])))
        d = np.empty(len(a))
        for at in range(0, len(a), 1 << 15):
            i = slice(at, at + (1 << 15))
            with np.errstate(over="ignore", under="ignore"):
                diff = y[a[i]] - x[b[i]]
                d[i] = np.sqrt((diff * diff).sum(1))
            odd = (d[i] < 1e-140) | (d[i] > 1e150)
            if odd.any():
                d[i][odd] = _apart(diff[odd])
        near = d < query["bound"].to_numpy()[a]
        a, b, d = a[near], b[near], d[near]
        order = np.lexsort((v[by_v][b], d, a))
        a, b, d = a[order], b[order], d[order]
        few = np.arange(len(a)) - np.searchsorted(a, a) < s.beam
        return pd.DataFrame({"query_id": q[a[few]], "v": v[by_v][b[few]], "home": np.full(few.sum(), point["home"].iloc[0]), "d": d[few]})

    return _by_key(queries.union(points), work, "query_id long, v long, home int, d double")


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (query_id, vec, start: array of struct<v,home> of nodes to start at),
    over what ``build_graph`` gave."""
    ways, hubs = _ways(graph, s)
    asked = queries.select("query_id", F.col("vec").alias("q"))
    of_query = Window.partitionBy("query_id")

    def best(beam: DataFrame) -> DataFrame:
        """The beam of each query; what is no nearer than ``bound``, the farthest of a full one, has no place in it."""
        once = beam.repartition("query_id").groupBy("query_id", "v").agg(F.first("home").alias("home"), F.min("d").alias("d"), F.max("done").alias("done"))
        kept = once.withColumn("_r", F.row_number().over(of_query.orderBy("d", "v"))).where(F.col("_r") <= s.beam).drop("_r")
        return materialise(kept.withColumn("bound", F.when(F.count("*").over(of_query) >= s.beam, F.max("d").over(of_query)).otherwise(float("inf"))), "beam")

    begin = queries.select("query_id", F.explode("start").alias("x")).groupBy("query_id", "x.home").agg(F.collect_set("x.v").alias("vs"), F.lit(float("inf")).alias("bound"))
    beam = best(_measured(begin, nodes, asked, s).withColumn("done", F.lit(False)))
    for _ in range(s.steps):
        open_ends = beam.where("not done")
        if open_ends.isEmpty():
            break
        opened = open_ends.select("query_id", "bound", F.col("v").alias("u")).join(hubs, "u", "left")
        opened = opened.select("query_id", "bound", "u", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
        reached = opened.join(ways, ["u", "block"]).select("query_id", "bound", F.explode("to").alias("x")).select("query_id", "x.home", "x.v", F.lit(None).cast("long").alias("had"), "bound")
        # A query that reaches one node by several ways asks for it once, and not for what its beam has.
        met = reached.union(beam.select("query_id", "home", F.lit(None).cast("long"), "v", "bound")).groupBy("query_id", "home")
        met = met.agg(F.collect_set("v").alias("vs"), F.collect_set("had").alias("had"), F.max("bound").alias("bound"))
        fresh = met.select("query_id", "home", F.array_except("vs", "had").alias("vs"), "bound").where(F.size("vs") > 0)
        before, beam = beam, best(beam.drop("bound").withColumn("done", F.lit(True)).union(_measured(fresh, nodes, asked, s).withColumn("done", F.lit(False))))
        discard(before)
        collect_spent(beam.sparkSession)
    else:
        raise RuntimeError(f"the search did not end in {s.steps} steps")
    found = beam.join(nodes.select(F.col("node").alias("v"), "members"), "v")
    each = found.select("query_id", F.explode("members").alias("vec_id"), F.col("d").alias("score")).where("vec_id != query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_rows(rows: DataFrame, is_query: Column, k: int = 10, s: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each row for which ``is_query`` (over the column vec_id) holds."""
    fine = materialise(usable(rows, vec_id, embedding), "usable")
    nodes, graph = build_graph(materialise(classes(fine, k + 1), "classes"), s)
    asked = fine.where(is_query)
    near = graph.select(F.col("u").alias("node"), F.transform("links", lambda x: F.struct(x["v"].alias("v"), x["home"].alias("home"))).alias("near"))
    own = F.array(F.struct(F.col("node").alias("v"), "home"))
    placed = asked.join(nodes.select("vec", "node", "home"), "vec").join(near, "node", "left").select(F.col("vec_id").alias("query_id"), "vec", F.concat(own, F.coalesce("near", F.array().cast(near.schema["near"].dataType))).alias("start"))
    return search(nodes, graph, materialise(placed, "queries"), k, s)
