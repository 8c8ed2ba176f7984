"""Near-duplicates, packing, neighbours, language model, toxicity and the pipeline against brute force."""

import collections
import functools
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sievelight.llm import bin_packing, katz, neighbours, packing, simhash, toxicity
from sievelight.llm.tokenizing import WordTokenizer
from sievelight.operators.components import connected_components

LOW = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def slow_fingerprint(text):
    w = words_of(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in (None, "", " ", "One", "a b c", "a b c d", "A b c d e É " * 20, "x " * 500):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def groups(values, linked):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("bucket", [2000, 33])
def test_ball_hashing_loses_no_link(spark, bucket):
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    expected = groups(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=bucket)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got.get(f, f) == expected[f] for f in fps)


def test_near_duplicate_table(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank today " * 8
    docs = [(5, base), (3, base.upper()), (9, base.replace("today", "tonight", 1)), (7, None), (8, "  "), (2, "something else entirely is written in this one"), (3, base), (None, "odd")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.components(df).collect()}
    by_id = {i: c for (i, _), c in got.items()}
    assert by_id[5] == by_id[3] == 3 and by_id[7] == by_id[8] == 7 and by_id[2] == 2
    kept = sorted(r.doc_id for r in simhash.keep_one(df.where("doc_id is not null")).collect())
    assert set(kept) <= {2, 3, 7, 9} and {2, 3, 7} <= set(kept)
    assert simhash.components(df.limit(0)).count() == 0


def test_hot_class_is_joined_by_salt(spark):
    rows = [(i, "same words in every one of these documents here") for i in range(1500)] + [(2000, "another text of its own")]
    out = simhash.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == 1501 and {(r.component_id, r["count"]) for r in out.groupBy("component_id").count().collect()} == {(0, 1500), (2000, 1)}


def check_packing(counts, capacity, packed):
    used = collections.Counter()
    for bins, pattern in packed:
        assert bins > 0 and sum(n * k for n, k in pattern) <= capacity
        for n, k in pattern:
            used[n] += bins * k
    assert used == collections.Counter({n: c for n, c in counts.items() if c})


def optimal(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, bins + [items[i]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(120):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = dict(collections.Counter(items))
        packed = bin_packing.pack(counts, 20)
        check_packing(counts, 20, packed)
        n = sum(b for b, _ in packed)
        assert bin_packing.lower_bound(counts, 20) <= optimal(items, 20) <= n <= sum(b for b, _ in bin_packing.best_fit_decreasing(counts, 20))
        assert n == optimal(items, 20)
    assert bin_packing.pack({}, 10) == []


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_bin_completion_fills_triplets(seed):
    rng = random.Random(seed)
    items = []
    for _ in range(20):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        items += [a, b, 1000 - a - b]
    counts = dict(collections.Counter(items))
    found = bin_packing.solve(counts, 1000)
    check_packing(counts, 1000, found.packing)
    assert sum(b for b, _ in bin_packing.best_fit_decreasing(counts, 1000)) > 20 == found.bins and found.proven


def test_packing_search_can_be_stopped():
    counts = {n: 1 for n in range(100, 2000, 7)}
    found = bin_packing.solve(counts, 4096, 0.0)
    check_packing(counts, 4096, found.packing)
    assert found.proven == (found.bins == found.bound)
    assert bin_packing.solve({n: 3 for n in range(1, 4097)}, 4096, 5.0).bins >= bin_packing.lower_bound({n: 3 for n in range(1, 4097)}, 4096)


def test_packing_search_holds_what_is_left_once():
    """Copies of the histogram at each step of the way down took a gigabyte of the driver."""
    counts = {n: 3 for n in range(700, 3000)}
    tracemalloc.start()
    try:
        found = bin_packing.solve(counts, 4096, 6.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    check_packing(counts, 4096, found.packing)
    assert peak < 40e6


def test_packing_search_begins_again_where_it_gave_up(monkeypatch):
    """Exact although no enumeration is kept and no rest remembered."""
    monkeypatch.setattr(bin_packing, "OPEN", 1)
    monkeypatch.setattr(bin_packing, "REMEMBERED", 0)
    generator = np.random.default_rng(11)
    for _ in range(60):
        items = generator.integers(2, 13, int(generator.integers(1, 9))).tolist()
        counts = {n: items.count(n) for n in items}
        packed = bin_packing.pack(counts, 20)
        check_packing(counts, 20, packed)
        assert sum(b for b, _ in packed) == optimal(items, 20)


def test_sequences_pass_all_columns_on(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4, 5, 6)] * 3, "length long, rank int, _row int, _at int, _salts int, offset int")
    out = packing.sequences(rows, 10).collect()
    assert len(out) == 3 and all((r["rank"], r["_row"], r["_at"], r["_salts"]) == (2, 3, 4, 5) for r in out) and sorted(r.offset for r in out) == [0, 1, 2]


def test_other_vocabularies_go_to_the_library():
    P = pytest.importorskip("public_tokenizers")
    own = WordTokenizer(P.path("byte_bpe_50k.json"))
    assert own.ids("Hello world").tolist() == own.tokenizer.encode("Hello world", add_special_tokens=False).ids


def test_sequences_are_gapless(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([100] * 5 + list(range(1, 100)))) for i in range(900)]
    out = packing.sequences(spark.createDataFrame(rows, "doc_id long, length long"), 100).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 100
    assert sorted((r.doc_id, r.length) for r in out) == sorted(rows)
    assert packing.sequences(spark.createDataFrame([], "doc_id long, length long"), 100).count() == 0


def test_word_tokenizer_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    own = WordTokenizer(P.path("word_bpe_49k.json"))
    odd = ["", "Áb ́c d e\x85f\x1cg", "ΑΣ Σ", "it's we'LL <|endoftext|> x", "İstanbul 12a3 !!?? ", "ﬁ ǅ é́", "é, …, x…, ≠ a≠ 1, ²! Ⅷ; x'; 's, ñ%%% ##", "a " * 3000, "x" * 5000]
    for _ in range(2):
        for text in odd:
            assert own.ids(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.ids(None).tolist() == []


def test_pieces(spark):
    P = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, None), (2, "a b c"), (3, "word " * 30), (3, "word " * 30)], "doc_id long, text string")
    out = packing.pack_documents(docs, P.path("word_bpe_49k.json"), capacity=16).collect()
    ids = np.array(WordTokenizer(P.path("word_bpe_49k.json")).ids("word " * 30).tolist() + [1], "<u4")
    three = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 3)
    assert three[::2] == three[1::2] == [(0, 0, 16, zlib.crc32(ids[:16].tobytes())), (1, 16, 15, zlib.crc32(ids[16:].tobytes()))]
    assert [(r.length, r.ids_crc32) for r in out if r.doc_id == 1] == [(1, zlib.crc32(b"\1\0\0\0"))]


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1, (400, 16)) for c in (-2, 0, 2)]).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(5000, rows[0][1]), (5100, rows[0][1]), (6000, None), (6100, [0.0] * 16), (6200, [1.0] * 15 + [float("nan")]), (6300, [1.0, None]), (6400, [1.0, 2.0])]
    got = neighbours.nearest_of_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    found = collections.defaultdict(dict)
    for r in got:
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    ids = np.array([i for i, v in rows if v and len(v) == 16 and not any(math.isnan(a) for a in v) and any(v)])
    points = np.array([dict(rows)[i] for i in ids.tolist()])
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = total = 0
    for q, ranked in found.items():
        d = np.sqrt(((points - points[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len({ids[i] for i in order} & {v for v, _ in ranked.values()})
        total += 10
        assert sorted(ranked) == list(range(1, 11))
        assert [s for _, (_, s) in sorted(ranked.items())] == sorted(s for _, s in ranked.values())
    assert hits / total >= 0.95
    assert [found[5000][r][0] for r in (1, 2)] == [0, 5100]
    assert neighbours.nearest_of_rows(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.lit(True)).count() == 6
    assert neighbours.nearest_of_rows(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


@pytest.mark.parametrize("noise", [1e-6])
def test_neighbours_of_nearly_equal_vectors(spark, noise):
    rng = np.random.default_rng(7)
    x = rng.normal(size=64)
    x = x / np.linalg.norm(x) + rng.normal(size=(3000, 64)) * noise
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest_of_rows(frame, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 3000, 100):
        near = np.argsort(((x - x[q]) ** 2).sum(1))[1:11]
        hits += len(set(near.tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.95 * 300


def _recall(spark, x, kind="double", every=100, **settings):
    frame = spark.createDataFrame([(i, [float(a) for a in v], "clash", i) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>, home string, u long")
    got = collections.defaultdict(set)
    for r in neighbours.nearest_of_rows(frame, F.col("vec_id") % every == 0, s=neighbours.Settings(**settings)).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(x), every):
        with np.errstate(over="ignore"):
            d = np.sqrt((((x - x[q]) / 2.0 ** max(0, int(np.frexp(np.abs(x[q]).max())[1]))) ** 2).sum(1))
        hits += len(set([i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]) & got[q])
    return hits / (10 * len(range(0, len(x), every)))


@pytest.mark.parametrize("name", ["small", "shifted", "outliers"])
def test_neighbours_at_every_scale(spark, name):
    x = np.random.default_rng(12).normal(size=(900, 12))
    x = {"small": x * 1e-9, "shifted": x + 1000, "outliers": np.concatenate([x, x[:3] * 1e300, -x[:2] * 1e-300])}[name]
    assert _recall(spark, x, group=300, home=300 * 12) >= 0.9


def test_neighbours_of_float_vectors_beyond_half_precision(spark):
    x = (np.random.default_rng(13).normal(size=(900, 12)) * 1e6).astype(np.float32)
    assert _recall(spark, x.astype(np.float64), "float", group=150, home=150 * 12, block=16, pairs=500) >= 0.9


def test_neighbours_repeated_ids_and_wide_ids(spark):
    far = 2**62
    rows = [(far + i, [float(i), 1.0]) for i in range(30)] + [(far + 3, [3.0, 1.0]), (far + 3, [9.0, 2.0])]
    got = neighbours.nearest_of_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == far, k=3).collect()
    assert {r.query_id for r in got} == {far} and [r.vec_id - far for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3]


def test_neighbours_end_settled_or_raise(spark):
    x = np.random.default_rng(9).normal(size=(600, 8))
    nodes = spark.createDataFrame([(i, v.tolist(), [i]) for i, v in enumerate(x)], "node long, vec array<double>, members array<long>")
    with pytest.raises(RuntimeError):
        neighbours.build_graph(nodes, neighbours.Settings(degree=4, group=16, home=400, rounds=1, settled=0.0))
    ring = spark.createDataFrame([(i, i % 3, [((i + 1) % 600, (i + 1) % 600 % 3, 1.0, False)]) for i in range(600)], "u long, at int, links array<struct<v:long,home:int,d:double,new:boolean>>")
    line = nodes.select("node", F.array(F.col("node").cast("double")).alias("vec"), "members", (F.col("node") % 3).cast("int").alias("home"))
    start = F.array(F.struct(F.col("node").alias("v"), "home"))
    asked = line.where("node = 300").select(F.lit(-1).cast("long").alias("query_id"), F.array(F.lit(305.0)).alias("vec"), start.alias("start"))
    found = neighbours.search(line, ring, asked, 3, neighbours.Settings(beam=2)).orderBy("rank").collect()
    assert [r.vec_id for r in found][0] == 305
    with pytest.raises(RuntimeError):
        neighbours.search(line, ring, asked, 3, neighbours.Settings(beam=2, steps=2))


def test_neighbours_search_runs_few_jobs_a_step(spark):
    """Each job leaves its plan, tasks and threads with the driver."""
    n = 400
    ring = spark.createDataFrame([(i, i % 3, [((i + 1) % n, (i + 1) % n % 3, 1.0, False)]) for i in range(n)], "u long, at int, links array<struct<v:long,home:int,d:double,new:boolean>>")
    line = spark.createDataFrame([(i, [float(i)], [i], i % 3) for i in range(n)], "node long, vec array<double>, members array<long>, home int")
    asked = line.where("node = 300").select(F.lit(-1).cast("long").alias("query_id"), F.array(F.lit(303.2)).alias("vec"), F.array(F.struct(F.col("node").alias("v"), "home")).alias("start"))
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    found = neighbours.search(line, ring, asked, 2, neighbours.Settings(beam=2)).orderBy("rank").collect()
    assert jobs() - before <= 85
    assert [(r.vec_id, round(r.score, 6)) for r in found] == [(303, 0.2), (304, 0.8)]


def test_neighbours_parts_of_a_home_without_queries(spark):
    """A home's pairs are dealt by query; with fewer queries than parts some parts have none."""
    x = np.random.default_rng(15).normal(size=(600, 8))
    assert _recall(spark, x, every=300, pairs=20) >= 0.9


@pytest.mark.parametrize("scale", [1.0, 1e300, 1e-300])
def test_neighbour_distances_that_cancel(scale):
    rng = np.random.default_rng(8)
    x = np.concatenate([1 + rng.normal(size=(20, 8)) * 1e-9, [[-1e3] * 8]])
    assert np.allclose(neighbours._distances(x * scale) / scale, np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), rtol=1e-6, atol=0)
    mixed = np.concatenate([x, [[1e300] * 8]])
    assert np.allclose(neighbours._distances(mixed)[:21, :21], np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), rtol=1e-6, atol=0)


def slow_katz(texts, held, order):
    """The model in dictionaries of tuples: p(h, v) for a context h of any length."""
    tokens = [words_of(t) + [None] for t in texts]
    counts, contexts = [collections.Counter() for _ in range(order)], collections.Counter()
    for ws, h in zip(tokens, held):
        marked = ("<s>", *ws)
        for n in range(1, order + 1):
            for i in range(max(1, n - 1), len(marked)) if not h else ():
                counts[n - 1][marked[i - n + 1 : i + 1]] += 1
                contexts[marked[i - n + 1 : i]] += n > 1
    hist = lambda k: np.bincount([min(v, katz.K + 2) for v in k.values()] or [0], minlength=katz.K + 3)[: katz.K + 2]
    n1 = collections.Counter({w: c for (w,), c in counts[0].items()})
    words = katz.Words.of(sum(n1.values()), len(n1), hist(n1))
    discounts = [katz.Discounts.of(hist(c)).d for c in counts]

    def disc(n, r):
        return discounts[n][r] if r <= katz.K else 1.0

    followers = collections.defaultdict(list)
    for n, level in enumerate(counts):
        for gram, r in level.items():
            followers[gram[:-1]].append((gram[-1], r, disc(n, r)))

    @functools.cache
    def parts(h):
        left = sum(r * (1 - d) for _, r, d in followers[h])
        extra = left <= 0
        return contexts[h] + extra, (1.0 if extra else left) / (1 - sum(p(h[1:], v) for v, _, _ in followers[h]))

    def p(h, v):
        if not h:
            return float(words.p(np.array([n1[v]]))[0])
        if not contexts[h]:
            return p(h[1:], v)
        whole, free = parts(h)
        r = counts[len(h)][(*h, v)]
        return disc(len(h), r) * r / whole if r else free / whole * p(h[1:], v)

    return tokens, n1, p


@pytest.mark.parametrize("order,chunk,bucket", [(1, 40, 20), (2, 40, 20), (3, katz.CHUNK, katz.BUCKET), (3, 40, 20), (4, 200, 50)])
def test_katz_equals_brute_force_and_sums_to_one(spark, order, chunk, bucket):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [None, "", "only once", "same same same same same same same"] + [" ".join(rng.choice(vocabulary[: rng.choice([3, 30])]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    held = [i % 7 == 2 for i in range(len(texts))]
    tokens, n1, p = slow_katz(texts, held, order)
    total, distinct = sum(n1.values()), len(n1)
    docs = spark.createDataFrame([(i, t, h, "clash") for i, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, held_out boolean, chunk string")
    got = {r.doc_id: r for r in katz.score(docs, order=order, chunk=chunk, bucket=bucket).collect()}
    for i, ws in enumerate(tokens):
        assert got[i].n_tokens == len(ws) and got[i].n_known == sum(n1[w] > 0 for w in ws) and got[i].train_tokens == total
        marked = ("<s>", *ws)
        expected = sum(math.log10(p(marked[max(0, j - order + 1) : j] if order > 1 else (), marked[j])) for j in range(1, len(marked)))
        assert got[i].score == pytest.approx(expected, rel=1e-9)
        assert got[i].base_score == pytest.approx(sum(math.log10((n1[w] + 1) / (total + distinct + 1)) for w in ws), rel=1e-9)
    for h in [("<s>",), ("never seen",), ("<s>", "same"), ("same", "same"), ("w0", "w1"), ("w0", "w1", "w2"), *((w,) for w in vocabulary[:5])]:
        if len(h) < order:
            assert sum(p(h, v) for v in n1) + p(h, "no such word") == pytest.approx(1)


def test_katz_edges(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert katz.score(spark.createDataFrame([], schema)).count() == 0
    alone = katz.score(spark.createDataFrame([(1, "a b", True), (None, "a", None)], schema).where("doc_id = 1")).first()
    assert alone.train_tokens == 0 and alone.score == 0
    with pytest.raises(ValueError, match="order"):
        katz.score(spark.createDataFrame([], schema), order=0)
    assert katz.score(spark.createDataFrame([(None, "a", None), (2, "a", False), (2, "a", False)], schema)).count() == 3


def test_katz_shuffles_once_and_keeps_no_spent_shuffles(spark):
    def shuffled():
        return set(re.findall(r"shuffle_\d+_\d+_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")))

    before = shuffled()
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d e{i % 3}", i % 7 == 2) for i in range(200)], "doc_id long, text string, held_out boolean")
    scored = katz.score(docs, chunk=40, bucket=20)
    for _ in range(50):  # they are deleted in the background
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == 200 and not any(t.name.startswith("katz_") for t in spark.catalog.listTables())


def test_katz_buckets_send_sums_only_to_who_backs_off():
    def message(words, seen):
        return katz._pack(*map(katz._narrow, (np.array([5]), np.array([len(words)]))), np.array(words, np.uint32), np.array(seen), np.ones(len(words), np.int64), np.zeros(1, np.int8), np.zeros(katz.K + 2, np.int64))

    # All know word 1 after context 5; the first chunk alone knows word 2, the last asks for one that nobody saw.
    asked = [message([1, 2], [9, 1]), message([1], [9]), message([1, 3], [9, 0])]
    count = katz._count_grams("2-grams", katz.Discounts((1.0, *[0.5] * katz.K)), True)
    rows = count(pd.DataFrame({"chunk": [0, 1, 2], "bucket": [0] * 3, "x": asked})).set_index("chunk")["x"]
    total, _, _, partial, *sums = katz._unpack(rows[0])
    assert total.tolist() == [27, 1] and partial.tolist() == [katz._KNOWN] and not any(map(len, sums))
    total, _, _, partial, *sums = katz._unpack(rows[1])
    assert total.tolist() == [27] and partial.tolist() == [katz._RARE] and not any(map(len, sums))
    total, _, _, partial, *sums = katz._unpack(rows[2])
    assert total.tolist() == [27, 0] and partial.tolist() == [katz._SUMS] and [x.tolist() for x in sums] == [[1], [0], [0], [0], [0], [1.0]]


def test_unique_as_numpy():
    rng = np.random.default_rng(3)
    for codes, most in [(rng.integers(0, 50, 400), 50), (rng.integers(0, 1 << 62, 40), 1 << 62), (np.zeros(0, np.int64), 0), (np.array([7, 7]), 7)]:
        values, inverse = katz._unique(codes, most)
        assert values.tolist() == np.unique(codes).tolist() and values[inverse].tolist() == codes.tolist()


def test_good_turing_discounts():
    d = katz.Discounts.of(np.array([0, 100, 40, 20, 12, 8, 6])).d
    assert all(0 < x < 1 for x in d[1:]) and d[1] == pytest.approx((2 * 40 / 100 - 0.36) / 0.64)
    assert all(0 < x < 1 for x in katz.Discounts.of(np.array([0, 10, 0, 0, 0, 0, 0])).d[1:])


def test_toxicity_held_out_and_misspelt(spark):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "ru", "ne") for b in ("ran", "del", "kos", "vim", "pet", "sul")]
    bad = ["worthless", "pathetic", "disgusting", "horrible"]
    def doc(i):
        ws = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        if i % 4 == 0:
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        return " ".join(ws)
    texts = [doc(i) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(300, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    y = [i % 4 == 0 for i in range(300, 400)]
    assert np.mean([(got[i] >= 0.3) == t for i, t in zip(range(300, 400), y)]) >= 0.95
    assert got[1000] == got[1001] and 0 <= got[1000] <= 1
    assert model.score("loran midel worthlesss takos") > model.score("loran midel takos")
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).score("x") < 0.01


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + rng.choice(["", " the", " of", " and", " to"]) for _ in range(n))
    texts = [make(120) for _ in range(12)]
    texts += [texts[0], "junk %%% " * 60, None, texts[1] + " call 97.51.17.173 now"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    at = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, "").write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert set(at.columns) == set(docs.columns)
    ids = lambda i: {r.doc_id for r in spark.read.parquet(f"{tmp_path}/{i}").collect()}
    assert set(range(12)) <= ids(0) and 14 not in ids(0)
    assert 12 not in ids(1) and set(range(2, 12)) <= ids(1)
    assert not [r for r in spark.read.parquet(f"{tmp_path}/2").collect() if "97.51.17.173" in r.text]
    assert set(at.columns) >= {"doc_id", "piece", "row", "sequence_id", "offset", "length"} and ids(4) == ids(3)
    packed = spark.read.parquet(f"{tmp_path}/4")
    assert packed.select("row", "piece").distinct().count() == packed.count()


def test_pipeline_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "packing" or sorted(out.columns) == sorted(docs.columns))


def slow_score(model, text):
    """The score from its definition: the worst of all passages by the mean weight of their subwords."""
    ws = [w for w in re.findall(r"[^\W_]+", (text or "").lower())]
    worst, s = None, model.settings
    for at in range(0, max(1, len(ws) - s.passage + s.stride), s.stride):
        weights = []
        for w in ws[at : at + s.passage]:
            marked = f"<{w}>"
            grams = [marked] + [marked[i : i + n] for n in range(3, 7) for i in range(len(marked) - n + 1) if n < len(marked)]
            weights += [float(model.weight[zlib.crc32(g.encode()) % s.buckets]) for g in grams]
        logit = model.bias + (sum(weights) / len(weights) if weights else 0.0)
        worst = logit if worst is None else max(worst, logit)
    return 1 / (1 + math.exp(-worst))


def test_toxicity_score_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "vile", "Vi1e!", "été", "x_y"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in enumerate(texts)] + [(0, texts[0] * 40, "again", 0.0)], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(i, float("vile" in t)) for i, t in enumerate(texts)] + [(0, None)], "doc_id long, toxic double")
    rows, _ = toxicity.sample(docs, labels, toxicity.Settings(), "doc_id", "text", "toxic")
    assert rows["_id"].is_unique and rows.loc[rows["_id"] == 0, "text"].tolist() == [texts[0]]
    model = toxicity.fit(docs, labels, toxicity.Settings(epochs=5))
    for r in toxicity.score(docs, model).collect():
        assert r.score == pytest.approx(slow_score(model, r.text), rel=1e-5)


def test_toxicity_gradient_by_differences():
    """One step of Adam moves each parameter by the sign of its gradient: the loss falls."""
    texts, labels = ["good word", "bad thing", "bad word bad", "other good"] * 3, [0, 1, 1, 0] * 3
    loss = lambda m: -sum(math.log(m.score(t) if y else 1 - m.score(t)) for t, y in zip(texts, labels))
    losses = [loss(toxicity.train(texts, labels, toxicity.Settings(epochs=e, buckets=512))) for e in (1, 5, 30)]
    assert losses[0] > losses[1] > losses[2]


def test_long_labelled_text_drops_no_other(spark):
    assert toxicity.fitting(np.array([3, 50, 4, 5]), 10).tolist() == [True, False, True, False]
    assert toxicity.fitting(np.array([50, 20, 30]), 10).tolist() == [False, True, False]
    texts = [(i, "word " * (500 if i < 2 else 4 + i)) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    rows, share = toxicity.sample(docs, labels, toxicity.Settings(most_chars=2400), "doc_id", "text", "toxic")
    assert set(rows["_id"]) == set(range(2, 20)) and share == 0.5
    rows, _ = toxicity.sample(docs.where("doc_id < 2"), labels, toxicity.Settings(most_chars=2400), "doc_id", "text", "toxic")
    assert set(rows["y"]) == {0, 1}


def sample_texts(n_words):
    rng = random.Random(5)
    made = ["".join(rng.choice("abcdefghij") for _ in range(24)) for _ in range(n_words)]
    return [" ".join(made[i : i + 50] + ["vile"] * (i // 50 % 2)) for i in range(0, n_words, 50)], [i // 50 % 2 for i in range(0, n_words, 50)]


def test_toxicity_training_holds_no_subwords():
    texts, y = sample_texts(10_000)  # 830,000 subwords, 6.6 MB as 64-bit numbers
    tracemalloc.start()
    try:
        toxicity.train(texts, y, toxicity.Settings(epochs=2, buckets=1 << 12))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12e6


def test_toxicity_training_by_blocks(monkeypatch):
    """Neither the blocks nor forgotten words make a difference; texts without words leave the share alone."""
    texts, y = sample_texts(600)
    texts, y, s = [None, *texts, "", texts[0], "x" * 400], [0, *y, 1, 1, 0], toxicity.Settings(epochs=4, buckets=512)
    whole = toxicity.train(texts, y, s)
    for name, value in (("BLOCK", 97), ("PASSAGES", 3), ("REMEMBER", 5)):
        monkeypatch.setattr(toxicity, name, value)
    parts = toxicity.train(texts, y, s)
    assert np.abs(whole.weight).max() > 0.1 and np.allclose(whole.weight, parts.weight, atol=1e-5) and whole.bias == pytest.approx(parts.bias)
    assert toxicity.train([None, "", "!", ""], [1, 0, 0, 0], s).score("any") == pytest.approx(0.25)
