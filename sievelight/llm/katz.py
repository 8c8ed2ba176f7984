"""A Katz backoff language model over words, trained and evaluated at corpus scale.

Tokens are a text's words with A-Z lower-cased, then one end token. A token's context is the ``order - 1`` tokens before it,
or as many as there are behind a beginning mark. For a word v after a context h, h' being h without its first token::

    P(v | h) = d_r * c(h, v) / c(h)      if h, v was seen r = c(h, v) > 0 times in training
             = alpha(h) * P(v | h')      otherwise; alpha(h) = 1 for a context that was not seen
    P(v)     = d'_c * c(v) / N           for a word seen c times; unknown words share what the discounts leave

d are Good-Turing discounts for counts up to ``K``, from the counts of counts of each length; alpha(h) makes the probabilities
after h, the class of unknown words included, sum to one exactly. A context whose counts are all above K gives up one count,
and so do words if none is rare. Where the counts of counts do not allow this they are smoothed by a line in
logarithms first, and where some are missing an absolute discount takes its place.

How it runs: documents are encoded in chunks of about ``CHUNK`` tokens (word numbers of the chunk's own vocabulary), which
are written once, to a table bucketed by chunk. The answers to them are added to it: each is shuffled to its chunk once, and
later orders read chunks and answers together without a shuffle. A chunk sends its distinct words as packed arrays to hash buckets; each bucket adds the counts up, numbers
the words, and answers with the totals of what it was asked. Then the same for
pairs, triples and so on: an n-gram is the number of the shorter one that is its context and a word's number. So an n-gram is
shuffled once per chunk that has it, however frequent it is. What only one chunk asked for is its own: it counts what
followed, without asking, and sends the counts of counts alone. N-grams are dealt by their context, so that a bucket knows all
that followed it; a context with more than a bucket's share is dealt over several, and their few sums are added on the
driver. Buckets and chunks are bounded; their numbers grow with the corpus.

Defined results: a null or empty text is its end token alone. Very long texts stay whole in one chunk, of their own size.
Repeated rows are texts of their own. A null id is an id; a null ``held_out`` is in training. Without training rows all
tokens are unknown, with probability one. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from sievelight.llm.texts import byte_words, column_type
from sievelight.storage import Growing

K = 5
ORDER = 3
CHUNK = 1 << 21
BUCKET = 3 << 20
ZSTD = 3
#: The context of a text's first token, and what stands for an unknown word.
BEGIN, UNKNOWN = 0xFFFFFFFF, -1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any integer or float type as one compressed value."""
    parts = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        raw = np.ascontiguousarray(a)
        # Bytes of equal weight stand together: small numbers compress to almost nothing.
        shuffled = raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b""
        parts += [raw.dtype.str.encode().ljust(4), len(raw).to_bytes(8, "little"), shuffled]
    return zstandard.compress(b"".join(parts), ZSTD)


def _unpack(value: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(value)
    at, out = 4, []
    for _ in range(int.from_bytes(data[:4], "little")):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        at += 12
        flat = np.frombuffer(data, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def _unique(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, for whole numbers from 0 up to ``most``: each is sorted as one number with its place, which
    is several times faster than sorting places, unless both together are too long."""
    bits = len(codes).bit_length()
    if int(most).bit_length() + bits > 63:
        return np.unique(codes, return_inverse=True)
    both = codes.astype(np.int64)
    both <<= bits
    both |= np.arange(len(codes))
    both.sort()
    values = both >> bits
    runs = _first(values)
    values = values[runs]
    both &= (1 << bits) - 1
    inverse = np.empty(len(codes), np.int64)
    inverse[both] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(codes))))
    return values, inverse


@dataclass(frozen=True)
class Discounts:
    """``d[r]`` for counts r up to K (d[0] unused); 1 above."""

    d: tuple[float, ...]

    @staticmethod
    def of(count_of_counts: np.ndarray) -> Discounts:
        """From n_1 ... n_{K+1}, at places 1 to K + 1."""
        n = np.array(count_of_counts[: K + 2], float)
        r = np.arange(1, K + 2)
        if (n[1:] > 0).all():
            slope, level = np.polyfit(np.log(r), np.log(n[1:]), 1)
            smooth = np.concatenate(([0.0], np.exp(level) * r**slope))  # Simple Good-Turing, where the raw counts will not do
            for m in (n, smooth):
                a = (K + 1) * m[K + 1] / m[1]
                d = ((r[:K] + 1) * m[2:] / (r[:K] * m[1 : K + 1]) - a) / (1 - a) if a < 1 else np.zeros(K)
                if ((d > 0) & (d < 1)).all():
                    return Discounts((1.0, *d.tolist()))
        step = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
        return Discounts((1.0, *(1 - step / r[:K]).tolist()))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= K, np.array(self.d)[np.minimum(counts, K)], 1.0)

    def lost(self, r: int) -> float:
        """Counts that a pair or word seen r times gives up."""
        return r * (1 - self.d[r])


@dataclass(frozen=True)
class Words:
    """The words' part of the model: training tokens, distinct words, discounts and what unknown words get."""

    tokens: int
    distinct: int
    discounts: Discounts
    spare: float  # counts left for unknown words
    extra: int  # 1 if no discount leaves any, so that one count is added

    @staticmethod
    def of(tokens: int, distinct: int, count_of_counts: np.ndarray) -> Words:
        discounts = Discounts.of(count_of_counts)
        spare = sum(float(count_of_counts[r]) * discounts.lost(r) for r in range(1, K + 1))
        return Words(tokens, distinct, discounts, spare or 1.0, 0 if spare else 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        """P(v) by the counts of v; 0 counts are the class of unknown words."""
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, self.discounts(counts) * counts, self.spare) / (self.tokens + self.extra)


@dataclass(frozen=True)
class Level:
    """What all must know of the n-grams of one length: where each bucket's numbers begin, their discounts and those of the
    n-grams shorter by one, and the sums of contexts that are dealt over several buckets."""

    n: int
    offsets: np.ndarray
    discounts: Discounts
    shorter: Discounts
    hot: np.ndarray
    hot_sums: np.ndarray

    @property
    def kind(self) -> str:
        return f"{self.n}-grams"


def _hist(counts: np.ndarray) -> np.ndarray:
    """How many of ``counts`` are 1, ..., K + 1, at those places."""
    return np.bincount(counts[(counts > 0) & (counts <= K + 1)], minlength=K + 2)[: K + 2].astype(np.int64)


def encode(docs: DataFrame, chunk: int) -> DataFrame:
    """(chunk, doc_ids, sizes, held, vocab, x): documents of ``docs`` (doc_id, text, held) as word numbers."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        number, flat, ids, sizes, held = {b"": 0}, [], [], [], []

        def flush() -> pd.DataFrame:
            nonlocal base, number, flat, ids, sizes, held
            row = pd.DataFrame({"chunk": [base], "doc_ids": [ids], "sizes": [sizes], "held": [held], "vocab": [zstandard.compress(b" ".join(number), ZSTD)], "x": [_pack(np.array(flat, np.uint32))]})
            base, number, flat, ids, sizes, held = base + 1, {b"": 0}, [], [], [], []
            return row

        for b in batches:
            for name, text, out in zip(b["doc_id"], b["text"], b["held"]):
                before = len(flat)
                flat += [number.setdefault(w, len(number)) for w in byte_words(text)]
                flat.append(0)
                ids.append(None if name is pd.NA or name != name else name)
                sizes.append(len(flat) - before)
                held.append(bool(out))
                if len(flat) >= chunk:
                    yield flush()
        if ids:
            yield flush()

    kind = column_type(docs, "doc_id")
    return docs.mapInPandas(each, f"chunk long, doc_ids array<{kind}>, sizes array<int>, held array<boolean>, vocab binary, x binary")


class Chunk:
    """One encoded chunk, with what is derived from it alone (and so need not travel)."""

    def __init__(self, row: pd.Series, buckets: int):
        self.vocab = zstandard.decompress(row["vocab"]).split(b" ")
        self.flat = _unpack(row["x"])[0].astype(np.int64)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.held = np.asarray(row["held"], bool)
        self.doc_ids = list(row["doc_ids"])
        self.train = np.repeat(~self.held, self.sizes)
        self.buckets = buckets
        where = np.fromiter((zlib.crc32(w) % buckets for w in self.vocab), np.int64, len(self.vocab))
        self.order = np.argsort(where, kind="stable")
        self.cuts = np.searchsorted(where[self.order], np.arange(buckets + 1))

    def words(self) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(bucket, words, training counts)."""
        counts = np.bincount(self.flat[self.train], minlength=len(self.vocab))
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            these = self.order[self.cuts[k] : self.cuts[k + 1]]
            yield k, zstandard.compress(b" ".join([self.vocab[i] for i in these.tolist()]), ZSTD), counts[these]

    def learn_words(self, answers: pd.DataFrame, words: Words, begins: int) -> None:
        """Takes the buckets' answers: numbers and training counts of the words. From here on, ``gram`` has the n-gram that
        ends at each token (-1: none that is needed), and ``number``, ``count`` and ``own`` (no other chunk has it) are by n-gram; ``p`` is what the
        model so far gives each token, and ``whole`` what the count of a token's n-gram is a part of."""
        size = len(self.vocab)
        self.number = np.full(size + 1, UNKNOWN, np.int64)
        self.count, self.own = np.zeros(size + 1, np.int64), np.zeros(size + 1, bool)
        for k, value in zip(answers["bucket"].astype(int), answers["x"]):
            local, counts, own = _unpack(value)
            these = self.order[self.cuts[k] : self.cuts[k + 1]]
            # A bucket's first words are its frequent ones: in turns, frequent words have small numbers, which pack well.
            self.number[these] = np.where(counts > 0, local.astype(np.int64) * self.buckets + k, UNKNOWN)
            self.count[these], self.own[these] = counts, own > 0
        self.number[-1], self.count[-1] = BEGIN, begins
        self.words, self.word_count = self.number, self.count
        self.gram = self.flat
        self.p = words.p(self.count[self.flat])
        self.whole = np.full(len(self.flat), words.tokens + words.extra, np.int64)

    def ask(self, n: int, tokens: int) -> None:
        """Distinct n-grams after a known context, in the order in which they are asked for. One with an unknown word was
        never seen, but its context's sums are needed all the same."""
        starts = np.cumsum(self.sizes) - self.sizes
        context = np.concatenate(([-1], self.gram[:-1]))
        if n == 2:
            context[starts] = len(self.vocab)
        else:  # a text's first tokens have no context of this length
            context[np.arange(len(context)) - np.repeat(starts, self.sizes) < n - 2] = -1
        at = np.flatnonzero(context >= 0)
        at = at[self.count[context[at]] > 0]
        # By context and word in the order of their numbers, then by bucket.
        by_number, by_word = np.argsort(self.number), np.argsort(self.words)
        code, place = _unique(_places(by_number)[context[at]] * len(by_word) + _places(by_word)[self.flat[at]], len(by_number) * len(by_word))
        left, right = np.divmod(code, len(by_word))
        u, gv = by_number[left], self.words[by_word[right]]
        # A context takes as many buckets as it has shares of the tokens; numbers are mixed so that neighbours part.
        spread = 1 + self.count[u] * self.buckets // max(1, tokens)
        where = (_mixed(self.number[u]) + _mixed(gv) % spread) % self.buckets
        where = _narrow(np.where(self.own[u], self.buckets, where))  # what follows its own stays here, behind all buckets
        order = np.argsort(where, kind="stable")
        place = _places(order)[place]
        self.at, self.context, self.local_u = at, context[at], u[order]
        self.u, self.v, self.spread = self.number[self.local_u], gv[order], spread[order]
        self.seen = np.bincount(place, self.train[at], len(code)).astype(np.int64)
        shorter = np.empty(len(code), np.int64)
        shorter[place] = at
        self.shorter_count, self.shorter_whole = self.count[self.gram[shorter]], self.whole[shorter]
        self.gram_cuts = np.searchsorted(where[order], np.arange(self.buckets + 1))
        self.next_gram = np.full(len(self.flat), -1, np.int64)
        self.next_gram[at] = place

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, n-grams in runs of one context, with training counts of themselves and of the shorter ones). The first
        message has the counts of counts of what is not asked for."""
        hist = _hist(self.seen[self.gram_cuts[-1] :])
        for k in np.flatnonzero(np.diff(self.gram_cuts)).tolist() or [0]:
            part = slice(self.gram_cuts[k], self.gram_cuts[k + 1])
            u = self.u[part]
            runs = _first(u)
            lengths = np.diff(np.append(runs, len(u)))
            steps = np.diff(u[runs], prepend=0)
            hot = (self.spread[part][runs] > 1).astype(np.int8)
            yield k, _pack(*map(_narrow, (steps, lengths)), self.v[part].astype(np.uint32), *map(_narrow, (self.seen[part], self.shorter_count[part])), hot, hist)
            hist = np.zeros_like(hist)

    def learn(self, level: Level, answers: pd.DataFrame) -> None:
        """Takes the buckets' answers on what ``ask`` asked for."""
        total, number = np.zeros(len(self.u), np.int64), np.full(len(self.u), UNKNOWN, np.int64)
        own = np.zeros(len(self.u), bool)
        left, mass, shorter_whole = (np.zeros(len(self.count)) for _ in range(3))
        shorter_whole[self.local_u] = self.shorter_whole
        lost = np.array([level.discounts.lost(r) for r in range(1, K + 1)])
        lost_by = np.concatenate(([0.0], lost, [0.0]))

        def add_up(part: slice) -> np.ndarray:
            """Sums of each context in ``part`` over what this chunk knows; returns the contexts."""
            runs, times = _first(self.local_u[part]), self.shorter_count[part]
            to = self.local_u[part][runs]
            left[to] = np.add.reduceat(lost_by[np.minimum(total[part], K + 1)], runs)
            mass[to] = np.add.reduceat(np.where(total[part] > 0, level.shorter(times) * times, 0.0), runs)
            return to

        here = slice(self.gram_cuts[-1], len(self.u))
        total[here], own[here] = self.seen[here], True
        add_up(here)
        for k, value in zip(answers["bucket"].astype(int), answers["x"]):
            part = slice(self.gram_cuts[k], self.gram_cuts[k + 1])
            total[part], steps, alone, partial, *stats = _unpack(value)
            if len(alone):  # not for the longest n-grams, which are no contexts
                own[part] = alone > 0
                number[part.start + np.flatnonzero((total[part] > 0) & ~own[part])] = np.cumsum(steps.astype(np.int64)) + level.offsets[k]
            # Contexts that other chunks saw other words after.
            to = add_up(part)
            left[to[partial == _RARE]], left[to[partial == _FREQUENT]] = 1.0, 0.0  # no more is asked of them
            to = to[partial == _SUMS]
            left[to], mass[to] = np.stack(stats[:K], axis=1) @ lost, stats[K]
        if len(level.hot):
            place = np.minimum(np.searchsorted(level.hot, self.number), len(level.hot) - 1)
            hot = (level.hot[place] == self.number) & (self.count > 0)
            left[hot], mass[hot] = level.hot_sums[place[hot], :K] @ lost, level.hot_sums[place[hot], K]
        # A context that was seen leaves (left / count) to words that did not follow it, and one count if nothing is left.
        extra = (self.count > 0) & (left <= 0)
        whole = np.maximum(self.count + extra, 1)
        mass /= np.maximum(shorter_whole, 1)
        alpha = np.where((self.count > 0) & (mass > 0), np.where(extra, 1.0, left) / whole / (1 - mass), 1.0)
        self.gram = self.next_gram
        r = total[self.gram[self.at]]
        self.whole = np.zeros(len(self.flat), np.int64)
        self.whole[self.at] = whole[self.context]
        self.p[self.at] = np.where(r > 0, level.discounts(r) * r / self.whole[self.at], alpha[self.context] * self.p[self.at])
        self.number, self.count, self.own = number, total, own
        # Spent, and large: not to be held while longer n-grams are made.
        del self.at, self.context, self.local_u, self.u, self.v, self.spread, self.seen, self.shorter_count, self.shorter_whole, self.next_gram


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    kinds = [np.min_scalar_type(x) for x in (values.min(), values.max())] if len(values) else [np.int8]
    return values.astype(np.result_type(*kinds))


def _mixed(values: np.ndarray) -> np.ndarray:
    return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _places(order: np.ndarray) -> np.ndarray:
    """The inverse of a permutation."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _first(values: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


#: What a bucket says of a context's followers: the chunk knows them all; the sums stand behind; or, where no token of the
#: chunk backs off from the context, only whether one of them is rare, which its discounts need.
_KNOWN, _SUMS, _RARE, _FREQUENT = range(4)
_STATS = -1  # the "chunk" of rows that hold a bucket's own sums
_ANSWER = "chunk long, bucket int, kind string, x binary"
_CHUNK = "chunk"  # the kind of rows that hold a chunk


def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds up one bucket's words."""
    bucket = int(rows["bucket"].iloc[0])
    number: dict[bytes, int] = {}
    asked, given = [], []
    for value, counts in zip(rows["words"], rows["x"]):
        asked.append(np.array([number.setdefault(w, len(number)) for w in zstandard.decompress(value).split(b" ")], np.int64))
        given.append(_unpack(counts)[0])
    total = np.bincount(np.concatenate(asked), np.concatenate(given), len(number)).astype(np.int64)
    seen = total > 0
    local = np.cumsum(seen) - 1  # numbers for known words only
    own = (np.bincount(np.concatenate(asked), minlength=len(number)) == 1).astype(np.int8)
    out = [(int(c), bucket, "word", _pack(*map(_narrow, (local[a], total[a])), own[a])) for c, a in zip(rows["chunk"], asked)]
    out.append((_STATS, bucket, "word", _pack(np.array([seen.sum(), total.sum()]), _hist(total))))
    return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "x"])


def _count_grams(kind: str, shorter: Discounts, numbered: bool):
    """Adds up one bucket's n-grams and, for each context, what its discounts leave and what its followers have as shorter
    n-grams. ``numbered``: those that several chunks have are numbered, as contexts of longer ones."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        parts = [_unpack(x) for x in rows["x"]]
        lengths = [p[1].astype(np.int64) for p in parts]
        run_u = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts])
        contexts, run = _unique(run_u, run_u.max(initial=0))
        v, given, shorter_count = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        v = v.astype(np.int64) + 1 & 0xFFFFFFFF  # unknown words first
        width = int(v.max(initial=0)) + 1
        hot, local_hist, asked_by = np.concatenate([p[5] for p in parts]), sum(p[6] for p in parts), [len(p[2]) for p in parts]
        del parts
        key, place = _unique(np.repeat(run, np.concatenate(lengths)) * width + v, len(contexts) * width)
        del v
        total = np.bincount(place, given, len(key)).astype(np.int64)
        seen = total > 0
        runs = _first(key // width)
        rare = np.stack([np.add.reduceat((total == r).astype(np.int64), runs) for r in range(1, K + 1)], axis=1)
        times = np.empty(len(key), np.int64)
        times[place] = shorter_count
        mass = np.add.reduceat(np.where(seen, shorter(times) * times, 0.0), runs)
        followers = np.add.reduceat(seen.astype(np.int64), runs)
        own = np.bincount(place, minlength=len(key)) == 1
        shared = seen & ~own
        local = np.cumsum(shared) - 1
        out, at, run_at = [], 0, 0
        for c, size, n in zip(rows["chunk"], asked_by, lengths):
            mine, asked = run[run_at : run_at + len(n)], place[at : at + size]
            steps, alone = (np.diff(local[asked[shared[asked]]], prepend=0), own[asked]) if numbered else (local[:0], own[:0])
            # A chunk that asks for all that followed a context adds its sums up itself.
            known = np.add.reduceat(seen[asked].astype(np.int64), np.cumsum(n) - n)
            partial = np.where(known == n, np.where(rare[mine].any(axis=1), _RARE, _FREQUENT), _SUMS)
            partial[known == followers[mine]] = _KNOWN
            mine = mine[partial == _SUMS]
            out.append((int(c), bucket, kind, _pack(*map(_narrow, (total[asked], steps, alone.astype(np.int8), partial.astype(np.int8), *rare[mine].T)), mass[mine])))
            at, run_at = at + len(asked), run_at + len(n)
        several = np.unique(run[hot > 0])
        out.append((_STATS, bucket, kind, _pack(np.array([shared.sum()]), _hist(total) + local_hist, contexts[several], *rare[several].T, mass[several])))
        return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "x"])

    return count


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: str = "held_out", order: int = ORDER, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """Trains n-grams of up to ``order`` tokens on the rows that are not ``held_out`` (a boolean column) and scores all rows.

    Per row: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (log10, add-one words)
    and score (log10 of the Katz model's probability of the text).
    """
    if order < 1:
        raise ValueError("order is the number of tokens of the longest n-gram")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held"))
    with Growing(spark, "katz", int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk") as stored:
        return _score(rows, stored, order, chunk, bucket)


def _score(rows: DataFrame, stored: Growing, order: int, chunk: int, bucket: int) -> DataFrame:
    """``score`` of rows (doc_id, text, held) by way of a table for chunks and answers."""
    kind = column_type(rows, "doc_id")
    of_chunks = {"doc_ids": f"array<{kind}>", "sizes": "array<int>", "held": "array<boolean>", "vocab": "binary"}

    def answer(asked: DataFrame, kind: str, count: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
        """Adds the buckets' answers of one kind; returns the buckets' own sums, a short row each."""
        answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(count, _ANSWER)
        table = stored.add(answers.withColumns({c: F.lit(None).cast(t) for c, t in of_chunks.items()}))
        return table.where((F.col("chunk") == _STATS) & (F.col("kind") == kind)).select("bucket", "x")

    def grouped() -> GroupedData:
        """Chunks with all answers so far."""
        return stored.table().where(F.col("chunk") != _STATS).groupBy("chunk")

    chunks = stored.add(encode(rows, chunk).withColumns({"bucket": F.lit(None).cast("int"), "kind": F.lit(_CHUNK)}))
    sums = chunks.select(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("n"), F.expr("size(filter(held, x -> not x))").alias("b")).agg(F.sum("n"), F.sum("b")).first()
    total, begins = sums[0] or 0, sums[1] or 0
    buckets = max(stored.n, -(-total // bucket))

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                asked = [(row["chunk"], k, w, _pack(_narrow(c))) for k, w, c in Chunk(row, buckets).words()]
                yield pd.DataFrame(asked, columns=["chunk", "bucket", "words", "x"])

    asked = chunks.mapInPandas(ask_words, "chunk long, bucket int, words binary, x binary")
    known, tokens, hist = np.zeros(buckets, np.int64), 0, np.zeros(K + 2, np.int64)
    for r in answer(asked, "word", _count_words).collect():
        (known[r["bucket"]], n), h = _unpack(bytes(r["x"]))
        tokens, hist = tokens + int(n), hist + h
    distinct = int(known.sum())
    if int(known.max()) * buckets >= BEGIN:
        raise ValueError("more distinct words than 32-bit numbers")
    words = Words.of(tokens, distinct, hist)

    def opened(rows: pd.DataFrame, levels: list[Level]) -> Chunk:
        c = Chunk(rows[rows["kind"] == _CHUNK].iloc[0], buckets)
        c.learn_words(rows[rows["kind"] == "word"], words, begins)
        for level in levels:
            c.ask(level.n, tokens)
            c.learn(level, rows[rows["kind"] == level.kind])
        return c

    def asking(n: int, levels: list[Level]):
        def ask(rows: pd.DataFrame) -> pd.DataFrame:
            c = opened(rows, levels)
            c.ask(n, tokens)
            return pd.DataFrame([(rows["chunk"].iloc[0], *a) for a in c.asked()], columns=["chunk", "bucket", "x"])

        return ask

    levels = []
    for n in range(2, order + 1):
        grams = grouped().applyInPandas(asking(n, list(levels)), "chunk long, bucket int, x binary")
        shorter = levels[-1].discounts if levels else words.discounts
        sizes, gram_hist = np.zeros(buckets, np.int64), np.zeros(K + 2, np.int64)
        hot: dict[int, np.ndarray] = {}
        for r in answer(grams, f"{n}-grams", _count_grams(f"{n}-grams", shorter, n < order)).collect():  # contexts in several buckets: two a bucket on average
            (sizes[r["bucket"]],), h, contexts, *stats = _unpack(bytes(r["x"]))
            gram_hist += h
            for u, sums in zip(contexts.tolist(), np.stack(stats, axis=1)):
                hot[u] = hot.get(u, 0) + sums
        numbers = np.array(sorted(hot), np.int64)
        hot_sums = np.array([hot[u] for u in numbers.tolist()]).reshape(-1, K + 1)
        levels.append(Level(n, np.concatenate(([0], np.cumsum(sizes)[:-1])), Discounts.of(gram_hist), shorter, numbers, hot_sums))

    def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
        c = opened(rows, levels)
        counts = c.word_count[c.flat]
        base = np.log10((counts + 1) / (tokens + distinct + 1))
        starts = np.cumsum(c.sizes) - c.sizes
        per_doc = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "doc_id": pd.Series(c.doc_ids, dtype=object), "held_out": c.held, "n_tokens": c.sizes, "n_known": per_doc((counts > 0).astype(np.int64)),
            "train_tokens": tokens, "base_score": per_doc(base), "score": per_doc(np.log10(c.p)),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return grouped().applyInPandas(evaluate, schema)
