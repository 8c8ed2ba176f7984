"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at either end) and of itself, hashed into a table of embeddings, so
that an unseen misspelling shares most of its vectors with the word it comes from. The embeddings of a passage's subwords are
averaged and a two-class linear softmax reads the average. A document is read whole, in overlapping passages, and its
score is that of its worst passage: a sentence among twenty thousand words counts as much as in a note.

Embeddings and softmax are trained together by Adam on a bounded sample of labelled rows (``most_toxic``, ``most_other`` and
``most_chars`` are the bounds), each document by its worst passage of the moment. For scoring, the linear layer is folded into the table,
so that a word's contribution is one number, which each worker remembers. The subwords of the sample's words are some forty
times as many as its words: they stand in a temporary file, and what an epoch makes of them is made block by block, so the
driver holds the sample, its words' numbers and the table.

Defined results: a null or empty text has no passage and gets the softmax of the bias alone. Repeated rows score alike; a
null id is an id that no label names; rows labelled more than once count once a label, and of labelled rows that share an id
the shortest text is learned from; null labels are not. A column ``score`` is replaced. Without labelled rows
of both classes the score is the share of the one class seen, or 0. An empty table gives an empty result; columns that are
not named play no part.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.texts import column_type
from sievelight.storage import materialise

_WORD = re.compile(r"[^\W_]+")
#: Most words whose contribution a worker, or whose number the training, remembers; it then starts anew.
REMEMBER = 400_000
#: Subwords, or passages, that training looks at in one go.
BLOCK, PASSAGES = 1 << 18, 1 << 14


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    least_gram: int = 3
    most_gram: int = 6
    passage: int = 20
    stride: int = 10
    epochs: int = 60
    rate: float = 0.05
    decay: float = 5e-6
    most_toxic: int = 2000
    most_other: int = 4000
    most_chars: int = 24_000_000
    seed: int = 7


def subwords(word: str, s: Settings) -> Iterator[int]:
    """The table rows of a word: itself and its character n-grams."""
    marked = f"<{word}>"
    yield zlib.crc32(marked.encode("utf-8", "replace")) % s.buckets
    for n in range(s.least_gram, min(s.most_gram, len(marked) - 1) + 1):
        for i in range(len(marked) - n + 1):
            yield zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % s.buckets


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """``weight[g]`` is what the subword g adds to the log-odds of toxic, ``bias`` what all documents get."""

    weight: np.ndarray
    bias: float
    settings: Settings
    _known: dict[str, tuple[float, int]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"weight": self.weight, "bias": self.bias, "settings": self.settings, "_known": {}}

    def score(self, text: str | None) -> float:
        """The probability of toxic of the worst passage."""
        known, s = self._known, self.settings
        words = tokens(text)
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        if len(known) > REMEMBER:
            known.clear()
        for w in set(words):
            if w not in known:
                rows = np.fromiter(subwords(w, s), np.int32)
                known[w] = (float(self.weight[rows].sum()), len(rows))
        values = np.array([known[w] for w in words])
        sums = np.concatenate((np.zeros((1, 2)), np.cumsum(values, axis=0)))
        begins = passage_starts(len(words), s)
        part = sums[np.minimum(begins + s.passage, len(words))] - sums[begins]
        return float(1 / (1 + np.exp(-(part[:, 0] / part[:, 1] + self.bias).max())))


def passage_starts(n_words: int, s: Settings) -> np.ndarray:
    return np.arange(0, max(1, n_words - s.passage + s.stride), s.stride)


@dataclass
class _Sample:
    """The texts to learn from as numbers: ``flat`` has the word of each place, ``begin`` and ``end`` have the places of each
    passage and ``doc`` its text; ``grams`` (a file) has the subwords of word after word, ``starts`` where those of a word
    begin. A word that was forgotten and came again has two numbers."""

    flat: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    grams: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], s: Settings) -> _Sample:
        ids: dict[str, int] = {}
        flat, many = array("i"), array("i")
        begins, ends, owner = [], [], []
        with tempfile.TemporaryFile() as file:
            for d, text in enumerate(texts):
                at = len(flat)
                for match in _WORD.finditer((text or "").lower()):
                    if (i := ids.get(w := match[0])) is None:
                        if len(ids) >= REMEMBER:
                            ids.clear()
                        i = ids[w] = len(many)
                        rows, n = subwords(w, s), 0
                        while part := array("i", islice(rows, BLOCK)):
                            part.tofile(file)
                            n += len(part)
                        many.append(n)
                    flat.append(i)
                found = len(flat) - at
                starts = passage_starts(found, s) if found else np.zeros(0, np.int64)
                begins.append(at + starts)
                ends.append(at + np.minimum(starts + s.passage, found))
                owner.append(np.full(len(starts), d))
            file.flush()
            grams = np.memmap(file, np.intc, "r") if many else np.zeros(0, np.intc)
        begin, end, doc = map(np.concatenate, (begins, ends, owner))
        return cls(np.array(flat, np.intc), begin, end, doc, grams, np.concatenate(([0], np.cumsum(many, dtype=np.int64))))

    def blocks(self) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """Block after block of the subwords, whose words they are, and where in the block each of these begins and ends."""
        for at in range(0, len(self.grams), BLOCK):
            part = np.asarray(self.grams[at : at + BLOCK])
            words = slice(np.searchsorted(self.starts, at, "right") - 1, np.searchsorted(self.starts, at + len(part), "left"))
            yield part, words, np.clip(self.starts[words.start : words.stop + 1] - at, 0, len(part))

    def to_words(self, by_gram: np.ndarray) -> np.ndarray:
        """What the subwords of each word sum up to."""
        out = np.zeros(len(self.starts) - 1)
        for part, words, cuts in self.blocks():
            out[words] += np.add.reduceat(by_gram[part], cuts[:-1])
        return out

    def to_grams(self, by_word: np.ndarray, buckets: int) -> np.ndarray:
        """What the words of each subword sum up to."""
        out = np.zeros(buckets)
        for part, words, cuts in self.blocks():
            out += np.bincount(part, np.repeat(by_word[words], np.diff(cuts)), buckets)
        return out

    def to_passages(self, by_word: np.ndarray) -> np.ndarray:
        """What the words of each passage sum up to."""
        out = np.empty(len(self.begin))
        for at in range(0, len(out), PASSAGES):
            begin, end = self.begin[at : at + PASSAGES], self.end[at : at + PASSAGES]
            sums = np.concatenate(([0.0], np.cumsum(by_word[self.flat[begin[0] : end[-1]]])))
            out[at : at + PASSAGES] = sums[end - begin[0]] - sums[begin - begin[0]]
        return out

    def from_passages(self, chosen: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What each word gets if each chosen passage gives its value to all its places."""
        n = self.end[chosen] - self.begin[chosen]
        places = np.arange(n.sum()) + np.repeat(self.begin[chosen] - np.cumsum(n) + n, n)
        return np.bincount(self.flat[places], np.repeat(values, n), len(self.starts) - 1)


def train(texts: list[str | None], labels: list[int], s: Settings = Settings(), share: float | None = None) -> Model:
    """Full-batch Adam; the work of an epoch is that of the sample's distinct words. ``share`` is the share of toxic rows
    among all, where the sample has another: rows are weighted for it. Texts without any word leave the share alone."""
    y = np.asarray(labels, np.float64)
    own = float(y.mean()) if len(y) else 0.0
    share = own if share is None or not 0 < own < 1 else share
    weight = np.zeros(s.buckets, np.float32)
    if not 0 < share < 1:
        return Model(weight, 40.0 if share else -40.0, s)
    known = _Sample.of(texts, s)
    bias = np.array([np.log(share / (1 - share))])
    if not len(known.flat):
        return Model(weight, float(bias[0]), s)
    weights = np.where(y > 0, share / own, (1 - share) / (1 - own)) / len(y)
    # Only rows of the table that the sample uses are trained.
    by_gram, seen = np.zeros(s.buckets), np.zeros(s.buckets, bool)
    for part, _, _ in known.blocks():
        seen[part] = True
    used = np.flatnonzero(seen)
    rng = np.random.default_rng(s.seed)
    table = rng.normal(0, 0.1, (len(used), s.dim))
    linear = rng.normal(0, 0.5, s.dim)  # the softmax of two classes has one free direction
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, linear, bias)]
    size = known.to_passages(np.diff(known.starts).astype(np.float64))
    first = np.flatnonzero(np.diff(known.doc, prepend=-1))  # first passage of each document that has one
    with_words = known.doc[first]
    for epoch in range(1, s.epochs + 1):
        by_gram[used] = table @ linear
        logit = known.to_passages(known.to_words(by_gram)) / size + bias[0]
        worst = np.maximum.reduceat(logit, first)
        which = np.full(len(y), -1)
        hit = np.flatnonzero(logit == np.repeat(worst, np.diff(np.append(first, len(logit)))))
        which[known.doc[hit[::-1]]] = hit[::-1]
        p = 1 / (1 + np.exp(-np.where(which >= 0, logit[which], bias[0])))
        error = (p - y) * weights
        chosen = which[with_words]
        # Gradient to words, then to subwords: each passage spreads its error over its words.
        to_word = known.from_passages(chosen, error[with_words] / size[chosen])
        to_gram = known.to_grams(to_word, s.buckets)[used]
        gradients = (np.outer(to_gram, linear) + s.decay * table, table.T @ to_gram + s.decay * linear, np.array([error.sum()]))
        for param, grad, (m, v) in zip((table, linear, bias), gradients, moments):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            param -= s.rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    weight[used] = table @ linear
    return Model(weight, float(bias[0]), s)


def fitting(lengths: np.ndarray, most: int) -> np.ndarray:
    """Which texts to take, in their order, so that they hold ``most`` characters at most: one that does not fit is passed
    over, later ones are not. If none fits, the shortest is taken whole."""
    took, total = np.zeros(len(lengths), bool), 0
    for i, n in enumerate(lengths.tolist()):
        if total + n <= most:
            took[i], total = True, total + n
    if len(lengths) and not took.any():
        took[int(np.argmin(lengths))] = True
    return took


def sample(docs: DataFrame, labels: DataFrame, s: Settings, doc_id: str, text: str, label: str) -> tuple[pd.DataFrame, float]:
    """Labelled rows, at most ``most_toxic`` and ``most_other`` of either class drawn by a hash of the id, and of these as
    many as fit into ``most_chars``, one of a class at least; and the share of toxic ones among all labelled rows."""
    chosen = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), (F.col(label) > 0).cast("int").alias("y")).distinct()
    # Ids are compared by value, so that only the labels' few columns and the ids travel before the sample is known. Of rows
    # that share an id the shortest counts, so that no id brings more than one text to the driver.
    lengths = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.length(text), F.lit(0)).alias("n")).join(chosen, "_id")
    lengths = materialise(lengths.groupBy("_id", "y").agg(F.min("n").alias("n")), "lengths")
    counts = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    order = [F.xxhash64("_id", F.lit(s.seed)), F.col("_id")]
    parts = [lengths.where(F.col("y") == y).orderBy(*order).limit(most).toPandas() for y, most in ((1, s.most_toxic), (0, s.most_other))]
    first = pd.concat([p[fitting(p["n"].to_numpy(), s.most_chars // 2)] for p in parts])[["_id", "y"]].drop_duplicates()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = docs.sparkSession.createDataFrame([(i, int(y)) for i, y in first.itertuples(index=False)], f"_id {column_type(docs, doc_id)}, y int")
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id")  # most_toxic + most_other ids
    one = found.groupBy("_id", "y").agg(F.min(F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("n"), "text")).alias("t")).select("_id", "y", "t.text")
    return one.toPandas().sort_values(["_id", "y"]), share


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the rows of ``docs`` that ``labels`` (doc_id, label) marks."""
    rows, share = sample(docs, labels, settings, doc_id, text, label)
    return train(rows["text"].tolist(), rows["y"].tolist(), settings, share)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``: the probability of toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for part in parts:
            yield pd.Series([m.score(t) for t in part], dtype="float64")

    return docs.withColumn("score", each(F.col(text)))
