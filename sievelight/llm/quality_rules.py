"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a document's statistics and votes *good*, votes *bad* or abstains. Expectation-maximisation over
the counts of vote patterns estimates how accurate each rule is on either class, without labels, and the posterior
probability of *good* replaces an all-must-pass filter. A base rule (too few words, or mostly repeated windows)
rejects outright.

Defined results: a null or empty text has no words, all its statistics are 0 and it fails the base rule. Very long
texts are read whole; their repeated windows are found by one sort of the document's own window hashes. Repeated
documents vote alike. An empty table gives an empty result. Other columns of the input are passed on by ``keep_good``
and play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.texts import LOWER, SPACE_CLASS, UPPER, words_column
from sievelight.storage import materialise

SYMBOLS = "#*$%&|<>"
#: The most frequent function words of the corpus' four languages.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with by on are "
    "der die und den von zu das mit sich des auf für ist nicht ein eine "
    "de la le et les des en un du une que est pour qui dans par "
    "el los y del se las por con no su para al una es lo"
).split()

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_FROM = 0.5


@dataclass(frozen=True)
class Rule:
    """Votes *bad* where ``bad`` holds, else *good* where ``good`` holds, else abstains. Both are SQL predicates."""

    name: str
    bad: str
    good: str


#: Production rules over the columns of ``statistics``.
RULES = (
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("shouting", "n_upper > 0.4 * word_chars", "n_upper <= 0.15 * word_chars"),
    Rule("exclamation", "n_exclamation > 0.1 * n_words", "n_exclamation <= 0.02 * n_words"),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    Rule("lines", "n_dup_lines >= 2 and n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0"),
    Rule("word_length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    Rule("function_words", "n_function_words < 2", "n_function_words >= 4"),
    Rule("length", "n_words < 50", "n_words >= 100"),
)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id and the counts that the rules read; with ``carry`` also the row as _row."""
    t = F.col("_t")
    line_has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), *row)
    carried = ["_row"] if carry else []
    counted = base.select(
        "doc_id",
        *carried,
        words_column(t).alias("_w"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_exclamation"),
        F.filter(F.split(t, "\n"), line_has_word).alias("_lines"),
    )
    hashed = counted.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.transform(
            F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)),
        ).alias("_h"),
        F.size(F.array_intersect(F.transform("_w", lambda w: F.translate(w, UPPER, LOWER)), F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    return hashed.select(
        "doc_id", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper", "n_exclamation", "n_lines", "n_function_words",
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _words_in_repeats(F.col("_h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _words_in_repeats(hashes: Column) -> Column:
    """Words covered by windows of three whose hash occurs twice or more: sort (hash, place) and look at neighbours."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # A one-element array binds the sorted array to a lambda variable, so that it is built once.
    covered = F.transform(
        F.array(ordered),
        lambda s: F.size(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.filter(
                            F.transform(s, lambda x, j: F.when(F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]), x["i"])),
                            lambda i: i.isNotNull(),
                        ),
                        lambda i: F.array(i, i + 1, i + 2),
                    )
                )
            )
        ),
    )
    return F.get(covered, F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes(stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``votes``: one character per rule, ``+`` good, ``-`` bad, ``0`` abstains."""
    each = [F.when(F.expr(r.bad), "-").when(F.expr(r.good), "+").otherwise("0") for r in rules]
    return stats.withColumn("votes", F.concat(*each))


@dataclass(frozen=True)
class LabelModel:
    """``prior`` is P(good); ``good[j]`` is P(rule j votes + | good, votes), ``bad[j]`` is P(rule j votes - | bad, votes)."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def log_odds(self, vote: Column) -> Column:
        """log P(good | votes) / P(bad | votes), as a sum of literals chosen by each vote."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, (g, b) in enumerate(zip(self.good, self.bad)):
            v = F.substring(vote, j + 1, 1)
            total = total + F.when(v == "+", math.log(g / (1 - b))).when(v == "-", math.log((1 - g) / b)).otherwise(0.0)
        return total

    def posterior_of(self, vote: str) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(vote, self.good, self.bad):
            odds += math.log(g / (1 - b)) if v == "+" else math.log((1 - g) / b) if v == "-" else 0.0
        return 1 / (1 + math.exp(-odds))


#: Where expectation-maximisation starts: a rule seldom votes bad on a good document, and sees a part of the bad ones.
START_PRIOR, START_GOOD, START_BAD = 0.8, 0.99, 0.2


def fit(patterns: list[tuple[str, int]], n_rules: int, rounds: int = 100, most: float = 0.999) -> LabelModel:
    """Expectation-maximisation over (vote pattern, count) rows, of which there are at most 3 ** n_rules.

    Each rule has an accuracy on either class. A rule made for one kind of junk may see few of the bad documents, so
    that its *good* votes say little; but it must vote bad at least twice as often on bad documents as on good ones
    (better than chance, which also fixes what the classes mean). Counts are smoothed by one vote of the start values.
    """
    model = LabelModel(START_PRIOR, (START_GOOD,) * n_rules, (START_BAD,) * n_rules)
    total = sum(c for _, c in patterns)
    if not total:
        return model
    for _ in range(rounds):
        good = 0.0
        tally = [[START_GOOD, 1.0, START_BAD, 1.0] for _ in range(n_rules)]
        for vote, count in patterns:
            p = model.posterior_of(vote)
            good += p * count
            for v, t in zip(vote, tally):
                if v != "0":
                    t[1] += p * count
                    t[3] += (1 - p) * count
                    t[0 if v == "+" else 2] += (p if v == "+" else 1 - p) * count
        accuracy = [(min(most, max(0.6, t[0] / t[1])), t[2] / t[3]) for t in tally]
        model = LabelModel(
            min(0.99, max(0.01, (good + START_PRIOR) / (total + 1))),
            tuple(g for g, _ in accuracy),
            tuple(min(most, max(2 * (1 - g), b)) for g, b in accuracy),
        )
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Statistics, votes, ``posterior`` of good, ``base_failed`` and ``kept`` per row of ``docs``.

    The statistics are written once; the label model is fitted on the counts of their vote patterns over
    all rows that pass the base rule (the others are rejected whatever the rules say).
    """
    seen = materialise(votes(statistics(docs, doc_id, text, carry), rules), "quality")
    patterns = [(r["votes"], r["count"]) for r in seen.where(~base_failed()).groupBy("votes").count().orderBy("votes").collect()]  # at most 3 ** len(rules) rows
    model = fit(patterns, len(rules))
    return (
        seen.withColumn("posterior", 1 / (1 + F.exp(-model.log_odds(F.col("votes")))))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))
    )


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged. Rows travel with their statistics, so that nothing is joined."""
    return judge(docs, doc_id=doc_id, text=text, carry=True).where("kept").select("_row.*")
