"""Evaluation reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """a / b to four places, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.bround(a / F.nullif(b, F.lit(0)), 4))


def confusion(actual: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"),
        F.count_if(~actual & ~predicted).alias("tn"), F.count_if(actual & ~predicted).alias("fn"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and fpr to confusion counts."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn),
    })


def binary_metrics(rows: DataFrame, actual: Column, score: Column, threshold: float, by: list[str] | None = None) -> DataFrame:
    return with_rates(rows.groupBy(*(by or [])).agg(*confusion(actual, score >= threshold)))


def auc(rows: DataFrame, actual: Column, score: Column) -> DataFrame:
    """(auc): the rank-sum area with tied scores sharing their mean rank; null if a class is empty.

    Scores are counted per distinct value first and ranks come from a running count of these, so that ties of any number
    cost one row. Distinct values are sorted in ranges, each range's offset added by a join: no single task sorts all.
    """
    values = rows.select(actual.cast("long").alias("y"), score.alias("s")).groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    lo, hi = values.agg(F.min("s"), F.max("s")).first()
    width = ((hi - lo) or 1.0) if lo is not None else 1.0
    binned = values.withColumn("bin", F.floor((F.col("s") - F.lit(lo)) / F.lit(width) * 256).cast("int"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # at most 257 rows
    within = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(F.broadcast(offsets), "bin").withColumn("rank", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)) + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return total.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auc"))


def matrix(rows: DataFrame, actual: str, predicted: str, values: list[str]) -> DataFrame:
    return rows.groupBy(actual).pivot(predicted, values).count().fillna(0, values)


def rule_rates(rows: DataFrame, codes: str = "codes", label: str = "class") -> DataFrame:
    """Per code: the share of phishing and of legitimate mails in which it fires."""
    totals = rows.agg(F.count_if(F.col(label) == "phishing").alias("_p"), F.count_if(F.col(label) == "legitimate").alias("_l"))
    fired = rows.select(label, F.explode(F.array_distinct(codes)).alias("code"))
    counted = fired.groupBy("code").agg(F.count_if(F.col(label) == "phishing").alias("phishing"), F.count_if(F.col(label) == "legitimate").alias("legitimate"))
    joined = counted.join(F.broadcast(totals))  # one row
    return joined.select("code", _ratio(F.col("phishing"), F.col("_p")).alias("phishing_rate"), _ratio(F.col("legitimate"), F.col("_l")).alias("legitimate_rate"))


def auth_rates(rows: DataFrame, codes: str = "codes") -> DataFrame:
    fails = F.array(*map(F.lit, ("dmarc-fail", "spf-fail", "dkim-fail", "compauth-fail")))
    share = lambda c: F.bround(F.avg(c.cast("double")), 4)
    return rows.agg(F.count("*").alias("n"), share(F.arrays_overlap(codes, fails)).alias("any_failure"), share(F.array_contains(codes, "auth-pass")).alias("all_pass"), share(F.array_contains(codes, "auth-missing")).alias("missing"))


def grouped_metrics(rows: DataFrame, actual: str, predicted: str, language: str, kind: str, least: int = 20) -> DataFrame:
    """Overall, per language, and per language and kind, where there are enough rows."""
    a, p = F.col(actual), F.col(predicted)
    sets = rows.groupingSets([[], [language], [language, kind]], language, kind)
    return with_rates(sets.agg(F.count("*").alias("n"), *confusion(a, p)).where(F.col("n") >= least))


def accuracy(rows: DataFrame, actual: str, probabilities: str, source: str) -> DataFrame:
    """(source, n, accuracy): how often the likeliest class (the first of equals by name) is the actual one, per source and, with a
    null source, overall. ``probabilities`` is a map from class to probability."""
    ranked = F.sort_array(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    hit = (F.get(ranked, F.lit(0))["k"] == F.col(actual)).cast("double")
    each = rows.select(F.col(source).alias("source"), F.coalesce(hit, F.lit(0.0)).alias("hit"))
    return each.groupingSets([[], ["source"]], "source").agg(F.count("*").alias("n"), F.bround(F.avg("hit"), 4).alias("accuracy"))


def brier(rows: DataFrame, p: Column, y: Column) -> DataFrame:
    return rows.agg(F.avg(F.pow(p - y.cast("double"), 2)).alias("brier"))


def choose_thresholds(rows: DataFrame, actual: Column, score: Column, most_fpr: float = 0.01, most_warned: float = 0.03) -> DataFrame:
    """(phishing, suspicious): the best F1 on a grid from .50 to .95 within a false-positive rate, the lowest of equals;
    then the lowest threshold from .25 within a second rate. Defaults .9 and .1 below."""
    grid = rows.sparkSession.range(25, 96).select((F.col("id") / 100).alias("t"))
    # Each score is counted at the grid's steps; a running sum from above then gives all thresholds at once.
    steps = rows.select(actual.alias("y"), F.least(F.floor(score * 100 + 1e-9), F.lit(100)).cast("long").alias("step")).groupBy("step").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    total = steps.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    joined = grid.join(F.broadcast(steps), F.col("step") >= F.round(F.col("t") * 100), "left").groupBy("t").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp"))  # 71 x 101 rows
    m = joined.join(F.broadcast(total)).select("t", F.coalesce(F.col("fp") / F.nullif("N", F.lit(0)), F.lit(0.0)).alias("fpr"), F.coalesce(2 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("P"), F.lit(0)), F.lit(0.0)).alias("f1"))
    best = m.agg(
        F.coalesce(F.min_by("t", F.when((F.col("t") >= 0.5) & (F.col("fpr") <= most_fpr), F.struct((-F.col("f1")).alias("f"), F.col("t").alias("t")))), F.lit(0.9)).alias("phishing"),
        F.min(F.when(F.col("fpr") <= most_warned, F.col("t"))).alias("_low"),
    )
    return best.select("phishing", F.coalesce("_low", F.bround(F.col("phishing") - 0.1, 2)).alias("suspicious"))


def mailbox_report(rows: DataFrame) -> DataFrame:
    """Per category and language: mails and verdicts under three policies, and warnings by text alone."""
    n = lambda c, v: F.count_if(F.col(c) == v).alias(f"{c}_{v}")
    verdicts = [n(c, v) for c in ("plain", "corroborated", "trusted") for v in ("phishing", "suspicious", "safe")]
    return rows.groupBy("category", "language").agg(F.count("*").alias("mails"), *verdicts, F.count_if((F.col("plain") != "safe") & (F.col("other_score") <= 0)).alias("text_only"))


def top_codes(rows: DataFrame, by: list[str], codes: str = "codes", k: int = 5) -> DataFrame:
    counted = rows.select(*by, F.explode(F.array_distinct(codes)).alias("code")).groupBy(*by, "code").count()
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "code"))).where(F.col("rank") <= k)


def top_pairs(rows: DataFrame, columns: list[str], k: int = 40) -> DataFrame:
    return rows.groupBy(*columns).count().orderBy(F.desc("count"), *columns).limit(k)


def what_if(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per (factor, min_days): the share of mails still warned, and warnings lost among phishing. ``rows`` has p, other,
    age_days, class and threshold; the candidates are few, and all are meant to meet all rows."""
    met = rows.join(candidates)  # a few rows, which Spark sees
    trusted = (F.col("age_days") >= F.col("min_days")) & (F.col("other") <= 0)
    score = 1 - (1 - F.col("p") * F.when(trusted, F.col("factor")).otherwise(1.0)) * (1 - F.col("other"))
    before = 1 - (1 - F.col("p")) * (1 - F.col("other"))
    warned = score >= F.col("threshold")
    lost = (F.col("class") == "phishing") & (before >= F.col("threshold")) & ~warned
    return met.groupBy("factor", "min_days").agg(F.count("*").alias("n"), F.bround(F.avg(warned.cast("double")), 4).alias("warned"), F.count_if(lost).alias("lost"))


def gate(checks: DataFrame) -> DataFrame:
    """One verdict over rows of (name, passed)."""
    return checks.agg(F.bool_and("passed").alias("promote"), F.concat_ws(", ", F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name"))))).alias("failed"))


def class_weights(rows: DataFrame, label: str = "class") -> DataFrame:
    """The square root of the inverse class share."""
    counts = rows.groupBy(label).count()
    total = counts.agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    return counts.join(F.broadcast(total)).select(label, "count", F.bround(F.sqrt(F.col("n") / (F.col("k") * F.col("count"))), 6).alias("weight"))


def leak_report(rows: DataFrame, by: list[str], contained: str = "contained", from_share: float = 0.8) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(contained) >= from_share).alias("leaked"))
