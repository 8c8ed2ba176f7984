"""Validation, labels, splits and numbers over columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def problems(**checks: tuple[Column, str]) -> Column:
    """map<field, messages> of the checks that fail: ``field=(is wrong, message)``. A null check does not fail."""
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(m))).alias("v")) for k, (bad, m) in checks.items()))
    return F.map_from_entries(F.filter(each, lambda x: x["v"].isNotNull()))


def request_problems(email: str = "email") -> Column:
    """What is wrong with an untrusted request: the bounds of each field."""
    e = lambda f: F.col(f"{email}.{f}")
    size = lambda f: F.coalesce(F.size(e(f)), F.lit(0))
    return problems(
        body=(F.length(e("body")) > 100_000, "too long"), subject=(F.length(e("subject")) > 2_000, "too long"),
        raw_headers=(F.length(e("raw_headers")) > 64_000, "too long"), links=(size("links") > 500, "too many"),
        attachments=(size("attachments") > 100, "too many"), qr_code_urls=(size("qr_code_urls") > 20, "too many"),
    )


def feedback_problems(vote: str = "vote") -> Column:
    """What is wrong with a vote (verdict, model_version, language, reason_codes, email): the bounds of all that is stored."""
    v = lambda f: F.col(f"{vote}.{f}")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    long = lambda c, n: F.coalesce(F.length(c) > n, F.lit(False))
    codes, links = v("reason_codes"), v("email.links")
    bad_code = F.coalesce(F.exists(codes, lambda c: c.isNull() | (F.length(c) > 64)), F.lit(False))
    bad_link = F.coalesce(F.exists(links, lambda x: x.isNull() | long(x["text"], 500) | long(x["href"], 2048)), F.lit(False))
    return problems(
        verdict=(~F.coalesce(v("verdict").isin("phishing", "suspicious", "safe"), F.lit(False)), "Verdict must be phishing, suspicious or safe."),
        modelVersion=(long(v("model_version"), 100) | long(v("language"), 16), "Model version (100) or language (16) too long."),
        reasonCodes=((size(codes) > 50) | bad_code, "At most 50 codes of up to 64 characters."),
        email=(long(v("email.body"), 20_000) | long(v("email.subject"), 1_000) | long(v("email.sender_email"), 320) | (size(links) > 50) | bad_link, "Email too large."),
    )


def reason_codes(breakdown: Column) -> Column:
    """The distinct codes of findings with a weight, in the order of the components."""
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(F.transform(F.filter(breakdown[c]["findings"], lambda f: f["weight"] > 0), lambda f: f["code"]), none)
    return F.array_distinct(F.concat(*map(of, ("headers", "links", "reputation", "attachments", "obfuscation"))))


def implied_label(verdict: Column, correct: Column) -> Column:
    """What a vote says about the mail: a confirmed verdict keeps its class, a rejected one has the other. ``suspicious`` says
    nothing either way, so it has no label."""
    sure = F.when(verdict == "phishing", "phishing").when(verdict == "safe", "legitimate")
    other = F.when(verdict == "phishing", "legitimate").when(verdict == "safe", "phishing")
    return F.when(correct, sure).when(~correct, other)


def bucket_of(key: Column, buckets: int = 100) -> Column:
    """A stable bucket from the first four bytes of SHA-256, little-endian."""
    h = F.sha2(key, 256)
    swapped = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return (F.conv(swapped, 16, 10).cast("long") % buckets).cast("int")


def split_of(group: Column, modern: Column) -> Column:
    b = bucket_of(group)
    return F.when(b < 20, "test").when((b < 30) & modern, "tune").otherwise("train")


def fold_of(group: Column, folds: int = 3) -> Column:
    return bucket_of(F.concat(F.lit("fold|"), group), folds)


def generated_split(pair_key: Column) -> Column:
    b = bucket_of(pair_key)
    return F.when(b < 15, "test").when(b < 25, "val").otherwise("train")


def category_of(labels: Column, names: Mapping[str, str], order: list[str], own: str = "sent") -> Column:
    """A mailbox category from a comma-separated label list: the first of ``order`` found; null for one's own mail."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    known = F.transform(F.split(labels, ","), lambda x: F.element_at(table, F.lower(F.trim(x))))
    choice = F.coalesce(*[F.when(F.array_contains(known, c), F.lit(c)) for c in order])
    return F.when(~F.coalesce(F.array_contains(known, own), F.lit(False)), F.coalesce(choice, F.lit("other")))


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - w), w clamped to [0, 1]; 0 for none."""
    kept = F.aggregate(F.coalesce(weights, F.array().cast("array<double>")), F.lit(1.0), lambda a, w: a * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))))
    return 1 - kept


def noisy_or_agg(weight: Column) -> Column:
    """The same as an aggregate of rows."""
    return 1 - F.coalesce(F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))), F.lit(1.0))


def platt(p: Column, a: float, b: float) -> Column:
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-(a * F.log(c / (1 - c)) + b)))


def softmax(logits: Column) -> Column:
    def of(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return F.get(F.transform(F.array(e), lambda s: F.transform(s, lambda v: v / F.aggregate(s, F.lit(0.0), lambda t, w: t + w))), F.lit(0))

    return of(logits)


def age_days(now: Column, registered: Column) -> Column:
    """Whole days between two timestamps, rounded down; fractions of a second count."""
    elapsed, day = F.unix_micros(now) - F.unix_micros(registered), F.lit(86_400_000_000)
    return F.call_function("div", elapsed - F.pmod(elapsed, day), day).cast("int")
