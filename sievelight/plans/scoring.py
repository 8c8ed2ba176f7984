"""From component findings to one explained verdict per mail."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import labels, text
from sievelight.plans import rules
from sievelight.plans.hosts import Catalogue
from sievelight.storage import materialise

CONTENT = "struct<evaluated:boolean,probability:double,spam_probability:double,indicative_terms:array<string>,language_supported:boolean,language:string,language_preview:boolean>"


@dataclass(frozen=True)
class Options:
    content_weight: float = 0.9
    phishing_threshold: float = 0.7
    suspicious_threshold: float = 0.4
    require_corroboration: bool = False
    trust_verified_brand_senders: bool = False
    verified_brand_factor: float = 0.2
    trust_established_senders: bool = False
    established_sender_factor: float = 0.5
    max_reasons: int = 6

    @staticmethod
    def from_dict(values: dict) -> Options:
        return Options(**{k: v for k, v in values.items() if k in Options.__dataclass_fields__})


class Scorer(Protocol):
    def transform(self, mails: DataFrame) -> DataFrame:
        """(email_id, content) with content a ``CONTENT`` struct."""


def _content(evaluated: bool, p: Column, spam: Column, supported: bool = True, preview: bool = False) -> Column:
    return F.struct(
        F.lit(evaluated).alias("evaluated"), p.cast("double").alias("probability"), spam.cast("double").alias("spam_probability"), F.array().cast("array<string>").alias("indicative_terms"),
        F.lit(supported).alias("language_supported"), F.lit("en").alias("language"), F.lit(preview).alias("language_preview"),
    )


class NullScorer:
    """Rules only."""

    def transform(self, mails: DataFrame) -> DataFrame:
        return mails.select("email_id", _content(False, F.lit(0), F.lit(0)).alias("content"))


@dataclass(frozen=True)
class FixedScorer:
    """The same probability for every mail; for policy tests."""

    probability: float
    supported: bool = True

    def transform(self, mails: DataFrame) -> DataFrame:
        return mails.select("email_id", _content(True, F.lit(self.probability), F.lit(0), self.supported).alias("content"))


@dataclass(frozen=True)
class PromotedLanguage:
    """Another scorer's results with one language counted as fully supported."""

    inner: Scorer
    language: str

    def transform(self, mails: DataFrame) -> DataFrame:
        mine = F.col("content.language") == self.language
        lifted = F.col("content").withField("language_supported", mine | F.col("content.language_supported")).withField("language_preview", ~mine & F.col("content.language_preview"))
        return self.inner.transform(mails).withColumn("content", lifted)


@dataclass(frozen=True)
class HybridScorer:
    """Probabilities of one scorer, terms of another."""

    decider: Scorer
    explainer: Scorer

    def transform(self, mails: DataFrame) -> DataFrame:
        terms = self.explainer.transform(mails).select("email_id", F.col("content.indicative_terms").alias("_terms"))
        return self.decider.transform(mails).join(terms, "email_id", "left").select("email_id", F.col("content").withField("indicative_terms", F.coalesce("_terms", F.array().cast("array<string>"))).alias("content"))


def content_evidence(content: Column, o: Options) -> Column:
    weight = F.when(content["language_supported"], o.content_weight).otherwise(o.content_weight * 0.5)
    return F.when(content["evaluated"], weight * content["probability"]).otherwise(0.0)


def fuse(parts: DataFrame, o: Options) -> DataFrame:
    """Adds score (unrounded), verdict and the policies that applied. ``parts`` has content and the five components as
    structs (findings, score, evaluated); reputation may be null."""
    of = lambda c: F.coalesce(F.col(f"{c}.score"), F.lit(0.0))
    others = [of(c) for c in ("headers", "links", "attachments", "obfuscation", "reputation")]
    alone = F.greatest(*others) <= 0
    listed = F.concat(*(F.coalesce(F.col(f"{c}.findings"), F.array().cast(f"array<{rules.FINDING}>")) for c in ("headers", "links", "attachments", "obfuscation", "reputation")))
    has = lambda code: F.exists(F.col("_all"), lambda f: f["code"] == code)
    d = parts.withColumn("_all", listed).withColumn("_evidence", content_evidence(F.col("content"), o))
    d = d.withColumn("verified_brand", F.lit(o.trust_verified_brand_senders) & alone & has("verified-brand-sender"))
    d = d.withColumn("established_sender", F.lit(o.trust_established_senders) & ~F.col("verified_brand") & has("auth-pass") & has("established-sender") & F.forall("_all", lambda f: f["weight"] <= 0.1))
    factor = F.when(F.col("verified_brand"), o.verified_brand_factor).when(F.col("established_sender"), o.established_sender_factor).otherwise(1.0)
    d = d.withColumn("_evidence", F.col("_evidence") * factor)
    d = d.withColumn("text_only", F.lit(o.require_corroboration) & alone & (F.col("_evidence") >= o.phishing_threshold))
    d = d.withColumn("_evidence", F.when(F.col("text_only"), o.phishing_threshold - 0.01).otherwise(F.col("_evidence")))
    d = d.withColumn("score", labels.noisy_or(F.array("_evidence", *others)))
    verdict = F.when(F.col("score") >= o.phishing_threshold, "phishing").when(F.col("score") >= o.suspicious_threshold, "suspicious").otherwise("safe")
    return d.withColumn("verdict", verdict).drop("_all", "_evidence")


def reasons(o: Options) -> Column:
    """The heaviest reasons in words: findings, the wording, and facts of no weight last; each said once."""
    empty = F.array().cast(f"array<{rules.FINDING}>")
    f = lambda c: F.coalesce(F.col(f"{c}.findings"), empty)
    sender = F.get(F.filter(f("headers"), lambda x: (x["code"] == "lookalike-sender") & x["target"].isNotNull()), F.lit(0))
    same = lambda x: (x["code"] == "lookalike-domain") & F.coalesce(x["target"] == sender["target"], F.lit(False))
    in_links = F.exists(f("links"), same)
    heads = F.transform(f("headers"), lambda x: F.when((x["code"] == "lookalike-sender") & in_links, x.withField("message", F.concat(x["message"], F.lit(" - the links use the same domain")))).otherwise(x))
    weighty = F.filter(F.concat(heads, F.filter(f("links"), lambda x: ~same(x)), f("reputation"), f("attachments"), f("obfuscation")), lambda x: x["weight"] > 0)
    c = F.col("content")
    pct = text.percent(c["probability"])
    cues = F.when(F.size(c["indicative_terms"]) > 0, F.concat(F.lit(" - cues: "), F.array_join(F.slice(c["indicative_terms"], 1, 4), ", "))).otherwise("")
    said = lambda w, m: F.struct(w.cast("double").alias("w"), m.alias("m"))
    wording = (
        F.when(c["evaluated"] & c["language_supported"] & (c["probability"] >= 0.5), said(c["probability"], F.concat(F.lit("Wording resembles phishing ("), pct, F.lit(")"), cues)))
        .when(c["evaluated"] & c["language_supported"] & (c["spam_probability"] >= 0.5), said(F.lit(0), F.concat(F.lit("Wording resembles bulk mail ("), text.percent(c["spam_probability"]), F.lit(")"))))
        .when(c["evaluated"] & c["language_supported"], said(F.lit(0), F.concat(F.lit("Wording resembles ordinary mail (phishing "), pct, F.lit(")"))))
        .when(c["evaluated"] & c["language_preview"] & (c["probability"] >= 0.5), said(c["probability"] * 0.5, F.concat(F.lit("Wording resembles phishing ("), pct, F.lit("), counted half: a preview language"))))
    )
    facts = F.filter(F.concat(f("links"), f("headers")), lambda x: x["weight"] == 0)
    as_said = lambda xs: F.transform(xs, lambda x: said(x["weight"], x["message"]))
    every = F.concat(as_said(weighty), F.filter(F.array(wording), lambda x: x.isNotNull()), as_said(facts))
    ordered = F.sort_array(F.transform(every, lambda x, i: F.struct((-x["w"]).alias("w"), i.alias("i"), x["m"].alias("m"))))
    return F.slice(F.array_distinct(F.transform(ordered, lambda x: x["m"])), 1, o.max_reasons)


def limitations() -> Column:
    """What was not checked, or counted for less."""
    c = F.col("content")
    notes = [
        (F.col("reputation").isNotNull() & ~F.col("reputation.evaluated"), "Reputation and age were not checked"),
        (text.blank(F.col("raw_headers")), "SPF, DKIM and DMARC were not checked: no raw headers"),
        (~c["evaluated"], "No text model was applied"),
        (c["evaluated"] & c["language_preview"], "Support for this language is a preview; wording counts half"),
        (c["evaluated"] & ~c["language_preview"] & ~c["language_supported"], "The model was not trained on this language; wording counts half"),
        (F.col("verified_brand"), "From the brand's own verified domain; wording counts less"),
        (F.col("established_sender"), "From an established, authenticated sender; wording counts half"),
        (F.col("text_only"), "Only the wording is suspicious"),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(w, F.lit(False)), F.lit(m)) for w, m in notes)), lambda x: x.isNotNull())


def analyse(
    mails: DataFrame, catalogue: Catalogue, scorer: Scorer | None = None, options: Options = Options(), now: Column | None = None,
    feeds: tuple[DataFrame, DataFrame] | None = None, registrations: DataFrame | None = None, threats: DataFrame | None = None,
    hops: DataFrame | None = None, plain: bool = False,
) -> DataFrame:
    """(email_id, verdict, score, reasons, limitations, language, breakdown) per mail.

    Without reputation tables this is the offline analysis. ``plain`` keeps to JVM text functions (no punycode decoding, no
    compatibility folding), which differ for non-ASCII names and hosts only.
    """
    mails = rules.with_qr_links(mails)
    links = materialise(rules.exploded_links(mails), "links")
    expanded = None
    if hops is not None:
        expanded = rules.expand_short_links(links, hops)
        more = expanded.groupBy("email_id").agg(F.slice(F.sort_array(F.collect_set("destination")), 1, 10).alias("_more"))
        longer = F.concat("links", F.transform(F.coalesce("_more", F.array().cast("array<string>")), lambda u: F.struct(F.lit(None).cast("string").alias("text"), u.alias("href"))))
        mails = mails.join(more, "email_id", "left").withColumn("links", longer).drop("_more")
        links = materialise(rules.exploded_links(mails), "links")
    facts = rules.facts_for(mails, links, catalogue, decode=not plain)
    found = {
        "headers": rules.header_findings(mails, links, facts, catalogue, plain),
        "links": rules.link_findings(mails, links, facts, catalogue),
        "attachments": rules.attachment_findings(mails),
        "obfuscation": rules.obfuscation_findings(mails),
    }
    reputed = any(x is not None for x in (feeds, registrations, threats))
    if reputed:
        found["reputation"] = rules.reputation_findings(mails, links, facts, now if now is not None else F.current_timestamp(), feeds, registrations, threats)
    all_parts = mails.select("email_id", "subject", "body", "raw_headers").join((scorer or NullScorer()).transform(mails), "email_id")
    for name, df in found.items():
        all_parts = all_parts.join(df.select("email_id", F.struct("findings", "score", "evaluated").alias(name)), "email_id", "left")
    if not reputed:
        all_parts = all_parts.withColumn("reputation", F.lit(None).cast(f"struct<findings:array<{rules.FINDING}>,score:double,evaluated:boolean>"))
    if expanded is not None:
        note = F.transform("_short", lambda x: F.struct(F.lit("links").alias("source"), F.lit("shortener-expanded").alias("code"), F.lit(0.0).alias("weight"), F.lit(None).cast("string").alias("target"), F.concat(x["short_url"], F.lit(" leads to "), x["destination"]).alias("message"), F.lit(2_000_000).alias("seq")))
        shown = expanded.groupBy("email_id").agg(F.sort_array(F.collect_set(F.struct("short_url", "destination"))).alias("_short"))
        all_parts = all_parts.join(shown, "email_id", "left").withColumn("links", F.when(F.col("_short").isNull(), F.col("links")).otherwise(F.col("links").withField("findings", F.concat("links.findings", note)))).drop("_short")
    normal = text.normalise_plain if plain else text.normalise
    spoken = text.detect_language(F.col("_normal"))
    fused = fuse(all_parts.withColumn("_normal", normal(F.col("subject"), F.col("body"))), options)
    return fused.select(
        "email_id", "verdict", F.bround("score", 3).alias("score"), reasons(options).alias("reasons"), limitations().alias("limitations"),
        F.when(spoken == "ar", "ar").otherwise("en").alias("language"),
        F.struct("content", "headers", "links", "reputation", "attachments", "obfuscation").alias("breakdown"),
    )
