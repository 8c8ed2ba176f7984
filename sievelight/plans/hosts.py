"""What is known of each distinct host: registrable domain, platform, owner, impersonation, tracker."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import urls
from sievelight.functions.python_text import to_unicode
from sievelight.plans import dims


@dataclass(frozen=True)
class Catalogue:
    """The dimensions as tables; the defaults of ``dims`` unless others are given."""

    domains: DataFrame
    keywords: DataFrame
    platforms: DataFrame
    trackers: DataFrame
    suffixes: DataFrame

    @staticmethod
    def default(spark: SparkSession) -> Catalogue:
        return Catalogue(dims.brand_domains(spark), dims.brand_keywords(spark), dims.user_content_hosts(spark), dims.click_trackers(spark), dims.suffix_rules(spark))

    @staticmethod
    def from_files(spark: SparkSession, brands: str | None = None, trackers: str | None = None, suffixes: str | None = None) -> Catalogue:
        """From a JSON catalogue (brands with domains and keywords, userContentHosts), a list of trackers and a public suffix
        list; brands, their keywords and the hosts come from one file, so that no two catalogues mix. None: the defaults."""
        return Catalogue(dims.brand_domains(spark, brands), dims.brand_keywords(spark, brands), dims.user_content_hosts(spark, brands), dims.click_trackers(spark, trackers), dims.suffix_rules(spark, suffixes))


def _by_suffix(hosts: DataFrame, listed: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(host, hit): the first listed domain that is the host or above it. An equi-join of exploded suffixes."""
    each = hosts.where(~urls.is_ip(F.col("host"))).select("host", F.explode(urls.suffixes(F.col("host"))).alias("domain"))
    return each.join(listed, "domain").groupBy("host").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("hit"))


def owners(hosts: DataFrame, c: Catalogue) -> DataFrame:
    """(host, owner): the first brand whose domain the host is under, whatever is published there."""
    return _by_suffix(hosts, c.domains, ["brand"], ["brand_ord", "domain_ord"]).select("host", F.col("hit.brand").alias("owner"))


def impersonations(hosts: DataFrame, c: Catalogue, decode: bool = True) -> DataFrame:
    """(host, brand, kind, brand_domain) of hosts (host, registrable) that are dressed up as a brand.

    The catalogue is small and fixed, so each distinct host meets all of it; the first entry in catalogue order wins.
    ``decode=False`` reads labels without punycode decoding and stays in the JVM.
    """
    host, registrable = F.col("host"), F.col("registrable")
    fine = (F.length(host) <= 253) & ~F.exists(F.split(host, r"\."), lambda x: F.length(x) > 63) & ~urls.is_ip(host)
    above = owners(hosts.where(fine).select(F.col("registrable").alias("host")).distinct(), c).select(F.col("host").alias("registrable"), F.lit(True).alias("_known"))
    shown = urls.second_level_label(to_unicode(registrable) if decode else registrable)
    open_hosts = (
        hosts.where(fine).join(above, "registrable", "left").where("_known is null")
        .select("host", "registrable", shown.alias("label"), F.when(F.length(host) > F.length(registrable), F.left(host, F.length(host) - F.length(registrable) - 1)).otherwise("").alias("sub"))
        .withColumn("folded", urls.fold_homoglyphs(F.col("label")))
    )
    labelled = urls.with_registrable(c.domains.select("domain").distinct(), c.suffixes, "domain").select("domain", urls.second_level_label(F.col("registrable")).alias("brand_label"))
    entries = c.domains.join(labelled, "domain")
    n, m = F.length("brand_label"), F.col("match_label")
    label, folded, brand_label, sub = map(F.col, ("label", "folded", "brand_label", "sub"))
    distance = F.least(F.levenshtein(label, brand_label), F.levenshtein(folded, brand_label))
    in_sub = (sub != "") & (F.contains(sub, F.col("domain")) | (m & (n >= 4) & F.array_contains(F.split(sub, r"[.\-]"), brand_label)))
    in_domain = m & (F.array_contains(F.split(label, "-"), brand_label) | ((n >= 6) & F.contains(folded, brand_label) & (folded != brand_label)))
    homoglyph = m & (n >= 5) & (folded == brand_label) & (label != brand_label)
    typo = m & (n > 5) & (distance > 0) & (distance <= F.when(n >= 8, 2).otherwise(1))
    kind = F.when(in_sub, "brand-in-subdomain").when(in_domain, "brand-in-domain").when(homoglyph, "homoglyph").when(typo, "typosquat")
    # A catalogue of at most a few thousand entries, checked by Spark before it is broadcast; there is no key to join by.
    met = open_hosts.join(F.broadcast(entries)).withColumn("kind", kind).where("kind is not null")
    first = met.groupBy("host").agg(F.min_by(F.struct("brand", "kind", "domain"), F.struct("brand_ord", "domain_ord")).alias("hit"))
    return first.select("host", F.col("hit.brand").alias("looks_like"), F.col("hit.kind").alias("kind"), F.col("hit.domain").alias("brand_domain"))


def host_facts(hosts: DataFrame, c: Catalogue, decode: bool = True) -> DataFrame:
    """One row per distinct non-null host: registrable, platform, known_tld, owner (null on platforms), tracked, and what it
    looks like. The lookups run once per distinct host, not per link."""
    distinct = hosts.select("host").where("host is not null").distinct()
    base = urls.with_registrable(distinct, c.suffixes)
    listed = _by_suffix(distinct, c.platforms, ["domain"], ["ord"]).select("host", F.col("hit.domain").alias("_listed"))
    tracked = _by_suffix(distinct, c.trackers, ["domain"], ["domain"]).select("host", F.lit(True).alias("tracked"))
    placed = base.join(listed, "host", "left").withColumn("platform", F.coalesce("platform", "_listed")).drop("_listed")
    owned = placed.join(owners(distinct, c), "host", "left").withColumn("owner", F.when(F.col("platform").isNull(), F.col("owner")))
    return (
        owned.join(tracked, "host", "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))
        .join(impersonations(placed.select("host", "registrable"), c, decode), "host", "left")
        .withColumn("is_ip", urls.is_ip(F.col("host")))
    )


def mentioned_brands(names: DataFrame, c: Catalogue, name: str = "name", plain: bool = False) -> DataFrame:
    """(name, brand): the brand whose longest keyword is in a text, as words or, from 8 letters, with spaces removed."""
    from sievelight.functions import text

    squash = text.squash_plain if plain else text.squash
    keys = c.keywords.withColumn("key", squash(F.col("keyword"))).withColumn("key_joined", F.replace("key", F.lit(" "), F.lit("")))
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("s", squash(F.col(name)))
    as_words = F.contains(F.concat(F.lit(" "), F.col("s"), F.lit(" ")), F.concat(F.lit(" "), F.col("key"), F.lit(" ")))
    joined = (F.length("key_joined") >= 8) & F.contains(F.replace("s", F.lit(" "), F.lit("")), F.col("key_joined"))
    met = distinct.join(F.broadcast(keys)).where((F.col("key") != "") & (as_words | joined))
    best = met.groupBy(name).agg(F.max_by("brand", F.struct(F.length("key_joined"), -F.col("brand_ord"), -F.col("keyword_ord"))).alias("brand"))
    return best
