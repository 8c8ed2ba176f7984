"""The small dimensions that rules look things up in. Each can be replaced by a file or table of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A starter catalogue (name, domains, names in text, whether the domain's label may be matched in domains).
BRANDS = [
    ("PayPal", "paypal.com paypal.me paypalobjects.com", "paypal", True),
    ("Microsoft", "microsoft.com office.com office365.com outlook.com live.com onedrive.com aka.ms", "microsoft|office365|outlook|onedrive|sharepoint", True),
    ("Apple", "apple.com icloud.com me.com", "apple|icloud|itunes", True),
    ("Google", "google.com gmail.com googlemail.com youtube.com goo.gl youtu.be", "google|gmail|جوجل", True),
    ("Amazon", "amazon.com amazon.co.uk amazon.de amazonaws.com", "amazon|امازون", True),
    ("Meta", "facebook.com facebookmail.com fb.com instagram.com whatsapp.com", "facebook|instagram|whatsapp", True),
    ("LinkedIn", "linkedin.com lnkd.in", "linkedin", True),
    ("X (Twitter)", "x.com twitter.com t.co", "twitter", False),
    ("DHL", "dhl.com dhl.de", "dhl", True),
    ("Bank of America", "bankofamerica.com bofa.com", "bankofamerica", True),
    ("Arab Bank", "arabbank.com arabbank.jo", "arabbank|arab bank|البنك العربي", True),
    ("Arab National Bank", "anb.com.sa", "arab national bank|البنك العربي الوطني", True),
    ("GitHub", "github.com githubusercontent.com github.io", "github", True),
    ("Ledger", "ledger.com", "ledger live", True),
    ("eFAWATEERcom", "efawateercom.jo", "efawateercom", True),
    ("Cairo Amman Bank", "cab.jo", "cairo amman bank", False),
    ("Al Rajhi Bank", "alrajhibank.com.sa", "al rajhi|alrajhi|الراجحي", True),
    ("STC", "stc.com.sa", "stc pay", False),
]
# Where anyone can publish, and who rewrites links to count clicks.
USER_CONTENT_HOSTS = (
    "sites.google.com docs.google.com drive.google.com forms.gle storage.googleapis.com firebasestorage.googleapis.com "
    "forms.office.com forms.microsoft.com sharepoint.com 1drv.ms onedrive.live.com blob.core.windows.net web.core.windows.net "
    "s3.amazonaws.com r2.dev ipfs.io dweb.link cloudflare-ipfs.com trycloudflare.com workers.dev notion.site canva.site "
    "my.canva.site typeform.com jotform.com wixsite.com weebly.com godaddysites.com webflow.io framer.website glitch.me "
    "replit.app ngrok-free.app ngrok.io"
).split()
CLICK_TRACKERS = (
    "mandrillapp.com sendgrid.net awstrack.me list-manage.com mcsv.net mailchi.mp hubspotlinks.com mailgun.org "
    "sparkpostmail.com klaviyomail.com cmail19.com cmail20.com exacttarget.com rs6.net fireeye.com urldefense.com "
    "urldefense.proofpoint.com mimecastprotect.com cudasvc.com aweber.com sendibt2.com sendibt3.com spmailtechnolo.com "
    "klclick.com pstmrk.it createsend.com mlsend.com convertkit-mail.com convertkit-mail2.com activehosted.com "
    "omnisendlink.com customeriomail.com intercom-links.com"
).split()
#: A starter list of public suffixes: those of the tests and of the test tables.
SUFFIXES = (
    "com org net edu gov info biz io co me dev app jo sa uk us de fr es it jp ru pl so sc ml md sh rs py xyz zip mov tk ga "
    "online shop live top click example ms gl ly in page test be "
    "co.uk org.uk ac.uk gov.uk com.au co.nz co.jp com.br com.jo gov.jo edu.jo com.sa gov.sa com.eg co.in co.za"
).split()
PRIVATE_SUFFIXES = "github.io pages.dev web.app blogspot.com netlify.app vercel.app".split()


CATALOGUE = "brands array<struct<name string, domains array<string>, keywords array<string>, matchLabelInDomains boolean>>, userContentHosts array<string>"


def _catalogue_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).option("multiLine", True).json(path)


def brand_domains(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(brand_ord, domain_ord, brand, domain, match_label); ``path`` names a JSON catalogue with a ``brands`` array."""
    if path:
        brands = _catalogue_file(spark, path).select(F.posexplode("brands").alias("brand_ord", "b"))
        flat = brands.select("brand_ord", F.col("b.name").alias("brand"), F.coalesce("b.matchLabelInDomains", F.lit(True)).alias("match_label"), F.posexplode("b.domains").alias("domain_ord", "domain"))
        return flat.select("brand_ord", "domain_ord", "brand", "domain", "match_label")
    rows = [(i, j, name, d, match) for i, (name, domains, _, match) in enumerate(BRANDS) for j, d in enumerate(domains.split())]
    return spark.createDataFrame(rows, "brand_ord int, domain_ord int, brand string, domain string, match_label boolean")


def brand_keywords(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(brand_ord, keyword_ord, brand, keyword), of the same catalogue."""
    if path:
        brands = _catalogue_file(spark, path).select(F.posexplode("brands").alias("brand_ord", "b"))
        return brands.select("brand_ord", F.col("b.name").alias("brand"), F.posexplode("b.keywords").alias("keyword_ord", "keyword")).select("brand_ord", "keyword_ord", "brand", "keyword")
    rows = [(i, j, name, k) for i, (name, _, words, _) in enumerate(BRANDS) for j, k in enumerate(words.split("|"))]
    return spark.createDataFrame(rows, "brand_ord int, keyword_ord int, brand string, keyword string")


def user_content_hosts(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(ord, domain); ``path`` names a JSON catalogue with a ``userContentHosts`` array."""
    if path:
        return _catalogue_file(spark, path).select(F.posexplode("userContentHosts").alias("ord", "domain"))
    return spark.createDataFrame(list(enumerate(USER_CONTENT_HOSTS)), "ord int, domain string")


def click_trackers(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(domain); ``path`` names a text file with a domain a line."""
    if path:
        return spark.read.text(path).select(F.lower(F.trim("value")).alias("domain")).where("domain != '' and not startswith(domain, '#')").distinct()
    return spark.createDataFrame([(t,) for t in CLICK_TRACKERS], "domain string")


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(rule, division, kind); ``path`` names a public suffix list in its text format."""
    if path:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
        private = lines.where(F.contains("line", F.lit("BEGIN PRIVATE"))).agg(F.min("n").alias("begin"))
        marked = lines.crossJoin(private).where(~F.startswith("line", F.lit("//")) & (F.trim("line") != ""))  # one row on the right
        kind = F.when(F.startswith("line", F.lit("!")), "exception").when(F.startswith("line", F.lit("*.")), "wildcard").otherwise("normal")
        return marked.select(F.regexp_replace(F.trim("line"), r"^(!|\*\.)", "").alias("rule"), F.when(F.col("n") > F.col("begin"), "private").otherwise("icann").alias("division"), kind.alias("kind"))
    rows = [(s, "icann", "normal") for s in SUFFIXES] + [(s, "private", "normal") for s in PRIVATE_SUFFIXES]
    return spark.createDataFrame([*rows, ("ck", "icann", "wildcard"), ("www.ck", "icann", "exception")], "rule string, division string, kind string")
