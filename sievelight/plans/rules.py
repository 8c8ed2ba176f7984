"""Rules that turn mails into weighted findings, one component at a time.

Mails are rows of (email_id, subject, sender_name, sender_email, reply_to, body, raw_headers, links, attachments,
qr_code_urls); null lists are empty. A component's result is (email_id, findings, score, evaluated); a finding is
(source, code, weight, target, message, seq). Links and attachments keep the heaviest finding of each code; headers and
reputation keep all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import headers as H
from sievelight.functions import labels, text, urls
from sievelight.plans.hosts import Catalogue, host_facts, mentioned_brands
from sievelight.storage import materialise

MAX_LINKS = 200
QR_TEXT = "QR code"
FINDING = "struct<source:string,code:string,weight:double,target:string,message:string,seq:int>"
SUBMISSION = (
    "email_id long, subject string, sender_name string, sender_email string, reply_to string, body string, raw_headers string, "
    "links array<struct<text:string,href:string>>, attachments array<struct<name:string,mime_type:string>>, qr_code_urls array<string>"
)

# Endings of attachment names, and their weights below.
EXECUTABLE = "exe scr com pif bat cmd js jse vbs vbe wsf wsh hta ps1 msi lnk jar cpl reg dll appx msix".split()
DISK_IMAGE = "iso img vhd vhdx".split()
MARKUP = "html htm shtml xhtml svg mht mhtml".split()
MACRO = "docm dotm xlsm xltm xlam pptm ppam one onepkg".split()
ARCHIVE = "zip rar 7z gz tar ace arj cab".split()
DOCUMENT = "pdf doc docx xls xlsx jpg jpeg png txt".split()
PASSWORD = r"(?i)(?:password|passcode|pwd|pass|كلمة(?>\s*)(?:المرور|السر))(?>\s*)[:=]?(?>\s*)\S{3,}"


def finding(source: str, code: str, when: Column, weight: Column | float, message: Column | str, target: Column | None = None, seq: int = 0) -> Column:
    """A finding where ``when`` holds, else null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (F.lit(source), F.lit(code), lit(weight).cast("double"), (target if target is not None else F.lit(None)).cast("string"), lit(message).cast("string"), F.lit(seq))
    names = ("source", "code", "weight", "target", "message", "seq")
    return F.when(F.coalesce(when, F.lit(False)), F.struct(*(v.alias(n) for v, n in zip(values, names))))


def present(*findings: Column) -> Column:
    return F.filter(F.array(*findings), lambda f: f.isNotNull())


def heaviest_per_code(findings: Column) -> Column:
    """For each code its heaviest finding, the first of equals; heaviest first, otherwise in order."""
    order = lambda f: F.struct((-f["weight"]).alias("w"), f["seq"].alias("s"), f.alias("f"))
    ranked = F.transform(F.sort_array(F.transform(findings, order)), lambda x: x["f"])
    return F.aggregate(ranked, F.array().cast(f"array<{FINDING}>"), lambda kept, f: F.when(F.exists(kept, lambda k: k["code"] == f["code"]), kept).otherwise(F.concat(kept, F.array(f))))


def by_weight(findings: Column) -> Column:
    return F.transform(F.sort_array(F.transform(findings, lambda f: F.struct((-f["weight"]).alias("w"), f["seq"].alias("s"), f.alias("f")))), lambda x: x["f"])


def score_of(findings: Column) -> Column:
    return labels.noisy_or(F.transform(findings, lambda f: f["weight"]))


def with_qr_links(mails: DataFrame) -> DataFrame:
    """QR destinations are links too, put first: up to ten that are not among the links titled so already."""
    links = F.coalesce("links", F.array().cast("array<struct<text:string,href:string>>"))
    titled = F.transform(F.filter(links, lambda x: x["text"] == QR_TEXT), lambda x: x["href"])
    fresh = F.filter(F.slice(F.coalesce("qr_code_urls", F.array().cast("array<string>")), 1, 10), lambda u: ~F.array_contains(titled, u))
    return mails.withColumn("links", F.concat(F.transform(fresh, lambda u: F.struct(F.lit(QR_TEXT).alias("text"), u.alias("href"))), links))


def exploded_links(mails: DataFrame) -> DataFrame:
    """(email_id, idx, text, href unwrapped, host, shown): shown is the host that a link's text claims.

    Over MAX_LINKS links, each host gets a turn before any gets a second, so that decoys do not crowd a link out.
    """
    each = mails.select("email_id", F.size("links").alias("_n"), F.posexplode("links").alias("idx", "link"))
    opened = each.select("email_id", "_n", "idx", F.col("link.text").alias("text"), urls.unwrap(F.col("link.href")).alias("href"))
    hosted = opened.withColumn("host", urls.host_of(F.col("href")))
    turn = F.row_number().over(Window.partitionBy("email_id", F.coalesce("host", "href")).orderBy("idx"))
    seat = F.row_number().over(Window.partitionBy("email_id").orderBy("_turn", "idx"))
    kept = hosted.where(F.col("_n") <= MAX_LINKS).union(hosted.where(F.col("_n") > MAX_LINKS).withColumn("_turn", turn).withColumn("_seat", seat).where(F.col("_seat") <= MAX_LINKS).drop("_turn", "_seat"))
    t = text.strip(F.col("text"))
    shown = F.when(t.rlike(r"(?i)^(https?://)?([a-z0-9\-]+\.)+[a-z]{2,}(/\S*)?$"), urls.host_of(t))
    return kept.drop("_n").withColumn("shown", shown)


def facts_for(mails: DataFrame, links: DataFrame, c: Catalogue, decode: bool = True) -> DataFrame:
    """Host facts of all hosts that the rules ask about, written once."""
    parsed = H.parse_headers(F.col("raw_headers"))
    senders = mails.select(F.explode(F.array(
        urls.email_domain(F.col("sender_email")), urls.email_domain(F.col("reply_to")), urls.email_domain(H.first_address(H.get_first(parsed, "From"))),
        urls.email_domain(H.first_address(H.get_first(parsed, "Reply-To"))), urls.email_domain(F.nullif(F.regexp_extract(F.coalesce("sender_name", F.lit("")), H.ADDRESS, 0), F.lit(""))),
    )).alias("host"))
    hosts = links.select(F.col("host")).union(links.select("shown")).union(senders)
    return materialise(host_facts(hosts, c, decode), "host_facts")


def _about(facts: DataFrame, prefix: str) -> DataFrame:
    return facts.select(*(F.col(k).alias(f"{prefix}_{k}") for k in facts.columns))


def link_findings(mails: DataFrame, links: DataFrame, facts: DataFrame, c: Catalogue) -> DataFrame:
    """The links component."""
    senders = mails.select("email_id", urls.email_domain(F.col("sender_email")).alias("sender"), F.size("links").alias("_links"), "qr_code_urls")
    sided = senders.join(_about(facts, "s"), F.col("sender") == F.col("s_host"), "left").select("email_id", "s_owner")
    known = links.join(_about(facts, "h"), F.col("host") == F.col("h_host")).join(_about(facts, "t"), F.col("shown") == F.col("t_host"), "left").join(sided, "email_id", "left")
    href, parts = F.col("href"), urls.url_parts(urls.browser_form(F.col("href")))
    platform = F.col("h_platform")
    user_part = F.concat(F.left(F.col("host"), F.greatest(F.length("host") - F.length(platform), F.lit(0))), parts["path"], parts["query"])
    labelled = [(r["brand"], r["domain"].split(".")[0]) for r in c.domains.where("match_label").orderBy("brand_ord", "domain_ord").select("brand", "domain").collect()]  # the catalogue
    near = lambda t, n: F.array_contains(t["words"], n) | (F.contains(t["joined"], F.lit(n)) if len(n) >= 7 else F.lit(False))
    first_named = lambda t: F.coalesce(*[F.when(near(t, n), F.lit(b)) for b, n in labelled if len(n) >= 5], F.lit(None).cast("string"))
    parted = F.filter(F.split(F.lower(user_part), "[^a-z0-9]+"), lambda t: t != "")
    named = F.when(platform.isNotNull(), text.let(text.let(parted, lambda t: F.struct(t.alias("words"), F.array_join(t, "").alias("joined"))), first_named))
    mismatch = F.col("t_host").isNotNull() & F.col("t_known_tld") & (F.col("t_registrable") != F.col("h_registrable"))
    same_owner = platform.isNull() & (F.col("t_owner") == F.col("h_owner"))
    claimed = F.coalesce("t_owner", "t_looks_like")
    own_redirect = (F.col("s_owner") == F.col("h_owner")) & platform.isNull()
    shows = mismatch & ~F.coalesce(same_owner, F.lit(False)) & ~F.coalesce(own_redirect, F.lit(False))
    file_name = shows & claimed.isNull() & urls.looks_like_file_name(text.strip(F.col("text")), F.col("shown"))
    tracked = shows & ~F.coalesce(file_name, F.lit(False)) & F.col("h_tracked") & (claimed.isNull() | F.coalesce(F.col("t_owner") == F.col("s_owner"), F.lit(False)))
    plain = shows & ~F.coalesce(file_name, F.lit(False)) & ~F.coalesce(tracked, F.lit(False))
    say = lambda *parts: F.concat(*(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    host, ip = F.col("host"), F.col("h_is_ip")
    shown = F.col("shown")
    found = present(
        finding("links", "ip-url", ip, 0.45, say("Link to a bare IP address: ", host), seq=1),
        finding("links", "punycode", ~ip & F.contains(host, F.lit("xn--")), 0.30, say("Link to an internationalised host: ", host), seq=2),
        finding("links", "lookalike-domain", ~ip & F.col("h_looks_like").isNotNull(), 0.60, say("Link domain imitates ", F.col("h_looks_like"), " (", F.col("h_kind"), ")"), F.col("h_registrable"), 3),
        finding("links", "user-content-host", ~ip & platform.isNotNull(), 0.15, say("Anyone can publish on ", platform), seq=4),
        finding("links", "brand-on-user-content", ~ip & platform.isNotNull() & F.col("h_looks_like").isNull() & named.isNotNull() & ~F.coalesce(named == F.col("h_owner"), F.lit(False)), 0.50, say("A page on ", platform, " calls itself ", named), seq=5),
        finding("links", "shortener", ~ip & urls.is_shortener(host), 0.15, say("Shortened link: ", host), seq=6),
        finding("links", "suspicious-tld", ~ip & urls.has_suspicious_tld(host), 0.12, say("Often abused ending: .", urls.tld(host)), seq=7),
        finding("links", "userinfo-url", ~ip & (parts["userinfo"] != ""), 0.40, say("The host stands after an @: ", host), seq=8),
        finding("links", "filename-link-text", ~ip & file_name, 0.10, say("Text reads like a file name: ", shown), seq=9),
        finding("links", "tracked-link", ~ip & tracked, 0.10, say("Text shows ", shown, ", tracked by ", host), seq=10),
        finding("links", "text-href-mismatch", ~ip & plain, 0.45, say("Text shows ", shown, " but goes to ", host), seq=11),
    )
    placed = F.transform(found, lambda f: f.withField("seq", (F.col("idx") * 20 + f["seq"]).cast("int")))
    each = known.where(~F.lower(href).rlike("^(mailto:|tel:|#)")).select("email_id", F.explode(placed).alias("f"))
    # The heaviest of each code before rows of a mail come together: at most eleven remain.
    first = each.groupBy("email_id", "f.code").agg(F.min_by("f", F.struct(-F.col("f.weight"), F.col("f.seq"))).alias("f"))
    grouped = first.groupBy("email_id").agg(F.collect_list("f").alias("findings"))
    qr = finding("links", "qr-code-link", F.size("qr_code_urls") > 0, 0.20, say("QR code to ", F.coalesce(urls.host_of(F.get("qr_code_urls", F.lit(0))), F.get("qr_code_urls", F.lit(0)))), seq=1_000_000)
    full = senders.join(grouped, "email_id", "left").withColumn("findings", F.concat(by_weight(F.coalesce("findings", F.array().cast(f"array<{FINDING}>"))), present(qr)))
    return full.select("email_id", "findings", score_of(F.col("findings")).alias("score"), F.lit(True).alias("evaluated"))


def header_findings(mails: DataFrame, links: DataFrame, facts: DataFrame, c: Catalogue, plain: bool = False) -> DataFrame:
    """The headers component: who the mail claims to be from, and what the receiver's checks say."""
    h = H.parse_headers(F.col("raw_headers"))
    own = mails.select("email_id", "sender_email", "sender_name", "reply_to", h.alias("h")).select(
        "email_id", "h",
        urls.email_domain(F.coalesce(H.first_address(H.get_first(F.col("h"), "From")), F.col("sender_email"))).alias("sender"),
        F.coalesce("sender_name", H.display_name(H.get_first(F.col("h"), "From"))).alias("name"),
        urls.email_domain(F.coalesce(H.first_address(H.get_first(F.col("h"), "Reply-To")), F.col("reply_to"))).alias("reply"),
    ).withColumn("named_domain", urls.email_domain(F.nullif(F.regexp_extract(F.coalesce("name", F.lit("")), H.ADDRESS, 0), F.lit(""))))
    mentions = mentioned_brands(own, c, "name", plain).select(F.col("name").alias("_name"), F.col("brand").alias("mentioned"))
    know = lambda p, on: (_about(facts.select("host", "registrable", "owner", "platform", "looks_like", "kind"), p), F.col(on) == F.col(f"{p}_host"), "left")
    k = own.join(*know("s", "sender")).join(*know("r", "reply")).join(*know("n", "named_domain")).join(mentions, F.col("name") == F.col("_name"), "left")
    # All links that count lead to the sender's brand: no link that does not.
    target = links.where(~urls.is_neutral_link(F.col("href"))).join(_about(facts.select("host", "owner"), "l"), F.col("host") == F.col("l_host"), "left").groupBy("email_id").agg(F.collect_set(F.coalesce("l_owner", F.lit(""))).alias("link_owners"))  # at most one of each brand
    k = k.join(target, "email_id", "left")
    top = H.get_first(F.col("h"), "Authentication-Results")
    auth = {m: H.auth_result(top, m) for m in ("spf", "dkim", "dmarc", "compauth")}
    given, checked = F.size("h") > 0, top.isNotNull()
    sender, name_free, reply_free = F.col("sender").isNotNull(), urls.is_free_mail(F.col("sender")), urls.is_free_mail(F.col("reply"))
    brand_claim = sender & F.col("mentioned").isNotNull() & ~F.coalesce(F.col("mentioned") == F.col("s_owner"), F.lit(False))
    redirected = sender & (F.col("r_registrable") != F.col("s_registrable"))
    passed = checked & (auth["spf"] == "pass") & (auth["dkim"] == "pass") & (auth["dmarc"] == "pass")
    all_own = F.forall(F.coalesce("link_owners", F.array().cast("array<string>")), lambda o: o == F.col("s_owner"))
    say = lambda *parts: F.concat(*(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    f = lambda code, when, weight, message, seq, target=None: finding("headers", code, when, weight, message, target, seq)
    found = present(
        f("lookalike-sender", sender & F.col("s_looks_like").isNotNull(), 0.65, say("Sender domain imitates ", F.col("s_looks_like"), " (", F.col("s_kind"), ")"), 1, F.col("s_registrable")),
        f("brand-display-freemail", brand_claim & name_free, 0.50, say("Name says ", F.col("mentioned"), ", sent from a free account at ", F.col("sender")), 2),
        f("brand-display-mismatch", brand_claim & ~name_free, 0.40, say("Name says ", F.col("mentioned"), ", sent from ", F.col("sender")), 3),
        f("display-name-address", sender & (F.col("n_registrable") != F.col("s_registrable")), 0.45, say("Name shows @", F.col("named_domain"), ", sent from @", F.col("sender")), 4),
        f("reply-to-freemail", redirected & reply_free, 0.35, say("Replies go to a free mailbox at ", F.col("reply")), 5),
        f("reply-to-mismatch", redirected & ~reply_free, 0.20, say("Replies go to ", F.col("reply")), 6),
        f("auth-missing", given & ~checked, 0.10, "No Authentication-Results header", 7),
        f("dmarc-fail", checked & (auth["dmarc"] == "fail"), 0.50, "DMARC failed", 8),
        f("compauth-fail", checked & (auth["compauth"] == "fail") & (auth["dmarc"] != "fail"), 0.35, "Composite authentication failed", 9),
        f("spf-fail", checked & auth["spf"].isin("fail", "softfail"), F.when(auth["spf"] == "fail", 0.35).otherwise(0.15), say("SPF ", auth["spf"]), 10),
        f("dkim-fail", checked & (auth["dkim"] == "fail"), 0.30, "DKIM failed", 11),
        f("auth-none", checked & (auth["dkim"] == "none") & auth["spf"].isin("none", "neutral"), 0.15, "Neither DKIM nor an SPF pass", 12),
        f("auth-pass", passed, 0.0, "SPF, DKIM and DMARC passed", 13),
        f("verified-brand-sender", passed & F.col("s_owner").isNotNull() & F.col("s_platform").isNull() & ~name_free & all_own, 0.0, say("From the real domain of ", F.col("s_owner")), 14),
    )
    done = k.select("email_id", by_weight(found).alias("findings"), sender.alias("evaluated"))
    return done.select("email_id", "findings", score_of(F.col("findings")).alias("score"), "evaluated")


def attachment_findings(mails: DataFrame) -> DataFrame:
    """The attachments component, from names alone; the first fifty."""
    password = F.coalesce(F.col("body").rlike(PASSWORD), F.lit(False))
    bidi = "‮"

    def of(a: Column, i: Column) -> Column:
        raw = text.strip(a["name"])
        name = F.translate(raw, bidi, "")
        p = F.split(name, r"\.")
        ext = F.lower(F.when(F.size(p) > 1, F.element_at(p, -1)).otherwise(""))
        inner = F.lower(F.trim(F.when(F.size(p) > 2, F.element_at(p, -2)).otherwise("")))
        one = lambda code, when, weight, what, seq: finding("attachments", code, when, weight, F.concat(name, F.lit(what)), name, seq)
        is_exe, is_disk, is_markup, is_macro = ext.isin(EXECUTABLE), ext.isin(DISK_IMAGE), ext.isin(MARKUP), ext.isin(MACRO)
        found = present(
            one("rtlo-filename", F.contains(raw, F.lit(bidi)), 0.60, ": a hidden character disguises the type", 1),
            one("double-extension", inner.isin(DOCUMENT) & (is_exe | is_markup | is_disk), 0.60, ": pretends to be a document", 2),
            one("executable-attachment", is_exe, 0.60, ": a program or script", 3),
            one("disk-image-attachment", is_disk, 0.50, ": a disk image", 4),
            one("html-attachment", is_markup, 0.45, ": a web page", 5),
            one("macro-attachment", is_macro, 0.40, ": may hold macros", 6),
            one("password-archive", ext.isin(ARCHIVE) & password, 0.40, ": an archive whose password is in the mail", 7),
        )
        return F.transform(found, lambda f: f.withField("seq", (i * 10 + f["seq"]).cast("int")))

    listed = F.slice(F.coalesce("attachments", F.array().cast("array<struct<name:string,mime_type:string>>")), 1, 50)
    done = mails.select("email_id", heaviest_per_code(F.flatten(F.transform(listed, of))).alias("findings"))
    return done.select("email_id", "findings", score_of(F.col("findings")).alias("score"), F.lit(True).alias("evaluated"))


def obfuscation_findings(mails: DataFrame) -> DataFrame:
    """The obfuscation component: words that mix alphabets."""
    in_name = text.mixed_script_words(F.col("sender_name"))
    in_text = F.slice(F.array_distinct(text.mixed_script_words(F.concat_ws(" ", "subject", "body"))), 1, 3)
    found = present(
        finding("obfuscation", "mixed-script-sender", F.size(in_name) > 0, 0.50, F.concat(F.lit("Mixed alphabets in the name: "), F.get(in_name, F.lit(0))), seq=1),
        finding("obfuscation", "mixed-script-text", F.size(in_text) > 0, 0.35, F.concat(F.lit("Mixed alphabets: "), F.array_join(in_text, ", ")), seq=2),
    )
    done = mails.select("email_id", found.alias("findings"))
    return done.select("email_id", "findings", score_of(F.col("findings")).alias("score"), F.lit(True).alias("evaluated"))


def feed_tables(lines: DataFrame, feed_order: list[str], host_allowed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(urls, hosts) of threat-feed lines (feed, line): key or host and the first feed that lists it."""
    line = text.strip(F.col("line"))
    rank = F.array_position(F.array(*map(F.lit, feed_order)), F.col("feed"))
    keyed = lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select("feed", urls.feed_key(line).alias("key"), rank.alias("rank")).where("key is not null")
    hosts = keyed.withColumn("host", urls.feed_host(F.col("key")))
    allowed = hosts.where(host_allowed) if host_allowed is not None else hosts
    first = lambda df, k: df.groupBy(k).agg(F.min_by("feed", "rank").alias("feed"))
    return first(keyed, "key"), first(allowed, "host")


def match_feeds(links: DataFrame, feed_urls: DataFrame, feed_hosts: DataFrame, url: str = "url") -> DataFrame:
    """``links`` with feed, exact and indicator of the listed ones: the exact address first, then the host."""
    keyed = links.withColumn("_key", urls.feed_key(F.col(url))).withColumn("_host", urls.feed_host(F.col("_key")))
    by_url = keyed.join(feed_urls.select(F.col("key").alias("_key"), F.col("feed").alias("_f1")), "_key", "left")
    both = by_url.join(feed_hosts.select(F.col("host").alias("_host"), F.col("feed").alias("_f2")), "_host", "left")
    hit = both.withColumn("feed", F.coalesce("_f1", "_f2")).where("feed is not null")
    return hit.withColumn("exact", F.col("_f1").isNotNull()).withColumn("indicator", F.when(F.col("_f1").isNotNull(), F.col("_key")).otherwise(F.col("_host"))).drop("_key", "_host", "_f1", "_f2")


def reputation_findings(
    mails: DataFrame, links: DataFrame, facts: DataFrame, now: Column, feeds: tuple[DataFrame, DataFrame] | None = None,
    registrations: DataFrame | None = None, threats: DataFrame | None = None, established_days: int = 365, max_domains: int = 8,
) -> DataFrame:
    """The reputation component, from tables: feeds (urls, hosts), registrations (domain, registered_ts, checked) and threats
    (url, threat). A mail is evaluated if any source had an answer."""
    first = links.where(F.lower("href").rlike("^https?://")).groupBy("email_id", "href").agg(F.min("idx").alias("idx"))
    asked = first.withColumn("_r", F.row_number().over(Window.partitionBy("email_id").orderBy("idx"))).where("_r <= 50").select("email_id", F.col("href").alias("url"), "idx", urls.host_of(F.col("href")).alias("host"))
    say = lambda *parts: F.concat(*(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    f = lambda code, when, weight, message, target, seq: finding("reputation", code, when, weight, message, target, seq)
    found: list[DataFrame] = []
    if feeds:
        hit = match_feeds(asked, *feeds)
        found.append(hit.select("email_id", F.explode(present(
            f("blocklisted-url", F.col("exact"), 0.90, say("Listed by ", F.col("feed")), F.col("indicator"), 1),
            f("blocklisted-host", ~F.col("exact"), 0.70, say("The host is listed by ", F.col("feed")), F.col("indicator"), 1),
        )).alias("f"), "idx"))
    if threats is not None:
        flagged = asked.join(threats, "url").groupBy("email_id", "url").agg(F.min("threat").alias("threat"), F.min("idx").alias("idx"))
        found.append(flagged.select("email_id", F.explode(present(f("safe-browsing", F.lit(True), 0.90, say("Flagged as ", text.describe_threat(F.col("threat"))), F.col("url"), 2))).alias("f"), "idx"))
    if registrations is not None:
        sender = mails.select("email_id", urls.email_domain(F.col("sender_email")).alias("host"), F.lit(1_000_000).alias("idx"))
        of_sender = sender.join(facts.select("host", "registrable"), "host").select("email_id", F.col("registrable").alias("sender_domain"))
        hosts = asked.select("email_id", "host", "idx").union(sender).join(facts, "host").where("not is_ip and owner is null and platform is null")
        domains = hosts.where(~urls.is_free_mail(F.col("registrable"))).groupBy("email_id", "registrable").agg(F.min("idx").alias("idx"))
        few = domains.withColumn("_r", F.row_number().over(Window.partitionBy("email_id").orderBy("idx"))).where(F.col("_r") <= max_domains)
        aged = few.join(registrations.where("checked and registered_ts is not null"), F.col("registrable") == F.col("domain")).join(of_sender, "email_id", "left").withColumn("age", labels.age_days(now, F.col("registered_ts")))
        age = F.col("age")
        found.append(aged.select("email_id", F.explode(F.concat(F.array(F.lit(None).cast(FINDING)), present(
            f("new-domain", age < 30, 0.50, say(F.col("domain"), " was registered ", text.days(age), " ago"), F.col("domain"), 3),
            f("young-domain", (age >= 30) & (age < 180), 0.20, say(F.col("domain"), " was registered ", text.days(age), " ago"), F.col("domain"), 3),
            f("established-sender", (age >= established_days) & (F.col("domain") == F.col("sender_domain")), 0.0, say("The sender's domain is ", text.days(age), " old"), F.col("domain"), 3),
        ))).alias("f"), "idx"))
    always = feeds is not None or threats is not None
    none = mails.select("email_id", F.lit(None).cast(FINDING).alias("f"), F.lit(0).alias("idx"), F.lit(always).alias("sure"))
    every = reduce(DataFrame.union, [x.withColumn("sure", F.lit(True)) for x in found], none)
    # A mail has at most 50 addresses and ``max_domains`` domains here.
    placed = F.when(F.col("f").isNotNull(), F.col("f").withField("seq", (F.col("f.seq") * 10_000_000 + F.col("idx")).cast("int")))
    grouped = every.withColumn("f", placed).groupBy("email_id").agg(F.collect_list("f").alias("findings"), F.max("sure").alias("evaluated"))
    done = grouped.select("email_id", by_weight(F.col("findings")).alias("findings"), "evaluated")
    return done.select("email_id", "findings", score_of(F.col("findings")).alias("score"), "evaluated")


def expand_short_links(links: DataFrame, hops: DataFrame, depth: int = 5) -> DataFrame:
    """(email_id, short_url, destination, hops): the end of the chain of redirects, followed while hosts are shorteners."""
    start = links.where(urls.is_shortener(F.col("host"))).select("email_id", F.col("href").alias("short_url"), F.col("href").alias("now"), F.lit(0).alias("hops")).distinct()
    step = hops.where(F.col("status").between(300, 399)).select(F.col("short_url").alias("_from"), F.col("location").alias("_to"))
    for _ in range(depth):
        moved = start.join(step, (F.col("now") == F.col("_from")) & urls.is_shortener(urls.host_of(F.col("now"))), "left")
        start = moved.select("email_id", "short_url", F.coalesce("_to", "now").alias("now"), (F.col("hops") + F.col("_to").isNotNull().cast("int")).alias("hops"))
    return start.where(F.col("now") != F.col("short_url")).select("email_id", "short_url", F.col("now").alias("destination"), "hops")
