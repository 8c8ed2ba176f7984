"""URLs, hosts and domains over columns. What cannot be parsed is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import let, strip

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s\[\]\\]+)(?::([0-9]{1,5}))?([^?#]*)(\?[^#]*)?(#.*)?$"

# Fixed values.
FREE_MAIL = (
    "gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com ymail.com aol.com icloud.com me.com "
    "mail.com gmx.com gmx.net proton.me protonmail.com yandex.com yandex.ru zoho.com mail.ru"
).split()
SHORTENERS = (
    "bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly rebrand.ly cutt.ly shorturl.at rb.gy t.ly tiny.cc bl.ink s.id v.gd "
    "shorte.st adf.ly qrco.de"
).split()
SUSPICIOUS_TLDS = (
    "zip mov xyz top tk ml ga cf gq click country work support rest fit cam quest sbs cfd icu buzz monster lol live online shop"
).split()
CODE_FILE_ENDINGS = "py md sh rs".split()


def url_parts(url: Column) -> Column:
    """struct(scheme, userinfo, host, port, path, query) of an absolute URL with an authority; null if it is none."""

    def of(u: Column) -> Column:
        part = lambda i: F.regexp_extract(u, _URL, i)
        fields = F.struct(
            F.lower(part(1)).alias("scheme"), part(2).alias("userinfo"), F.lower(part(3)).alias("host"),
            F.nullif(part(4), F.lit("")).cast("int").alias("port"), let(part(5), lambda p: F.when(p == "", "/").otherwise(p)).alias("path"), part(6).alias("query"),
        )
        return F.when(u.rlike(_URL), fields)

    return let(url, of)


def browser_form(url: Column) -> Column:
    """The forms that browsers accept, written out: inner tabs and line ends, backslashes, ``//host``, ``https:host``."""

    def slashes(u: Column) -> Column:
        return let(F.regexp_extract(u, r"(?s)^[^?#]*", 0), lambda head: F.concat(F.translate(head, "\\", "/"), F.substring(u, F.length(head) + 1, F.length(u))))

    def complete(u: Column) -> Column:
        short = F.lower(u).rlike(r"^https?:(?!//)")
        rest = F.regexp_replace(u, r"(?i)^https?:/*", "")
        whole = F.concat(F.lower(F.substring_index(u, ":", 1)), F.lit("://"), rest)
        return F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(short, whole).otherwise(u)

    return let(let(F.translate(url, "\t\r\n", ""), slashes), complete)


def host_of(url: Column) -> Column:
    """The lower-case host of an http(s) URL, with or without scheme; null for anything else."""

    def with_scheme(u: Column) -> Column:
        return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?![0-9]{1,5}(?:[/?#]|$))"), u).otherwise(F.concat(F.lit("http://"), u))

    def host(parts: Column) -> Column:
        h = F.rtrim(parts["host"], F.lit("."))
        return F.when(parts["scheme"].isin("http", "https") & (h != ""), h)

    return let(url_parts(let(browser_form(strip(url)), with_scheme)), host)


def email_domain(email: Column) -> Column:
    """The lower-case domain of an address, by itself or in angle brackets."""

    def of(e: Column) -> Column:
        after = F.lower(F.trim(F.regexp_replace(F.substring_index(e, "@", -1), "[>\\s]+$", "")))
        return F.when(F.contains(e, F.lit("@")), F.nullif(after, F.lit("")))

    return let(strip(email), of)


def is_ip(host: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    v4 = rf"^{octet}(\.{octet}){{3}}$"
    bare = F.translate(host, "[]", "")
    return F.coalesce(bare.rlike(v4) | bare.rlike(r"^[0-9a-f]*:[0-9a-f:.]*$") | bare.rlike(r"^(0x[0-9a-f]+|[0-9]+)$"), F.lit(False))


def second_level_label(registrable: Column) -> Column:
    return F.substring_index(registrable, ".", 1)


def tld(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def same_or_subdomain(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: what a domain list is joined to by equality."""
    p = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))


def fold_homoglyphs(label: Column) -> Column:
    """paypa1 -> paypal, rnicrosoft -> microsoft."""
    t = F.replace(F.replace(F.lower(label), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    return F.translate(t, "013547@аеорсхуіον-", "olesataaeopcxyiov")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def is_free_mail(domain: Column) -> Column:
    return F.coalesce(domain.isin(FREE_MAIL), F.lit(False))


def is_shortener(host: Column) -> Column:
    return F.coalesce(host.isin(SHORTENERS), F.lit(False))


def has_suspicious_tld(host: Column) -> Column:
    return F.coalesce(tld(host).isin(SUSPICIOUS_TLDS), F.lit(False))


def _unwrap_once(href: Column) -> Column:
    """The target inside a redirector's query; null if there is none."""
    return let(url_parts(href), _target)


def _target(p: Column) -> Column:
    google = same_or_subdomain(p["host"], F.lit("google.com")) & (p["path"] == "/url")
    outlook = same_or_subdomain(p["host"], F.lit("safelinks.protection.outlook.com"))
    value = lambda name: F.try_url_decode(F.regexp_extract(p["query"], rf"(?i)[?&]{name}=([^&]*)", 1))
    return F.nullif(F.when(google, value("q")).when(outlook, value("url")), F.lit(""))


def unwrap(href: Column, depth: int = 5) -> Column:
    """Redirectors peeled, nested ones too; what is nested deeper than ``depth`` is empty, and so has no host."""
    state = F.struct(strip(href).alias("now"), F.lit(False).alias("deep"))

    def peel(s: Column, i: Column) -> Column:
        step = lambda inner: F.struct(F.coalesce(F.when(i <= depth, strip(inner)), s["now"]).alias("now"), ((i > depth) & inner.isNotNull()).alias("deep"))
        return let(_unwrap_once(s["now"]), step)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth + 1)), state, peel, lambda s: F.when(s["deep"], "").otherwise(s["now"]))


def is_neutral_link(href: Column) -> Column:
    """Links that are no destination: mailto, tel, and the maps links that a mail client adds."""
    h = strip(href)
    maps = lambda p: p["scheme"].isin("http", "https") & p["host"].isin("www.google.com", "google.com", "maps.google.com") & F.startswith(p["path"], F.lit("/maps"))
    return F.lower(h).rlike("^(mailto|tel):") | F.coalesce(let(url_parts(h), maps), F.lit(False))


def looks_like_file_name(text: Column, host: Column) -> Column:
    return tld(host).isin(CODE_FILE_ENDINGS) & ~F.contains(text, F.lit("/")) & ~F.startswith(F.lower(text), F.lit("www."))


def feed_key(url: Column) -> Column:
    """What a threat feed is matched by: no scheme, fragment or trailing slash, a port only if it is unusual."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))

    def key(p: Column) -> Column:
        usual = p["port"].isNull() | ((p["scheme"] == "http") & (p["port"] == 80)) | ((p["scheme"] == "https") & (p["port"] == 443))
        tail = F.regexp_replace(F.concat(p["path"], p["query"]), "/+$", "")
        joined = F.concat(p["host"], F.when(usual, "").otherwise(F.concat(F.lit(":"), p["port"].cast("string"))), tail)
        return F.when(p["scheme"].isin("http", "https"), joined)

    return let(url_parts(strip(full)), key)


def feed_host(key: Column) -> Column:
    return F.regexp_extract(key, r"^[^:/?]+", 0)


def is_public_address(ip: Column) -> Column:
    """Globally routable unicast only; an IPv4 address inside an IPv6 one counts as such."""
    ip = F.regexp_replace(F.lower(ip), r"^::ffff:(?=[0-9.]+$)", "")
    v4 = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    octet = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("int")
    a, b, c = octet(1), octet(2), octet(3)
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & (c == 0)) | ((a == 198) & b.isin(18, 19))
    )
    v6 = ip.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~ip.isin("::", "::1") & ~ip.rlike("^(fe[89a-f]|f[cd]|ff)")
    return F.coalesce(F.when(v4, ~private).otherwise(v6), F.lit(False))


def rate_key(ip: Column) -> Column:
    """The bucket of a client: an IPv4 address, also one mapped into IPv6, by itself; IPv6 by its first 64 bits, whatever the
    spelling; ``ip:unknown`` for null."""

    def groups(t: Column) -> Column:
        halves = F.split(t, "::")
        side = lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), ":"), lambda g: g != "")
        left, right = side(F.get(halves, F.lit(0))), side(F.get(halves, F.lit(1)))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
        full = F.when(F.size(halves) > 1, F.concat(left, zeros, right)).otherwise(left)
        return F.transform(F.slice(full, 1, 4), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))

    def named(t: Column) -> Column:
        v4 = F.regexp_extract(t, r"^(?:0*:){2,5}(?:0*:)?ffff:([0-9.]+)$", 1)
        prefix = F.regexp_replace(F.array_join(groups(t), ":"), "(^|:)0(:0)*$", "")
        v6 = F.concat(prefix, F.lit("::/64"))
        return F.concat(F.lit("ip:"), F.when(t.isNull(), t).when(~F.contains(t, F.lit(":")), t).when(v4 != "", v4).otherwise(v6))

    return F.coalesce(let(F.lower(F.regexp_replace(F.trim(ip), r"^\[|\]$|%.*$", "")), named), F.lit("ip:unknown"))


def is_secure_endpoint(url: Column) -> Column:
    safe = lambda p: (p["scheme"] == "https") | ((p["scheme"] == "http") & p["host"].isin("localhost", "127.0.0.1"))
    return F.coalesce(let(url_parts(url), safe), F.lit(False))


def with_registrable(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Adds registrable, suffix, platform (a private suffix above the host) and known_tld to distinct ``hosts``.

    ``rules`` (rule, division, kind) is a public suffix list; the longest rule wins, an exception beats all. A host's
    suffixes are joined to it by equality, so the plan is a hash join whatever the length of the list.
    """
    each = hosts.select(host, F.posexplode(suffixes(F.col(host))).alias("_pos", "_suffix"))
    listed = rules.select("rule", "division", "kind")
    plain = each.join(listed.where("kind = 'normal'"), F.col("_suffix") == F.col("rule"))
    below = each.where(F.contains("_suffix", F.lit("."))).withColumn("_suffix", F.regexp_replace("_suffix", r"^[^.]+\.", ""))
    wild = below.join(listed.where("kind = 'wildcard'"), F.col("_suffix") == F.col("rule"))
    free = each.join(listed.where("kind = 'exception'"), F.col("_suffix") == F.col("rule"))
    # An exception comes before any rule; its suffix is one label shorter than the rule.
    shaped = lambda df, shift, first: df.select(host, (F.col("_pos") + shift).alias("pos"), "division", (F.col("_pos") - first).alias("order"))
    hits = shaped(plain, 0, 0).union(shaped(wild, 0, 0)).union(shaped(free, 1, 1000))
    won = hits.groupBy(host).agg(F.min_by(F.struct("pos", "division"), "order").alias("_hit"))
    p = F.split(F.col(host), r"\.")
    pos = F.coalesce(F.col("_hit.pos"), F.size(p) - 1)
    tail = lambda i: F.array_join(F.slice(p, i + 1, F.size(p)), ".")
    found = hosts.join(won, host, "left")
    ip = is_ip(F.col(host))
    registrable = F.when(ip | (pos < 1), F.col(host)).otherwise(F.array_join(F.slice(p, F.greatest(pos, F.lit(1)), F.size(p)), "."))
    return found.select(
        *[F.col(c) for c in hosts.columns],
        registrable.alias("registrable"),
        F.when(~ip, tail(pos)).alias("suffix"),
        F.when(~ip & (F.col("_hit.division") == "private") & (pos >= 1), tail(pos)).alias("platform"),
        (~ip & F.col("_hit").isNotNull()).alias("known_tld"),
    )
