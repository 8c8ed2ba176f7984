"""From what a client sends or a page shows to mails: bounds, clean-up, links, attachments, messages of a thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import labels, text, urls

# The bounds of a demo request, and of what is taken from a page.
MOST_SUBJECT, MOST_BODY, MOST_SENDER, MOST_URL, MOST_DEMO_LINKS = 300, 5_000, 200, 500, 10
MOST_LINKS, MOST_CANDIDATES, MOST_MESSAGES, MOST_IMAGES, LEAST_IMAGE, LEAST_BLOCK = 300, 5_000, 10, 5, 80, 20
IMAGE_HOSTS = r"(?i)^https://([a-z0-9-]+\.googleusercontent\.com|mail\.google\.com)/"
_NO_LINKS = "array<struct<text:string,href:string>>"


def _long(c: Column, most: int) -> Column:
    return F.coalesce(F.length(c) > most, F.lit(False))


def demo_problems(subject: Column, body: Column, sender_name: Column, sender_email: Column, link_text: Column, link_url: Column) -> Column:
    """What is wrong with a demo request."""
    too_long = _long(subject, MOST_SUBJECT) | _long(body, MOST_BODY)
    found = labels.problems(
        body=(too_long | (text.blank(subject) & text.blank(body)), ""),
        sender=(_long(sender_name, MOST_SENDER) | _long(sender_email, MOST_SENDER), f"Sender name and address: at most {MOST_SENDER} characters each."),
        link=(_long(link_text, MOST_URL) | _long(link_url, MOST_URL), f"Link text and address: at most {MOST_URL} characters each."),
    )
    said = F.when(too_long, F.lit(f"The demo accepts a subject of up to {MOST_SUBJECT} and a body of up to {MOST_BODY} characters.")).otherwise("Provide a subject or a body.")
    return F.transform_values(found, lambda k, v: F.when(k == "body", F.array(said)).otherwise(v))


def demo_links(body: Column, link_text: Column, link_url: Column) -> Column:
    """The explicit link first, then the addresses in the body, each once; at most ten."""
    href = text.strip(link_url)
    named = F.when(text.blank(link_text), href).otherwise(text.strip(link_text))
    first = F.when(~text.blank(link_url), F.array(F.struct(named.alias("text"), href.alias("href")))).otherwise(F.array().cast(_NO_LINKS))
    written = F.array_distinct(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?i)https?://[^\s\p{Z}<>)\]]{4,500}"), F.lit(0)))
    others = F.filter(written, lambda u: ~F.coalesce(u == href, F.lit(False)))
    return F.slice(F.concat(first, F.transform(others, lambda u: F.struct(u.alias("text"), u.alias("href")))), 1, MOST_DEMO_LINKS)


def submission(request: DataFrame) -> DataFrame:
    """``request`` with trimmed names and addresses, blank links, attachments and QR targets dropped, and long attachment names
    clamped. The body and the headers stay as they are."""
    kept = lambda c, of: F.filter(F.col(c), lambda x: ~text.blank(of(x)))
    return request.withColumns({
        **{c: text.strip(F.col(c)) for c in ("subject", "sender_name", "sender_email", "reply_to")},
        "links": F.transform(kept("links", lambda x: x["href"]), lambda x: F.struct(text.strip(x["text"]).alias("text"), text.strip(x["href"]).alias("href"))),
        "attachments": F.transform(kept("attachments", lambda x: x["name"]), lambda x: F.struct(text.clamp_name(text.strip(x["name"])).alias("name"), x["mime_type"].alias("mime_type"))),
        "qr_code_urls": F.transform(kept("qr_code_urls", lambda x: x), text.strip),
    })


_TARGET = r"(?is)<(?:a|area)\b[^>]*?\bhref\s*=\s*[\"'][^\"']+[\"'][^>]*>|<form\b[^>]*?\baction\s*=\s*[\"'][^\"']+[\"'][^>]*>|<(?!a\b|area\b)[a-z][a-z0-9]*\b[^>]*?\bformaction\s*=\s*[\"'][^\"']+[\"'][^>]*>"


def link_targets(html: Column) -> Column:
    """All that takes a reader somewhere, in order: links, image-map areas, forms and their buttons, as array<struct<tag,href>>.
    Fragments are dropped; the first 5,000 of the rest count."""
    tags = F.regexp_extract_all(html, F.lit(_TARGET), F.lit(0))

    def of(t: Column) -> Column:
        tag = F.lower(F.regexp_extract(t, r"^<([A-Za-z0-9]+)", 1))
        value = lambda name: F.regexp_extract(t, rf"(?is)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1)
        href = F.when(tag.isin("a", "area"), value("href")).when(tag == "form", value("(?<!form)action")).otherwise(value("formaction"))
        return F.struct(tag.alias("tag"), href.alias("href"))

    return F.slice(F.filter(F.transform(tags, of), lambda x: (x["href"] != "") & ~F.startswith(x["href"], F.lit("#"))), 1, MOST_CANDIDATES)


def select_links(links: DataFrame, mail: str = "email_id", most: int = MOST_LINKS) -> DataFrame:
    """At most ``most`` of a mail's links (mail, idx, href, hidden): visible ones first, and of either kind each host has a turn
    before any has a second."""
    host = F.coalesce(urls.host_of(F.col("href")), F.col("href"))
    turn = F.row_number().over(Window.partitionBy(mail, "hidden", host).orderBy("idx"))
    seat = F.row_number().over(Window.partitionBy(mail).orderBy("hidden", "_turn", "idx"))
    return links.withColumn("_turn", turn).withColumn("_seat", seat).where(F.col("_seat") <= most).drop("_turn", "_seat")


def qr_images(images: Column) -> Column:
    """Addresses of inline images that may hold a code: array<struct<src,width,height>> -> array<string>, at most five."""
    large = F.filter(F.coalesce(images, F.array().cast("array<struct<src:string,width:int,height:int>>")), lambda x: (x["width"] >= LEAST_IMAGE) & (x["height"] >= LEAST_IMAGE) & x["src"].rlike(IMAGE_HOSTS))
    return F.slice(F.transform(large, lambda x: x["src"]), 1, MOST_IMAGES)


def qr_targets(decoded: Column) -> Column:
    """Decoded http(s) addresses, each once."""
    return F.array_distinct(F.filter(F.coalesce(decoded, F.array().cast("array<string>")), lambda u: u.rlike("(?i)^https?://")))


def located(*candidates: Column) -> Column:
    """struct(value, strategy): the first candidate that is not null, and which one that was (from 0); -1 where there is none."""
    index = F.coalesce(*(F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(candidates)), F.lit(-1))
    return F.struct(F.coalesce(*candidates).alias("value"), index.alias("strategy"))


def largest_block(blocks: DataFrame, mail: str, content: str, order: str) -> DataFrame:
    """(mail, block): the smallest block with nine tenths of the longest one's text, the first of equals; none where the
    longest has under 20 characters. A mail's blocks meet as their lengths first, so that texts are not windowed."""
    sized = blocks.withColumn("_n", F.coalesce(F.length(content), F.lit(0)))
    longest = sized.groupBy(mail).agg(F.max("_n").alias("_m")).where(F.col("_m") >= LEAST_BLOCK)
    near = sized.join(longest, mail).where(F.col("_n") >= 0.9 * F.col("_m"))
    return near.groupBy(mail).agg(F.min_by(content, F.struct("_n", order)).alias("block"))


def open_messages(messages: DataFrame, thread: str = "thread", begin: str = "begin", end: str = "end") -> DataFrame:
    """The newest ten messages of a thread that hold no other, of elements at [begin, end) in the page's order. Elements nest or
    are apart, so one that holds others is followed by the first of these."""
    following = F.lead(begin).over(Window.partitionBy(thread).orderBy(begin, F.desc(end)))
    inner = messages.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") >= F.col(end))).drop("_next")
    return inner.withColumn("newest", F.row_number().over(Window.partitionBy(thread).orderBy(F.desc(begin)))).where(F.col("newest") <= MOST_MESSAGES)
