"""Sources of mail: CSV, message files, mailboxes, JSON lines."""

from __future__ import annotations

import email
import email.policy
import gzip
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAIL = (
    "subject string, sender_name string, sender_email string, reply_to string, body string, raw_headers string, "
    "links array<struct<text:string,href:string>>, attachments array<struct<name:string,mime_type:string>>"
)
_ANCHOR = re.compile(r"<a\b[^>]*?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", re.I | re.S)
_URL = re.compile(r"https?://[^\s<>\"']+", re.I)


def read_csv(spark: SparkSession, path: str, label: int, label_column: str = "label") -> DataFrame:
    """(subject, body) of the rows with an integer label; bad rows are tolerated, folder markers of a mailbox dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    kept = rows.where(F.col(label_column).try_cast("int") == label).where(~F.coalesce(F.contains(F.lower(column("body")), F.lit("folder internal data")), F.lit(False)))
    return kept.select(column("subject").alias("subject"), column("body").alias("body"))


def project_message(data: bytes) -> dict | None:
    """One RFC 5322 message as a mail; None if it is none."""
    try:
        m = email.message_from_bytes(data, policy=email.policy.default)
        if not m.keys():
            return None
        part = m.get_body(("plain", "html"))
        markup = m.get_body(("html",))
        body = part.get_content() if part else ""
        page = markup.get_content() if markup else ""
        import html as entities

        anchors = [(re.sub(r"<[^>]+>", " ", entities.unescape(t)).strip(), entities.unescape(h)) for h, t in _ANCHOR.findall(page)] or [(None, u) for u in _URL.findall(body)]
        name, address = email.utils.parseaddr(str(m.get("From", "")))
        return {
            "subject": str(m.get("Subject", "")), "sender_name": name or None, "sender_email": address or None,
            "reply_to": email.utils.parseaddr(str(m.get("Reply-To", "")))[1] or None, "body": body,
            "raw_headers": "\n".join(f"{k}: {v}" for k, v in m.items()), "links": [{"text": t, "href": h} for t, h in anchors[:300]],
            "attachments": [{"name": a.get_filename() or "", "mime_type": a.get_content_type()} for a in m.iter_attachments() if a.get_filename()],
        }
    except Exception:  # hostile or broken mail is data, and is skipped as such
        return None


def _frames(rows: list[dict | None], extra: dict[str, list]) -> pd.DataFrame:
    kept = [i for i, r in enumerate(rows) if r]
    names = [f.split()[0] for f in re.split(r", (?=\w+ (?:string|array))", MAIL)]
    return pd.DataFrame({**{k: [v[i] for i in kept] for k, v in extra.items()}, **{n: [rows[i][n] for i in kept] for n in names}})


def read_messages(spark: SparkSession, path: str, pattern: str = "*.eml", without: str | None = None) -> DataFrame:
    """(path, mail columns) of message files below ``path``; paths that match ``without`` (a regex) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    files = files.where(~F.col("path").rlike(without)) if without else files

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frames([project_message(bytes(c)) for c in b["content"]], {"path": b["path"].tolist()})

    return files.mapInPandas(each, f"path string, {MAIL}")


def split_mbox(data: bytes) -> list[bytes]:
    """Messages of a mailbox, up to the first piece that is none."""
    out = []
    for piece in re.split(rb"(?m)^From [^\n]*\n", data)[1:]:
        if not re.match(rb"[\w-]+:", piece):
            break
        out.append(piece)
    return out


def read_mbox(spark: SparkSession, path: str, pattern: str = "*.mbox*") -> DataFrame:
    """(path, position, mail columns) of mailboxes, gzipped or not; one file is one task's work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                raw = bytes(c)
                messages = split_mbox(gzip.GzipFile(fileobj=io.BytesIO(raw)).read() if raw[:2] == b"\x1f\x8b" else raw)
                yield _frames([project_message(m) for m in messages], {"path": [p] * len(messages), "position": list(range(len(messages)))})

    return files.mapInPandas(each, f"path string, position int, {MAIL}")


EXCHANGE = "id string, subject string, body string, class string, source string, modern boolean, split string, language string, label_issue boolean, pair_key string"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = EXCHANGE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Nulls are left out of the lines."""
    rows.write.option("ignoreNullFields", True).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """One nested JSON document."""
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, ok): files (name, content) against a manifest (name, sha256); what is missing is not ok."""
    seen = files.select("name", F.sha2("content", 256).alias("_sha"))
    return manifest.join(seen, "name", "left").select("name", F.coalesce(F.col("_sha") == F.lower("sha256"), F.lit(False)).alias("ok"))


RDAP = "struct<events:array<struct<eventAction:string,eventDate:string>>>"


def registration_date(document: str = "json"):
    """The first registration event with a date that can be read."""
    events = F.filter(F.from_json(document, RDAP)["events"], lambda e: (e["eventAction"] == "registration") & F.try_to_timestamp(e["eventDate"]).isNotNull())
    return F.try_to_timestamp(F.get(events, F.lit(0))["eventDate"])


def registry_services(documents: DataFrame, column: str = "json") -> DataFrame:
    """(tld, url) of a registry bootstrap: services of [[tlds], [urls]]; the first https address of each."""
    services = documents.select(F.explode(F.from_json(column, "struct<services:array<array<array<string>>>>")["services"]).alias("s"))
    url = F.get(F.filter(F.element_at("s", 2), lambda u: F.startswith(u, F.lit("https://"))), F.lit(0))
    return services.select(F.explode(F.element_at("s", 1)).alias("tld"), url.alias("url")).where("url is not null")


def threat_matches(documents: DataFrame, column: str = "json") -> DataFrame:
    """(url, threat) of a lookup service's answers."""
    m = documents.select(F.explode(F.from_json(column, "struct<matches:array<struct<threatType:string,threat:struct<url:string>>>>")["matches"]).alias("m"))
    return m.select(F.col("m.threat.url").alias("url"), F.col("m.threatType").alias("threat"))
