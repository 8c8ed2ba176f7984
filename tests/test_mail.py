"""Golden cases of the mail operators, and plans."""

import gzip
import time
from collections import Counter

import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from sievelight import catalogue
from sievelight.functions import labels, text, urls
from sievelight.functions.python_text import chunk_text, fold_text, host_to_unicode, normalisation_available, wordpiece
from sievelight.operators import near_duplicates
from sievelight.operators.components import connected_components
from sievelight.plans import corpus, dims, evaluation, learning, rules, scoring
from sievelight.plans.hosts import Catalogue, host_facts
from sievelight.sources import mail
from sievelight.streaming import operations


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_normalisation():
    assert normalisation_available() and fold_text("pa​ss ﬁ ＡＢ") == "pass fi AB"
    assert host_to_unicode("xn--80ak6aa92e.com") == "аррӏе.com" and host_to_unicode("xn--.com") in ("xn--.com", ".com")


@pytest.mark.parametrize("subject,body,expected", [
    (None, "<p>Hello <b>world</b></p><script>x</script>", "Hello world"),
    ("Hi", "see https://a.example/x or a@b.example 24 hours", "Hi see urltoken or emailtoken numtoken hours"),
    (None, "pass​word &amp; more", "password & more"), (None, None, ""),
])
def test_normalise(spark, subject, body, expected):
    assert one(spark, text.normalise(F.col("s"), F.col("b")), s=subject, b=body) == expected


@pytest.mark.parametrize("given,expected", [
    ("Hi <style>a</style>there<script>b</script>!", "Hi  there !"), ("<script>a</script><script>open", " <script>open"),
])
def test_script_removal(spark, given, expected):
    assert one(spark, text.remove_script_and_style(F.col("t")), t=given) == expected


@pytest.mark.parametrize("given,expected", [
    ("Obrigado!", "en"), ("تحديث الحساب", "ar"), ("", "en"),
    ("please confirm that you have received the invoice for your order and let us know if it is not right", "en"),
    ("não temos uma resposta para você que seja boa com os seus dados e por isso não vamos", "other"),
])
def test_language(spark, given, expected):
    assert one(spark, text.detect_language(F.col("t")), t=given) == expected


def test_visible_body(spark):
    body = "Hi\nOn Sat, Jan 11 Jane <j@x> wrote:\n> old\nreply user(a)lists.example.org\n-- \nsignature"
    assert one(spark, text.visible_body(F.col("t")), t=body) == "Hi\nreply  emailtoken \n"
    assert one(spark, text.visible_body(F.col("t")), t=None) == ""


def test_masks(spark):
    t = "see https://a.example/x and a@b.example or https://a.example/x"
    m = text.mask_links(F.col("t"))
    assert one(spark, m["masked"], t=t) == "see  X0X  and  X1X  or  X2X "
    assert one(spark, text.unmask_links(m["masked"], m["found"]), t=t).split() == t.split()
    assert one(spark, text.unmask_links(F.lit("lost X1X"), m["found"]), t=t) == "lost a@b.example https://a.example/x https://a.example/x"
    assert chunk_text("One. Two! " + "x" * 700, 10, 600)[0] == "One. Two!"


def test_wordpiece():
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##able", ",", "able"])}
    assert wordpiece("unable, able zz", vocab, 16) == [2, 4, 5, 6, 7, 1, 3]
    assert wordpiece("able " * 50, vocab, 6) == [2, 7, 7, 7, 7, 3] and wordpiece("u" * 101, vocab, 8) == [2, 1, 3]


@pytest.mark.parametrize("url", ["‮http://x", "http://", "http://%%%", "://", "http://a b/", "\\\\host\\x", "http:///path", "é"])
def test_hostile_urls_never_fail(spark, url):
    one(spark, F.coalesce(urls.host_of(F.col("u")), urls.feed_key(F.col("u")), urls.unwrap(F.col("u"))), u=url)


def test_unwrap_depth(spark):
    href = "https://evil.example/login"
    for _ in range(8):
        href = "https://www.google.com/url?q=" + href.replace("%", "%25").replace(":", "%3A").replace("/", "%2F").replace("?", "%3F").replace("=", "%3D").replace("&", "%26")
    assert one(spark, urls.unwrap(F.col("u")), u=href) == ""


def test_suffix_exceptions(spark):
    hosts = spark.createDataFrame([("a.b.c.ck",), ("www.ck",), ("x.www.ck",)], "host string")
    got = {r.host: r.registrable for r in urls.with_registrable(hosts, dims.suffix_rules(spark)).collect()}
    assert got == {"a.b.c.ck": "b.c.ck", "www.ck": "www.ck", "x.www.ck": "www.ck"}


def test_host_lookups_are_hash_joins(spark):
    hosts = spark.createDataFrame([("a.example.com",)], "host string")
    plan = urls.with_registrable(hosts, dims.suffix_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


AUTH = "From: a@x\nAuthentication-Results: mx; spf=pass; dkim=pass; dmarc=pass"


def analyse(spark, p=0.99, policy=None, **fields):
    names = ("email_id", "subject", "sender_name", "sender_email", "reply_to", "body", "raw_headers", "links", "attachments", "qr_code_urls")
    row = {"email_id": 1, "body": "hello", **fields}
    mails = spark.createDataFrame([tuple(row.get(n) for n in names)], rules.SUBMISSION)
    options = scoring.Options(phishing_threshold=0.5, suspicious_threshold=0.25, **(policy or {}))
    return scoring.analyse(mails, Catalogue.default(spark), scoring.FixedScorer(p) if p is not None else None, options, plain=True).first()


def codes(result):
    b = result.breakdown
    return {f.code for c in (b.headers, b.links, b.attachments, b.obfuscation) for f in c.findings}


def link(text_, href):
    return {"text": text_, "href": href}


def test_policies(spark):
    assert analyse(spark).verdict == "phishing"
    capped = analyse(spark, policy={"require_corroboration": True})
    assert capped.verdict == "suspicious" and "Only the wording is suspicious" in capped.limitations
    apple = {"sender_name": "Apple", "sender_email": "id@email.apple.com", "raw_headers": "Authentication-Results: mx; spf=pass; dkim=pass; dmarc=pass"}
    trust = {"trust_verified_brand_senders": True}
    assert analyse(spark, policy=trust, links=[link("a", "https://www.apple.com/"), link("m", "mailto:a@b.c")], **apple).verdict == "safe"
    off = analyse(spark, policy=trust, links=[link("a", "https://other.example/")], **apple)
    assert off.verdict == "phishing" and "verified-brand-sender" not in codes(off)


def test_qr_links_and_merged_reason(spark):
    r = analyse(spark, p=None, sender_email="a@rnicrosoft-mfa.com", qr_code_urls=["https://rnicrosoft-mfa.com/enrol"], links=[link("QR code", "https://example.com/")])
    assert {"qr-code-link", "lookalike-domain", "lookalike-sender"} <= codes(r)
    assert sum("imitates" in x for x in r.reasons) == 1 and "the links use the same domain" in " ".join(r.reasons)
    assert 0 <= r.score <= 1


def test_attachment_names(spark):
    def found(*names, body=None):
        return codes(analyse(spark, p=None, body=body, attachments=[{"name": n, "mime_type": None} for n in names]))

    assert found("invoice_‮fdp.exe") == {"rtlo-filename", "executable-attachment"}
    assert found("a.zip") == set() and found("a.zip", body="Password: 4471") == {"password-archive"}
    assert found("a.js", "b.iso", "c.svg", "d.one") == {"executable-attachment", "disk-image-attachment", "html-attachment", "macro-attachment"}


def test_established_sender(spark):
    names = {"email_id": 1, "sender_email": "x@oldshop.com", "raw_headers": "Authentication-Results: spf=pass dkim=pass dmarc=pass"}
    row = tuple(names.get(n) for n in ("email_id", "subject", "sender_name", "sender_email", "reply_to", "body", "raw_headers", "links", "attachments", "qr_code_urls"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    known = spark.createDataFrame([("oldshop.com", True)], "domain string, checked boolean").withColumn("registered_ts", F.timestamp_seconds(F.unix_timestamp(now) - 4000 * 86400))
    options = scoring.Options(phishing_threshold=0.5, suspicious_threshold=0.25, trust_established_senders=True)
    r = scoring.analyse(spark.createDataFrame([row], rules.SUBMISSION), Catalogue.default(spark), scoring.FixedScorer(0.99), options, now=now, registrations=known, plain=True).first()
    assert r.verdict == "suspicious" and r.score == pytest.approx(0.446, abs=1e-3)


def test_components_on_a_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sources(spark, tmp_path):
    message = b"From: Ann <ann@x.example>\nSubject: Hi\nContent-Type: text/html\n\n<a href='https://a.example/?a=1&amp;b=2'>go</a>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(message)
    (tmp_path / "in/broken.eml").write_bytes(b"")
    got = mail.read_messages(spark, str(tmp_path / "in")).collect()
    assert len(got) == 1 and got[0].sender_email == "ann@x.example" and got[0].links[0].href == "https://a.example/?a=1&b=2"
    with gzip.open(tmp_path / "in/box.mbox.gz", "wb") as f:
        f.write(b"From x\n" + message + b"\nFrom y\n" + message + b"\nFrom z\nno header\nFrom w\n" + message)
    assert mail.read_mbox(spark, str(tmp_path / "in")).count() == 2
    (tmp_path / "m.csv").write_text('subject,body,label\na,"b\nc",1\nd,e,0\nf,g,x\n')
    assert [(r.subject, r.body) for r in mail.read_csv(spark, str(tmp_path / "m.csv"), 1).collect()] == [("a", "b\nc")]
    rows = spark.createDataFrame([("1", None, "b")], "id string, subject string, body string")
    mail.write_jsonl(rows, str(tmp_path / "j"))
    assert mail.read_jsonl(spark, str(tmp_path / "j")).select("id", "subject", "body").collect() == rows.collect()
    files = spark.createDataFrame([("m", bytearray(b"x"))], "name string, content binary")
    manifest = spark.createDataFrame([("m", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("n", "0")], "name string, sha256 string")
    assert {r.name: r.ok for r in mail.verify_files(files, manifest).collect()} == {"m": True, "n": False}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select((F.lit(1_700_000_000) + F.col("id") * 7).cast("timestamp").alias("ts"), (F.col("id") % 3).cast("string").alias("k"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = operations.stream_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", ["k"])
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("counts").collect()) == sorted(operations.stream_counts(rows, "ts", ["k"]).collect())
    store = str(tmp_path / "votes")
    assert operations.append_feedback(rows.limit(5), store, 8) and not operations.append_feedback(rows.limit(5), store, 8)


def test_platt_and_weights(spark):
    rows = spark.range(4000).select((F.rand(1)).alias("p")).withColumn("y", (F.rand(2) < 1 / (1 + F.exp(-(0.5 * F.log(F.col("p") / (1 - F.col("p"))) - 0.3)))).cast("int"))
    fit = learning.fit_platt(rows)
    assert fit.a == pytest.approx(0.5, abs=0.1) and fit.b == pytest.approx(-0.3, abs=0.1) and fit.brier_after < fit.brier_before
    assert evaluation.auc(rows.where("y = 1"), F.col("y") == 1, F.col("p")).first().auc is None


def test_corpus(spark):
    spec = [corpus.SourceSpec("a", "spam", True, lambda s: s.createDataFrame([(1, "Re: x", "please read this and let us know if you have any of the right answers for it")], "row_ord long, subject string, body string"))]
    out = corpus.split(corpus.status(corpus.clean(corpus.gather(spark, spec * 2)))).collect()
    assert sorted(r.status for r in out) == ["duplicate", "kept"] and out[0].group_key == "x" and out[0].split in ("train", "tune", "test")


def test_noisy_or(spark):
    assert spark.range(1).select(labels.noisy_or(F.array(F.lit(0.5), F.lit(0.5))).alias("x"), labels.noisy_or(F.array().cast("array<double>")).alias("y")).first() == (0.75, 0)


def test_campaign_under_several_subjects_is_on_one_side(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    same = " ".join(words)
    rows = [(i, "s", 0, f"zz{'abc'[i % 3]}", same + f" tail{'klmnop'[i]}", True, "kept") for i in range(6)]
    rows += [(10 + i, "s", 0, "copies", "x" * (i + 1), True, "kept") for i in range(60)]  # no usable shingle: the subject joins them
    rows += [(99, "s", 0, "zza", "another text", True, "too_short")]
    frame = spark.createDataFrame(rows, "row_ord long, source string, source_ord int, group_key string, text string, modern boolean, status string")
    out = {r.row_ord: r for r in corpus.split(frame).collect()}
    assert len(out) == len(rows)
    assert {out[i].group_key for i in range(6)} == {"zza"} and len({out[i].split for i in range(6)}) == 1
    assert {out[10 + i].group_key for i in range(60)} == {"copies"}
    keyed = frame.where("status = 'kept'")
    clusters = {r.row_ord: r.cluster for r in near_duplicates.cluster(keyed, "row_ord", group="group_key").collect()}
    assert {clusters[i] for i in range(6)} == {0} and {clusters[10 + i] for i in range(60)} == {10}


def test_noisy_or_of_all_events(spark):
    data = "/root/testdata/sf0.001"
    out = catalogue.QUERIES["b90_noisy_or_all"](spark, data).collect()
    assert sum(r.n for r in out) == spark.read.parquet(f"{data}/events.parquet").where("value is not null").count()


@pytest.mark.parametrize("given,expected", [
    ("", False), ("123 456", False), ("a" * 20, True), (" " * 25, True), ("word word word word word word next", True), ("هذا نص عربي سليم تماما", False), ("mostly english here", True),
])
def test_broken_translation(spark, given, expected):
    assert one(spark, text.broken_translation(F.col("t")), t=given) is expected


def test_chunks_keep_what_fits():
    assert chunk_text("One. Two.\nThree") == ["One. Two. Three"]
    assert chunk_text(f"{'a' * 300}. {'b' * 100}") == ["a" * 300 + ".", "b" * 100]
    assert chunk_text("x" * 700) == ["x" * 600] and chunk_text(" \n ") == []


def test_catalogue_from_one_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"brands": [{"name": "Acme", "domains": ["acme.test", "acme.example"], "keywords": ["acme corp"]}, {"name": "Cab", "domains": ["cab.test"], "keywords": [], "matchLabelInDomains": false}], "userContentHosts": ["pages.acme.test"]}')
    (tmp_path / "t.txt").write_text("# clicks\ntrack.test\n\n")
    c = Catalogue.from_files(spark, str(tmp_path / "c.json"), str(tmp_path / "t.txt"))
    assert [(r.brand, r.domain, r.match_label) for r in c.domains.orderBy("brand_ord", "domain_ord").collect()] == [("Acme", "acme.test", True), ("Acme", "acme.example", True), ("Cab", "cab.test", False)]
    assert [r.keyword for r in c.keywords.collect()] == ["acme corp"] and [r.domain for r in c.platforms.collect()] == ["pages.acme.test"] and [r.domain for r in c.trackers.collect()] == ["track.test"]


def test_storage_is_shared_or_refused(spark, monkeypatch):
    from sievelight import storage

    table = storage.materialise(spark.range(3), "three")
    assert table.count() == 3
    storage.discard(table, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(table._stored_at).count()

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"getConf": staticmethod(lambda: {}), "master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(RuntimeError):
        storage.shared_dir(Elsewhere)


def test_age_counts_fractions_of_a_second(spark):
    """half a second less than two days is one day; a dated-back mail is younger than its domain by a day."""
    now = F.lit("2024-03-03 00:00:00").cast("timestamp")
    given = ["2024-03-01 00:00:00.5", "2024-03-01 00:00:00", "2024-03-03 00:00:00.25", "2024-03-04 00:00:00", "1601-01-01 00:00:00.000001", None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").withColumn("age", labels.age_days(now, F.col("t").cast("timestamp")))
    assert [r.age for r in rows.orderBy("i").collect()] == [1, 2, -1, -1, 154558, None]


def test_fresh_counts_fractions_of_a_second(spark):
    """an answer of ten minutes less half a second ago still holds, one of exactly ten minutes ago does not."""
    given = [(1, False, "2024-01-15 11:50:00.5"), (2, False, "2024-01-15 11:50:00"), (3, True, "2024-01-14 12:00:00.000001"), (4, True, "2024-01-14 12:00:00"), (5, None, "2024-01-15 11:50:00.5")]
    cache = spark.createDataFrame(given, "i int, checked boolean, t string").withColumn("checked_at", F.col("t").cast("timestamp"))
    kept = operations.fresh(cache, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    assert sorted(r.i for r in kept.collect()) == [1, 3, 5]


def test_char_grams_take_time_in_proportion(spark):
    """each n-gram was looked up from the text's beginning, so that a long text took the square of its length."""
    text = "abcde fghij " * 40_000
    began = time.monotonic()
    grams = learning.with_char_grams(spark.createDataFrame([(text,)], "text string")).select(F.explode("char_grams").alias("g")).groupBy("g").count()
    assert {r["g"]: r["count"] for r in grams.collect()} == Counter(text[i : i + 3] for i in range(len(text) - 2))
    assert time.monotonic() - began < 30


def test_counted_char_grams_are_those_of_the_vectorizer(spark):
    texts = ["Aab aab", "😀😀é😀😀é", "", None, "xy", "ÀÉ àé\nàé", "\u0000\uffff\U0010ffff"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    vocabulary = learning._most_frequent(learning._count_chars(rows), 100)
    assert set(vocabulary) == {t.lower()[i : i + 3] for t in texts if t for i in range(len(t) - 2)}
    slow = CountVectorizerModel.from_vocabulary(vocabulary, "char_grams", "tf").transform(learning.with_char_grams(rows))
    both = slow.withColumn("fast", learning._char_tf(vocabulary)).orderBy("i").collect()
    assert all(r.fast == r.tf for r in both) and both[0].fast.values.sum() == 5
