"""Queries over the test tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.functions import headers as H
from sievelight.functions import labels, text, urls
from sievelight.operators import near_duplicates
from sievelight.operators.components import connected_components
from sievelight.plans import corpus, dims, evaluation, intake, learning, rules, scoring
from sievelight.plans.hosts import Catalogue, host_facts, impersonations, mentioned_brands
from sievelight.streaming import operations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple], columns: str) -> str:
    """A SQL relation of literal rows."""

    def one(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"(select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as _v({columns}))"


# --- Scans ------------------------------------------------------------------------------------------------------------


@query(r"""select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) as href,
    unnest(range(len(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 1))))::int as idx from pages""")
def a5_anchors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.posexplode(text.anchors(F.col("html"))).alias("idx", "a")).select("page_id", "idx", "a.href")


@query(r"""select page_id, unnest(regexp_extract_all('see ' || url || ' and <' || url || '>', '(?i)https?://[^\s<>"'']+')) as found from pages""")
def a6_plain_urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.explode(text.plain_urls(F.concat(F.lit("see "), "url", F.lit(" and <"), "url", F.lit(">")))).alias("found"))


HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
KEY_SQL = rf"{HOST_SQL} || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1), '/+$', '')"


@query(f"""with lines as (select case when url like 'https%' then 'open' else 'dns' end as feed, {KEY_SQL} as key, {HOST_SQL} as host from pages)
select 'url' as kind, key as item, case when bool_or(feed = 'open') then 'open' else 'dns' end as feed from lines group by key
union all select 'host', host, case when bool_or(feed = 'open') then 'open' else 'dns' end from lines group by host""")
def a9_threat_feed(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "pages").select(F.when(F.startswith("url", F.lit("https")), "open").otherwise("dns").alias("feed"), F.concat(F.lit("  "), "url", F.lit(" ")).alias("line"))
    comment = spark.createDataFrame([("open", "# a comment"), ("dns", "   ")], "feed string, line string")
    u, h = rules.feed_tables(lines.union(comment), ["open", "dns"])
    return u.select(F.lit("url").alias("kind"), F.col("key").alias("item"), "feed").union(h.select(F.lit("host"), "host", "feed"))


_DOMAINS = [(i, j, n, x, m) for i, (n, ds, _, m) in enumerate(dims.BRANDS) for j, x in enumerate(ds.split())]
DOMAINS_SQL = values(_DOMAINS, "brand_ord, domain_ord, brand, domain, match_label")


@query(f"select * from {DOMAINS_SQL}")
def a10_brand_domains(spark: SparkSession, d: str) -> DataFrame:
    return dims.brand_domains(spark)


@query("""select s_suppkey, 'tld' || (s_suppkey::int) as tld, 'https://rdap.example/' || (s_suppkey::int) as url from supplier""")
def a11_registry_services(spark: SparkSession, d: str) -> DataFrame:
    from sievelight.sources.mail import registry_services

    k = F.col("s_suppkey").cast("int").cast("string")
    docs = read(spark, d, "supplier").select(F.concat(F.lit('{"services":[[["tld'), k, F.lit('"],["http://old.example/","https://rdap.example/'), k, F.lit('"]]]}')).alias("json"))
    return registry_services(docs).select(F.regexp_extract("tld", r"(\d+)", 1).cast("long").alias("s_suppkey"), "tld", "url")


@query("""select s_suppkey, (timestamp '2001-02-03 00:00:00' + to_days((s_suppkey % 365)::int)) as registered from supplier""")
def a12_registration_date(spark: SparkSession, d: str) -> DataFrame:
    from sievelight.sources.mail import registration_date

    day = F.date_format(F.date_add(F.lit("2001-02-03").cast("date"), (F.col("s_suppkey") % 365).cast("int")), "yyyy-MM-dd")
    doc = F.concat(F.lit('{"events":[{"eventAction":"last changed","eventDate":"2020-01-01T00:00:00Z"},{"eventAction":"registration","eventDate":"soon"},{"eventAction":"registration","eventDate":"'), day, F.lit('T00:00:00Z"}]}'))
    return read(spark, d, "supplier").withColumn("json", doc).select("s_suppkey", registration_date("json").cast("timestamp_ntz").alias("registered"))


@query("""select 'https://t.example/' || (s_suppkey::int) as url, case when s_suppkey % 2 = 0 then 'MALWARE' else 'SOCIAL_ENGINEERING' end as threat,
    case when s_suppkey % 2 = 0 then 'malware' else 'phishing / social engineering' end as said from supplier""")
def a13_threat_matches(spark: SparkSession, d: str) -> DataFrame:
    from sievelight.sources.mail import threat_matches

    k = F.col("s_suppkey").cast("int").cast("string")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "MALWARE").otherwise("SOCIAL_ENGINEERING")
    docs = read(spark, d, "supplier").select(F.concat(F.lit('{"matches":[{"threatType":"'), kind, F.lit('","threat":{"url":"https://t.example/'), k, F.lit('"}}]}')).alias("json"))
    return threat_matches(docs).withColumn("said", text.describe_threat(F.col("threat")))


@query(r"""with blocks as (select doc_id, line, i, length(line) as n, max(length(line)) over (partition by doc_id) as m
    from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))
select doc_id, arg_min(line, n * 1000000 + i) as block from blocks where n >= 0.9 * m and m >= 20 group by doc_id""")
def a17_largest_block(spark: SparkSession, d: str) -> DataFrame:
    """The smallest block that holds nine tenths of the longest block's text."""
    blocks = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return intake.largest_block(blocks, "doc_id", "line", "i")


@query("""select p_partkey, 'application/pdf' as mime_type, 'a:' || p_name || '.pdf' as name, 'https://x.example/f?id=' || (p_partkey::int) as url from part""")
def a19_chips(spark: SparkSession, d: str) -> DataFrame:
    chip = F.concat(F.lit("application/pdf:a:"), "p_name", F.lit(".pdf:https://x.example/f?id="), F.col("p_partkey").cast("int").cast("string"))
    return read(spark, d, "part").select("p_partkey", text.chip(chip).alias("c")).select("p_partkey", "c.*")


@query(r"""select doc_id, left(string_split(replace(text, chr(13) || chr(10), chr(10)) || chr(10) || chr(10) || 'body', chr(10) || chr(10))[1], 60000) as head from documents""")
def a20_header_block(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.header_block(F.concat(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\n\nbody"))).alias("head"))


@query(r"""select page_id, list_distinct(list_slice(['https://first.example/', url, url], 1, 10)).list_sort() as links from pages""")
def a22_demo_submission(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("look "), "url", F.lit(" and "), "url")
    return read(spark, d, "pages").select("page_id", F.sort_array(F.slice(F.array_distinct(F.concat(F.array(F.lit("https://first.example/")), text.plain_urls(body))), 1, 10)).alias("links"))


@query("""select event_type, count(*) as n from events group by event_type""")
def a25_counters(spark: SparkSession, d: str) -> DataFrame:
    return operations.counters(read(spark, d, "events"), ["event_type"])


@query("""select d.doc_id from documents d left join labels l using (doc_id) where l.doc_id is null""")
def a26_pending(spark: SparkSession, d: str) -> DataFrame:
    return corpus.pending(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


# --- Text -------------------------------------------------------------------------------------------------------------

_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_WS = r"[\s\p{Z}]"


@query(rf"""with a as (select doc_id, regexp_replace(left(chr(10) || text, 24000), '<[^>]+>', ' ', 'g') as t from documents),
b as (select doc_id, regexp_replace(t, '(?i)(https?://|www\.)[^\s\p{{Z}}]+', ' urltoken ', 'g') as t from a),
c as (select doc_id, regexp_replace(t, '[\p{{L}}\p{{N}}_.+\-]+@[\p{{L}}\p{{N}}_\-]+(\.[\p{{L}}\p{{N}}_\-]+)+', ' emailtoken ', 'g') as t from b),
e as (select doc_id, regexp_replace(regexp_replace(t, '\p{{Nd}}+', ' numtoken ', 'g'), '{_WS}+', ' ', 'g') as t from c)
select doc_id, left(trim(t), 6000) as normal from e""")
def b1_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.normalise_plain(F.lit(None).cast("string"), F.col("text")).alias("normal"))


@query()
def b1_normalise_folded(spark: SparkSession, d: str) -> DataFrame:
    """With entity decoding and compatibility folding, which SQL lacks."""
    return read(spark, d, "pages").select("page_id", text.normalise(F.lit(None).cast("string"), F.col("html")).alias("normal"))


@query(f"select page_id, {_STRIPPED} as plain from pages")
def b2_b3_strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.strip_tags(text.remove_script_and_style(F.col("html"))).alias("plain"))


ARABIC = [(1, "أحمد إلى آمن مدرسة"), (2, "مُؤْمِن ـــ رئيس"), (3, "plain latin"), (4, "البنک العربی")]


@query(rf"""select id, case when regexp_matches(t, '[\x{{0600}}-\x{{06FF}}]') then translate(regexp_replace(t, '[\x{{064B}}-\x{{065F}}\x{{0670}}\x{{0640}}\x{{0610}}-\x{{061A}}\x{{06D6}}-\x{{06ED}}]', '', 'g'), 'أإآٱىةؤئ', 'اااايهوي') else t end as normal,
    translate(t, 'کیہھۃے', 'كيهههي') as folded, regexp_matches(t, '[\x{{0600}}-\x{{06FF}}]') as arabic from {values(ARABIC, 'id, t')}""")
def b6_b8_arabic(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return spark.createDataFrame(ARABIC, "id int, t string").select("id", text.normalise_arabic(t).alias("normal"), text.fold_lookalikes(t).alias("folded"), text.contains_arabic(t).alias("arabic"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(rf"""with w as (select doc_id, left(text, 4000) as sample, list_filter(regexp_extract_all(left(text, 4000), '\p{{L}}+'), lambda x: x not in ('numtoken', 'urltoken', 'emailtoken')) as ws from documents),
s as (select doc_id, len(ws) as n, list_transform(list_filter(ws, lambda x: not regexp_matches(x, '[\x{{0600}}-\x{{06FF}}]')), lambda x: lower(x)) as r from w),
k as (select doc_id, n, len(r) as m, n - len(r) as arabic, len(list_filter(r, lambda x: not regexp_matches(x, '[^\x{{0000}}-\x{{024F}}]'))) as latin,
  len(list_filter(r, lambda x: list_contains({_sql_list(text.ENGLISH_WORDS)}, x))) as english,
  len(list_filter(r, lambda x: list_contains({_sql_list(text.FOREIGN_WORDS)}, x) and not list_contains({_sql_list(text.ENGLISH_WORDS)}, x))) as other from s)
select doc_id, case when n = 0 then 'en' when (arabic >= 3 and arabic >= n * 0.4) or (n < 12 and arabic * 2 >= n) then 'ar' when n < 12 then 'en'
  when latin >= m * 0.8 and english >= m * 0.08 and other < english * 0.5 then 'en' else 'other' end as language from k""")
def b9_language(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query(r"""select doc_id, case when len(regexp_extract_all(text, '\p{L}')) > 0 and len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) >= 0.4 * len(regexp_extract_all(text, '\p{L}')) then 'ar' else 'en' end as language from documents""")
def b11_client_language(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.guess_language(F.col("text")).alias("language"))


@query(r"""select doc_id, list_filter(regexp_extract_all(left('Micr' || chr(1086) || 'soft ' || text, 20000), '\p{L}{3,}'), lambda w: regexp_matches(w, '[A-Za-z]') and regexp_matches(w, '[\x{0370}-\x{04FF}]')) as words from documents""")
def b13_mixed_scripts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.mixed_script_words(F.concat(F.lit("Micrоsoft "), "text")).alias("words"))


@query(r"""with t as (select conv_id, turn, role, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) || chr(10) || '> quoted' || chr(10) || 'a(a)b.example' || chr(10) || '-- ' || chr(10) || 'signature' as t from conversations),
u as (select conv_id, turn, role, case when length(regexp_extract(t, '(?s)^(.*?)\n-- \n', 1)) > 0 then regexp_extract(t, '(?s)^(.*?\n)-- \n', 1) else t end as t from t)
select conv_id, turn, role, regexp_replace(regexp_replace(t, '(?m)^[ \t]*>.*$\n?', '', 'g'), '\S+\(a\)\S+', ' emailtoken ', 'g') as body from u""")
def b14_visible_body(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n> quoted\na(a)b.example\n-- \nsignature"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", text.visible_body(body).alias("body"))


@query(r"""select doc_id, regexp_replace('URL: http://x' || chr(10) || text || ' =?utf-8?B?YQ==?=', '(?m)=\?[A-Za-z0-9_\-]+\?[BQbq]\?[^?\s]*\?=|^\s*(URL|Date):.*$', ' ', 'g') as t from documents""")
def b15_format_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.strip_format_artifacts(F.concat(F.lit("URL: http://x\n"), "text", F.lit(" =?utf-8?B?YQ==?="))).alias("t"))


@query(rf"""select doc_id, regexp_replace(regexp_replace(lower(source) || ' via users enron Python ' || lang, '(?i)\bvia \S+ mailing list\b|\bvia (users|devel|announce)\b', ' ', 'g'), '(?i)\b({text.CORPUS_WORDS})\b', ' ', 'g') as t from documents""")
def b16_corpus_words(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.scrub_corpus_words(F.concat(F.lower("source"), F.lit(" via users enron Python "), "lang")).alias("t"))


@query(r"""select doc_id, case when k = '' then 'body:' || source else k end as k from (select doc_id, source, trim(regexp_replace(regexp_replace(lower('Re: [list] FW: ' || left(text, 60)), '^\s*((re|fw|fwd|aw|sv)\s*:\s*|\[[^\]]*\]\s*)+', ''), '[^\p{L}]+', ' ', 'g')) as k from documents)""")
def b17_group_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.group_key(F.concat(F.lit("Re: [list] FW: "), F.left("text", F.lit(60))), F.col("source")).alias("k"))


@query("select doc_id, sha1(lower(text)) as hash, left(sha256(text), 16) as id from documents")
def b18_b19_hashes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"), text.stable_id(F.col("text")).alias("id"))


_SHINGLES = r"""with w as (select doc_id, regexp_extract_all(lower(text), '\p{L}+') as w from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) as shingle from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
q as (select * from s where left(shingle, 1) in ('0', '1', '2', '3'))"""


@query(f"{_SHINGLES} select doc_id, shingle from q")
def b21_shingles(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.shingle_rows(read(spark, d, "documents"), "doc_id")


@query()
def b20_broken_translation(spark: SparkSession, d: str) -> DataFrame:
    """Back-references: RE2 has none."""
    return read(spark, d, "documents").select("doc_id", text.broken_translation(F.col("text")).alias("broken"))


@query()
def b22_mask_links(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "documents").select("doc_id", "text", text.mask_links(F.col("text")).alias("m"))
    single = lambda t: text.strip(F.regexp_replace(t, r"[\s\p{Z}]+", " "))
    return m.select("doc_id", "m.masked", "m.found", (single(text.unmask_links(F.col("m.masked"), F.col("m.found"))) == single(F.col("text"))).alias("restored"))


@query()
def b23_chunks(spark: SparkSession, d: str) -> DataFrame:
    from sievelight.functions.python_text import chunks

    return read(spark, d, "documents").select("doc_id", F.posexplode(chunks("text")).alias("i", "chunk"))


@query(r"""with k as (select doc_id, text, lang, source, len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) as arabic, len(regexp_extract_all(text, '[\p{L}\p{N}_]')) as letters from documents)
select doc_id, length(text) >= 40 and source <> '' and case when lang = 'en' then arabic = 0 else arabic / greatest(letters, 1) > (case when source like '%a%' then 0.3 else 0.55 end) end as valid,
  length(text) + 4 >= 40 and arabic = 0 as english, (4 + arabic) / greatest(letters + 4, 1) > 0.3 and length(text) + 4 >= 40 as mixed from k""")
def b24_valid_generated(spark: SparkSession, d: str) -> DataFrame:
    register = F.when(F.contains("source", F.lit("a")), "mixed").otherwise("formal")
    t = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", text.valid_generated(t, F.col("source"), F.col("lang"), register).alias("valid"),
        text.valid_generated(F.concat(F.lit("abc "), t), F.lit("s"), F.lit("en"), F.lit("")).alias("english"),
        text.valid_generated(F.concat(F.lit("مرحب"), t), F.lit("s"), F.lit("ar"), F.lit("mixed")).alias("mixed"),
    )


LINK_LINES = [(1, " Sign in ", "https://a.example/", "Sign in: https://a.example/"), (2, "https://a.example/", "https://a.example/", "https://a.example/"), (3, None, "https://b.example/", "https://b.example/"), (4, "x", None, ""), (5, "  ", "https://c.example/", "https://c.example/")]


@query(f"select id, said || case when said = '' then '' else chr(10) end || 'last: u' as said from {values([(i, s) for i, _, _, s in LINK_LINES], 'id, said')}")
def b25_link_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, [(t, h), ("last", "u")]) for i, t, h, _ in LINK_LINES], "id int, links array<struct<text:string,href:string>>")
    return rows.select("id", text.links_text(F.col("links")).alias("said"))


@query(r"""select doc_id, source as generator, source as none, 'm:7b' as first from documents""")
def b26_generator(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.generator_of(F.concat(F.lit("generated ("), "source", F.lit(")"))).alias("generator"), text.generator_of(F.col("source")).alias("none"), text.generator_of(F.concat(F.lit("x (m:7b) ("), "source", F.lit(")"))).alias("first"))


TERMS = [("WordFeatures.verify|your", "verify your"), ("WordFeatures.numtoken|hours", "<number> hours"), ("CharFeatures.a|b|c", None)]


@query(f"select * from {values(TERMS, 'slot, term')}")
def b27_display_terms(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s, _ in TERMS], "slot string").select("slot", text.display_term(F.col("slot")).alias("term"))


@query("""select user_id % 400 as n, case when user_id % 400 <= 1 then '1 day' else (user_id % 400) || ' days' end as said,
    case when user_id % 400 <= 1 then 'يوم واحد' when user_id % 400 = 2 then 'يومين' when user_id % 400 <= 10 then (user_id % 400) || ' أيام' else (user_id % 400) || ' يومًا' end as said_ar from (select distinct user_id from events)""")
def b29_day_phrases(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return read(spark, d, "events").select("user_id").distinct().select((F.col("user_id") % 400).alias("n")).select("n", text.days(n).alias("said"), text.days_arabic(n).alias("said_ar"))


@query("""with n as (select page_id, repeat(url, 8) || '.html' as name from pages) select page_id, case when length(name) > 255 then left(name, 194) || '…' || right(name, 60) else name end as name from n""")
def b32_clamp_name(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.clamp_name(F.concat(F.repeat("url", 8), F.lit(".html"))).alias("name"))


@query()
def b34_wordpiece(spark: SparkSession, d: str) -> DataFrame:
    from sievelight.functions.python_text import wordpiece_column

    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "the", "and", "##ing", "##er"]
    return read(spark, d, "documents").select("doc_id", wordpiece_column(vocabulary, 256, lower=True)("text").alias("ids"))


# --- URLs -------------------------------------------------------------------------------------------------------------


@query(rf"""select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme, {HOST_SQL} as host,
    case when regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) end as path,
    regexp_extract(url, '(\?[^#]*)', 1) as query from pages""")
def b40_url_parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", urls.url_parts(F.col("url")).alias("p")).select("page_id", "p.scheme", "p.host", "p.path", "p.query")


FORMS = [
    ("//185.22.4.9/login", "185.22.4.9"), ("http:\\\\185.22.4.9\\login", "185.22.4.9"), ("https:185.22.4.9/login", "185.22.4.9"), ("https:/185.22.4.9/login", "185.22.4.9"),
    ("https://185.22.4.9\t/login", "185.22.4.9"), ("example.com/path", "example.com"), ("HTTPS://Example.COM./x", "example.com"), ("mailto:a@b.c", None), ("ftp://x.org/", None), ("example.com:8080/x", "example.com"),
]


@query(f"select * from {values(FORMS, 'url, host')} union all select url, {HOST_SQL} from pages")
def b41_b42_hosts(spark: SparkSession, d: str) -> DataFrame:
    u = spark.createDataFrame([(u,) for u, _ in FORMS], "url string").union(read(spark, d, "pages").select("url"))
    return u.select("url", urls.host_of(F.col("url")).alias("host"))


@query("""select c_custkey, 'mail.example' as bare, 'shop' || (c_custkey::int) || '.example' as named from customer""")
def b43_email_domains(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("int").cast("string")
    return read(spark, d, "customer").select("c_custkey", urls.email_domain(F.concat("c_name", F.lit("@Mail.Example"))).alias("bare"), urls.email_domain(F.concat("c_name", F.lit(" <a@SHOP"), k, F.lit(".example>"))).alias("named"))


_SUFFIX_ROWS = [(s, "icann") for s in dims.SUFFIXES] + [(s, "private") for s in dims.PRIVATE_SUFFIXES]
FIXED_HOSTS = [(h,) for h in "login.secure.paypal.com www.amazon.co.uk portal.gov.jo evil.xyz paypal-login.pages.dev someone.github.io github.com x.web.app report.pdf a.b.unknown shop.example.com.sa".split()]


@query(f"""with hosts as (select distinct {HOST_SQL} as host from pages union select * from {values(FIXED_HOSTS, 'host')}),
cut as (select host, string_split(host, '.') as p, unnest(range(1, len(string_split(host, '.')) + 1)) as i from hosts),
hit as (select host, min(i) as i, arg_min(division, i) as division from (select host, i, array_to_string(list_slice(p, i, len(p)), '.') as s from cut) join {values(_SUFFIX_ROWS, 'rule, division')} on s = rule group by host)
select h.host, case when coalesce(i, len(string_split(h.host, '.'))) <= 1 then h.host else array_to_string(list_slice(string_split(h.host, '.'), coalesce(i, len(string_split(h.host, '.'))) - 1, 99), '.') end as registrable,
  case when division = 'private' and i > 1 then array_to_string(list_slice(string_split(h.host, '.'), i, 99), '.') end as platform, hit.host is not null as known_tld
from hosts h left join hit on hit.host = h.host""")
def b45_b47_registrable(spark: SparkSession, d: str) -> DataFrame:
    hosts = read(spark, d, "pages").select(urls.host_of(F.col("url")).alias("host")).union(spark.createDataFrame(FIXED_HOSTS, "host string")).distinct()
    return urls.with_registrable(hosts, dims.suffix_rules(spark)).select("host", "registrable", "platform", "known_tld")


@query(f"""select page_id, split_part(h, '.', 1) as label, split_part(h, '.', -1) as tld, h = 'example.com' or suffix(h, '.example.com') as under,
  translate(replace(replace(lower(split_part(h, '.', 1)), 'rn', 'm'), 'vv', 'w'), '013547@аеорсхуіον-', 'olesataaeopcxyiov') as folded, levenshtein(split_part(h, '.', 1), 'paypal') as distance
from (select page_id, {HOST_SQL} as h from pages)""")
def b48_b52_labels(spark: SparkSession, d: str) -> DataFrame:
    h = urls.host_of(F.col("url"))
    label = urls.second_level_label(h)
    return read(spark, d, "pages").select("page_id", label.alias("label"), urls.tld(h).alias("tld"), urls.same_or_subdomain(h, F.lit("example.com")).alias("under"), urls.fold_homoglyphs(label).alias("folded"), F.levenshtein(label, F.lit("paypal")).alias("distance"))


WRAPPED = [
    ("https://www.google.com/url?q=https%3A%2F%2Fevil.example%2Flogin&sa=D", "https://evil.example/login"),
    ("https://eur01.safelinks.protection.outlook.com/?url=https%3A%2F%2Fgoogle.com%2Furl%3Fq%3Dhttps%253A%252F%252Fevil.example%252F", "https://evil.example/"),
    ("https://www.google.com/search?q=x", "https://www.google.com/search?q=x"), ("https://plain.example/", "https://plain.example/"),
]


@query(f"select * from {values(WRAPPED, 'href, target')} union all select 'https://www.google.com/url?sa=D&q=' || replace(replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '&', '%26'), '#', '%23'), url from pages")
def b54_unwrap(spark: SparkSession, d: str) -> DataFrame:
    wrapped = read(spark, d, "pages").select("url")
    for raw, coded in ((":", "%3A"), ("/", "%2F"), ("?", "%3F"), ("&", "%26"), ("#", "%23")):
        wrapped = wrapped.withColumn("url", F.replace("url", F.lit(raw), F.lit(coded)))
    hrefs = spark.createDataFrame([(u,) for u, _ in WRAPPED], "href string").union(wrapped.select(F.concat(F.lit("https://www.google.com/url?sa=D&q="), "url")))
    return hrefs.select("href", urls.unwrap(F.col("href")).alias("target"))


FLAGGED = [(h,) for h in "gmail.com bit.ly evil.xyz x.zip example.com mail.ru t.co shop.live".split()]


@query(f"select host, host in {tuple(urls.FREE_MAIL)} as free_mail, host in {tuple(urls.SHORTENERS)} as shortener, split_part(host, '.', -1) in {tuple(urls.SUSPICIOUS_TLDS)} as abused from {values(FLAGGED, 'host')}")
def b53_b56_host_sets(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("host")
    return spark.createDataFrame(FLAGGED, "host string").select("host", urls.is_free_mail(h).alias("free_mail"), urls.is_shortener(h).alias("shortener"), urls.has_suspicious_tld(h).alias("abused"))


NEUTRAL = [("mailto:a@b.c", True), ("TEL:1", True), ("https://www.google.com/maps/place/x", True), ("https://maps-google.com.evil.example/maps/x", False), ("javascript:alert(1)", False), ("https://google.com/url", False)]


@query(f"select * from {values(NEUTRAL, 'href, neutral')}")
def b61_neutral_links(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h, _ in NEUTRAL], "href string").select("href", urls.is_neutral_link(F.col("href")).alias("neutral"))


@query(f"select page_id, {KEY_SQL} as key, {HOST_SQL} as host from pages")
def b62_feed_keys(spark: SparkSession, d: str) -> DataFrame:
    key = urls.feed_key(F.col("url"))
    return read(spark, d, "pages").select("page_id", key.alias("key"), urls.feed_host(key).alias("host"))


ADDRESSES = [
    *((a, False) for a in "127.0.0.1 10.1.2.3 172.20.0.5 192.168.1.1 169.254.169.254 100.64.0.1 0.0.0.0 224.0.0.1 ::1 fe80::1 fd00::1 ::ffff:127.0.0.1".split()),
    *((a, True) for a in "8.8.8.8 67.199.248.10 2606:4700:4700::1111".split()),
]


@query(f"select * from {values(ADDRESSES, 'ip, public')}")
def b63_public_addresses(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in ADDRESSES], "ip string").select("ip", urls.is_public_address(F.col("ip")).alias("public"))


RATE_KEYS = [
    ("10.0.0.1", "ip:10.0.0.1"), ("::ffff:10.0.0.1", "ip:10.0.0.1"), ("::FFFF:10.0.0.2", "ip:10.0.0.2"), ("0:0:0:0:0:ffff:10.0.0.3", "ip:10.0.0.3"), ("::1", "ip:::/64"), ("2001:0DB8::1", "ip:2001:db8::/64"), ("2001:db8:0:0:1::", "ip:2001:db8::/64"),
    ("2001:db8:5:0001:a:b:c:d", "ip:2001:db8:5:1::/64"), ("fe80::1%eth0", "ip:fe80::/64"), ("0:0:0:7::1", "ip:0:0:0:7::/64"), (None, "ip:unknown"),
]


@query(f"""select coalesce(ip, '') as ip, key from {values(RATE_KEYS, 'ip, key')} union all select '2001:db8:' || (user_id % 200) || ':1:2:3:4:5', 'ip:2001:db8:' || (user_id % 200) || ':1::/64' from (select distinct user_id from events)""")
def b64_rate_keys(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("user_id") % 200).cast("string")
    many = read(spark, d, "events").select("user_id").distinct().select(F.concat(F.lit("2001:db8:"), n, F.lit(":1:2:3:4:5")).alias("ip"))
    ips = spark.createDataFrame([(i,) for i, _ in RATE_KEYS], "ip string").union(many)
    return ips.select(F.coalesce("ip", F.lit("")).alias("ip"), urls.rate_key(F.col("ip")).alias("key"))


@query("select page_id, url like 'https://%' as secure from pages")
def b65_secure_urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", urls.is_secure_endpoint(F.col("url")).alias("secure"))


# --- Headers, labels, numbers -----------------------------------------------------------------------------------------


@query(r"""select c_custkey, 'A very long subject' as subject, 'c' || (c_custkey::int) || '@x.example' as address, c_name as name, 'fail' as spf, 'pass' as dkim, 'none' as dmarc, 2::bigint as n_results from customer""")
def b70_b73_headers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("int").cast("string")
    raw = F.concat(F.lit("Subject: A very\r\n long subject\r\nFROM: \""), "c_name", F.lit('" <c'), k, F.lit("@x.example>\r\nAuthentication-Results: mx; spf=fail x; SPF=pass; dkim = PASS\r\nAuthentication-Results: dmarc=pass\r\n\r\nBody: no"))
    h = H.parse_headers(F.col("raw"))
    c = read(spark, d, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", h.alias("h"))
    top = H.get_first(F.col("h"), "authentication-results")
    sender = H.get_first(F.col("h"), "from")
    return c.select("c_custkey", H.get_first(F.col("h"), "subject").alias("subject"), H.first_address(sender).alias("address"), H.display_name(sender).alias("name"), *(H.auth_result(top, m).alias(m) for m in ("spf", "dkim", "dmarc")), F.size(H.get_all(F.col("h"), "Authentication-Results")).cast("long").alias("n_results"))


@query("""select doc_id, case when length(text) > 2000 then 'subject' end as wrong, length(text) <= 2000 as fine from documents""")
def b74_validation(spark: SparkSession, d: str) -> DataFrame:
    email = F.struct(F.lit(None).cast("string").alias("body"), F.col("text").alias("subject"), F.lit("").alias("raw_headers"), F.array().cast("array<string>").alias("links"), F.array().cast("array<string>").alias("attachments"), F.array().cast("array<string>").alias("qr_code_urls"))
    m = read(spark, d, "documents").select("doc_id", email.alias("email")).select("doc_id", labels.request_problems().alias("p"))
    return m.select("doc_id", F.get(F.map_keys("p"), F.lit(0)).alias("wrong"), (F.size("p") == 0).alias("fine"))


@query("""select distinct v as verdict, c as correct, case when v = 'suspicious' then null when (v = 'phishing') = c then 'phishing' else 'legitimate' end as label
from (select unnest(['phishing', 'suspicious', 'safe']) as v), (select unnest([true, false]) as c)""")
def b77_implied_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(v, c) for v in ("phishing", "suspicious", "safe") for c in (True, False)], "verdict string, correct boolean")
    return rows.withColumn("label", labels.implied_label(F.col("verdict"), F.col("correct")))


MAIL_LABELS = [("Inbox,Kategorie Werbung", "promotions"), ("Posteingang", "inbox"), ("Sent,Inbox", None), ("Unknown", "other"), ("Purchases, Promotions", "purchases")]


@query(f"select * from {values(MAIL_LABELS, 'labels, category')}")
def b78_categories(spark: SparkSession, d: str) -> DataFrame:
    names = {"inbox": "inbox", "posteingang": "inbox", "sent": "sent", "promotions": "promotions", "kategorie werbung": "promotions", "purchases": "purchases"}
    return spark.createDataFrame([(m,) for m, _ in MAIL_LABELS], "labels string").withColumn("category", labels.category_of(F.col("labels"), names, ["purchases", "promotions", "inbox"]))


def _bucket(key: str, n: int = 100) -> str:
    h = f"sha256({key})"
    return f"(('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))::bigint % {n})"


@query(f"""select doc_id, case when {_bucket('text')} < 20 then 'test' when {_bucket('text')} < 30 and lang = 'en' then 'tune' else 'train' end as split,
  {_bucket("'fold|' || text", 3)}::int as fold, case when {_bucket('source')} < 15 then 'test' when {_bucket('source')} < 25 then 'val' else 'train' end as pair_split from documents""")
def b79_b81_splits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", labels.split_of(F.col("text"), F.col("lang") == "en").alias("split"), labels.fold_of(F.col("text")).alias("fold"), labels.generated_split(F.col("source")).alias("pair_split"))


@query("""select c.c_custkey from customer c join (select sha256(c_name) as h from customer where c_custkey <= 100) k on k.h = sha256(c.c_name)""")
def b82_api_keys(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    clients = c.where("c_custkey <= 100").select(F.sha2("c_name", 256).alias("key_hash"))  # the registered clients
    return c.withColumn("key_hash", F.sha2("c_name", 256)).join(clients, "key_hash", "left_semi").select("c_custkey")


@query("""select event_type, 1 - product(1 - greatest(0, least(1, value / 1000))) as score, 1 - (1 - 0.5) * (1 - 0.5) as half from events where value is not null and value < 50 and user_id < 20 group by event_type""")
def b90_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("value is not null and value < 50 and user_id < 20")
    return e.groupBy("event_type").agg(labels.noisy_or_agg(F.col("value") / 1000).alias("score")).withColumn("half", labels.noisy_or(F.array(F.lit(0.5), F.lit(0.5))))


@query("""select event_type, count(*) as n, 1 - product(1 - greatest(0, least(1, value / 1000))) as score from events where value is not null group by event_type""")
def b90_noisy_or_all(spark: SparkSession, d: str) -> DataFrame:
    """All events with a value. Many weights round the score to 1."""
    e = read(spark, d, "events").where("value is not null")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), labels.noisy_or_agg(F.col("value") / 1000).alias("score"))


@query("""select event_id, 1 / (1 + exp(-(1.0162 * ln(p / (1 - p)) + 0.52364))) as calibrated, exp(p - 1) / (exp(p - 1) + 1) as soft from (select event_id, greatest(1e-6, least(1 - 1e-6, value / 1000)) as p from events)""")
def b93_b94_calibration(spark: SparkSession, d: str) -> DataFrame:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("value") / 1000))
    return read(spark, d, "events").select("event_id", labels.platt(p, 1.0162, 0.52364).alias("calibrated"), F.get(labels.softmax(F.array(p, F.lit(1.0))), F.lit(0)).alias("soft"))


@query("""select event_id, floor(epoch(timestamp '2024-03-01 00:00:00' - ts) / 86400)::int as age from events""")
def b96_age(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", labels.age_days(F.lit("2024-03-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")).alias("age"))


# --- Rules ------------------------------------------------------------------------------------------------------------

LINK_CASES = [
    (1, None, "Login", "http://192.168.10.5/login", "ip-url"),
    (2, None, "https://www.paypal.com/signin", "https://secure-update.xyz/pp", "suspicious-tld,text-href-mismatch"),
    (3, None, "Sign in", "https://www.google.com/url?q=https%3A%2F%2Fpaypa1.com%2Flogin&sa=D", "lookalike-domain"),
    (4, None, "see", "https://github.com/a/b", ""),
    (5, None, "track", "https://bit.ly/abc", "shortener"),
    (6, None, "facebook.com", "https://facebookmail.com/x", ""),
    (7, None, "amazon.com", "https://x.s3.amazonaws.com/login", "text-href-mismatch,user-content-host"),
    (8, None, "github.com", "https://attacker.github.io/", "text-href-mismatch,user-content-host"),
    (9, "notify@x.com", "youtu.be/abc123", "https://twitter.com/i/redirect?id=1", ""),
    (10, "alerts@evil-notify.com", "youtu.be/abc123", "https://twitter.com/i/redirect?id=1", "text-href-mismatch"),
    (11, "news@openai.com", "openai.com/blog", "https://mandrillapp.com/track/click/123", "tracked-link"),
    (12, "billing@random-shop.com", "www.paypal.com", "https://u123.ct.sendgrid.net/ls/click?x=1", "text-href-mismatch"),
    (13, None, "score.py", "https://other.example/", "filename-link-text"),
    (14, None, "quarterly-chart-data.csv", "https://other.example/", ""),
    (15, None, "invoice.zip", "https://other.example/", "text-href-mismatch"),
    (16, None, "Review", "https://sites.google.com/view/paypal-account-review", "brand-on-user-content,user-content-host"),
    (17, None, "Register", "https://forms.gle/AbC123xyz", "user-content-host"),
    (18, None, "x", "https://user@evil.example/", "userinfo-url"),
    (19, None, "x", "https://xn--pypal-4ve.com/", "lookalike-domain,punycode"),
    (20, None, "mail", "mailto:a@b.c", ""),
]


def _mails(spark: SparkSession, rows: list[dict]) -> DataFrame:
    fields = ("email_id", "subject", "sender_name", "sender_email", "reply_to", "body", "raw_headers", "links", "attachments", "qr_code_urls")
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], rules.SUBMISSION)


# What each finding weighs.
LINK_WEIGHTS = [
    ("ip-url", 0.45), ("punycode", 0.30), ("lookalike-domain", 0.60), ("user-content-host", 0.15), ("brand-on-user-content", 0.50), ("shortener", 0.15),
    ("suspicious-tld", 0.12), ("userinfo-url", 0.40), ("filename-link-text", 0.10), ("tracked-link", 0.10), ("text-href-mismatch", 0.45),
]
HEADER_WEIGHTS = [
    ("lookalike-sender", 0.65), ("brand-display-freemail", 0.50), ("brand-display-mismatch", 0.40), ("display-name-address", 0.45), ("reply-to-freemail", 0.35), ("reply-to-mismatch", 0.20),
    ("auth-missing", 0.10), ("dmarc-fail", 0.50), ("compauth-fail", 0.35), ("spf-fail", 0.35), ("dkim-fail", 0.30), ("auth-none", 0.15), ("auth-pass", 0.0), ("verified-brand-sender", 0.0),
]


def _weighed(cases: list[tuple], weights: list[tuple]) -> str:
    """SQL: the codes of each case and the noisy-OR of their weights; a soft SPF failure (case 6) weighs 0.15."""
    return f"""select c.email_id, any_value(codes) as codes, coalesce(round(1 - product(1 - case when c.email_id = 6 and code = 'spf-fail' then 0.15 else weight end), 9), 0) as score
from (select email_id, codes, unnest(string_split(codes, ',')) as code from {values(cases, 'email_id, codes')}) c left join {values(weights, 'name, weight')} w on code = name group by c.email_id"""


@query(_weighed([(i, c) for i, _, _, _, c in LINK_CASES], LINK_WEIGHTS))
def c_link_rules(spark: SparkSession, d: str) -> DataFrame:
    mails = rules.with_qr_links(_mails(spark, [{"email_id": i, "sender_email": s, "links": [{"text": t, "href": h}]} for i, s, t, h, _ in LINK_CASES]))
    links, c = rules.exploded_links(mails), Catalogue.default(spark)
    found = rules.link_findings(mails, links, rules.facts_for(mails, links, c), c)
    return found.select("email_id", F.array_join(F.sort_array(F.transform("findings", lambda f: f["code"])), ",").alias("codes"), F.round("score", 9).alias("score"))


_AUTH = "Authentication-Results: mx; spf={0}; dkim={1}; dmarc={2}"
HEADER_CASES = [
    (1, "PayPal Support", "x@gmail.com", None, None, "brand-display-freemail"), (2, "Bob", "ceo@company.com", "ceo@outlook.com", None, "reply-to-freemail"),
    (3, "service@paypal.com", "a@evil.xyz", None, None, "brand-display-mismatch,display-name-address"), (4, None, "a@paypa1.com", None, None, "lookalike-sender"),
    (5, "Bob", "b@c.com", None, "Subject: x", "auth-missing"), (6, "Bob", "b@c.com", None, _AUTH.format("softfail", "fail", "fail"), "dkim-fail,dmarc-fail,spf-fail"),
    (7, "Bob", "b@c.com", None, "Authentication-Results: compauth=fail; dmarc=temperror; spf=pass", "compauth-fail"), (8, "Bob", "b@c.com", None, _AUTH.format("pass", "pass", "pass"), "auth-pass"),
    (9, "Apple", "id@email.apple.com", None, _AUTH.format("pass", "pass", "pass"), "auth-pass,verified-brand-sender"), (10, "Bob", "b@c.com", "b@d.com", _AUTH.format("none", "none", "none"), "auth-none,reply-to-mismatch"),
    (11, "Bob", "b@c.com", None, _AUTH.format("fail", "pass", "pass"), "spf-fail"), (12, "Bob", "b@c.com", None, _AUTH.format("neutral", "none", "fail"), "auth-none,dmarc-fail"),
]


@query(_weighed([(r[0], r[5]) for r in HEADER_CASES], HEADER_WEIGHTS))
def c_header_rules(spark: SparkSession, d: str) -> DataFrame:
    mails = rules.with_qr_links(_mails(spark, [{"email_id": i, "sender_name": n, "sender_email": s, "reply_to": r, "raw_headers": h} for i, n, s, r, h, _ in HEADER_CASES]))
    links, c = rules.exploded_links(mails), Catalogue.default(spark)
    found = rules.header_findings(mails, links, rules.facts_for(mails, links, c), c)
    return found.select("email_id", F.array_join(F.sort_array(F.transform("findings", lambda f: f["code"])), ",").alias("codes"), F.round("score", 9).alias("score"))


@query(f"""with n as (select p_partkey, p_name || case (p_partkey % 7)::int when 0 then '.exe' when 1 then '.iso' when 2 then '.svg' when 3 then '.xlsm' when 4 then '.zip' when 5 then '.pdf.exe' else '.pdf' end as name, (p_partkey % 7)::int as k, p_partkey % 2 = 0 as pw from part)
select p_partkey, case k when 0 then 'executable-attachment' when 1 then 'disk-image-attachment' when 2 then 'html-attachment' when 3 then 'macro-attachment' when 4 then case when pw then 'password-archive' else '' end when 5 then 'double-extension,executable-attachment' else '' end as codes,
  case k when 0 then 0.6 when 1 then 0.5 when 2 then 0.45 when 3 then 0.4 when 4 then case when pw then 0.4 else 0.0 end when 5 then 0.84 else 0.0 end::double as score from n""")
def c_attachment_rules(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 7).cast("int")
    ending = F.element_at(F.array(*map(F.lit, [".exe", ".iso", ".svg", ".xlsm", ".zip", ".pdf.exe", ".pdf"])), k + 1)
    mails = read(spark, d, "part").select(F.col("p_partkey").alias("email_id"), F.when(F.col("p_partkey") % 2 == 0, "Password: 4471").alias("body"), F.array(F.struct(F.concat("p_name", ending).alias("name"), F.lit(None).cast("string").alias("mime_type"))).alias("attachments"))
    return rules.attachment_findings(mails).select(F.col("email_id").alias("p_partkey"), F.array_join(F.sort_array(F.transform("findings", lambda f: f["code"])), ",").alias("codes"), F.round("score", 9).alias("score"))


@query(r"""select doc_id, case when len(w) > 0 then 0.35 else 0.0 end::double as score, len(w) as n from (select doc_id, list_filter(regexp_extract_all(left('Micr' || chr(1086) || 'soft ' || text, 20000), '\p{L}{3,}'), lambda w: regexp_matches(w, '[A-Za-z]') and regexp_matches(w, '[\x{0370}-\x{04FF}]')) as w from documents)""")
def c_obfuscation_rules(spark: SparkSession, d: str) -> DataFrame:
    mails = read(spark, d, "documents").select(F.col("doc_id").alias("email_id"), F.lit(None).cast("string").alias("sender_name"), F.lit("Micrоsoft").alias("subject"), F.col("text").alias("body"))
    found = rules.obfuscation_findings(mails).select(F.col("email_id").alias("doc_id"), F.round("score", 9).alias("score"))
    return found.join(read(spark, d, "documents").select("doc_id", F.size(text.mixed_script_words(F.concat(F.lit("Micrоsoft "), "text"))).cast("long").alias("n")), "doc_id")


AGES = [(3, "new-domain", 0.5), (29, "new-domain", 0.5), (30, "young-domain", 0.2), (179, "young-domain", 0.2), (200, "", 0.0), (400, "established-sender", 0.0)]


@query(f"select * from {values(AGES, 'age, codes, score')}")
def c_reputation_ages(spark: SparkSession, d: str) -> DataFrame:
    mails = rules.with_qr_links(_mails(spark, [{"email_id": a, "sender_email": f"x@shop{a}.com"} for a, _, _ in AGES]))
    links, c = rules.exploded_links(mails), Catalogue.default(spark)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    known = spark.createDataFrame([(f"shop{a}.com", a) for a, _, _ in AGES], "domain string, age int").select("domain", F.timestamp_seconds(F.unix_timestamp(now) - F.col("age") * 86400).alias("registered_ts"), F.lit(True).alias("checked"))
    found = rules.reputation_findings(mails, links, rules.facts_for(mails, links, c), now, registrations=known)
    return found.select(F.col("email_id").cast("int").alias("age"), F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"), F.round("score", 9).alias("score"))


SPOOFS = [
    ("paypa1.com", "PayPal", "homoglyph"), ("rnicrosoft.com", "Microsoft", "homoglyph"), ("amazom.com", "Amazon", "typosquat"), ("paypal-secure-login.com", "PayPal", "brand-in-domain"),
    ("dhl-parcel.info", "DHL", "brand-in-domain"), ("paypal.com.account-verify.xyz", "PayPal", "brand-in-subdomain"), ("efawateercom-pay.net", "eFAWATEERcom", "brand-in-domain"),
    ("alrajhlbank.com", "Al Rajhi Bank", "typosquat"), ("arabbank.jo.secure-login.xyz", "Arab Bank", "brand-in-subdomain"),
    *((h, None, None) for h in "paypal.com www.paypal.com accounts.google.com purchase.com pineapple.com me.example.com github.io stackoverflow.com cab-booking.com stc-events.org".split()),
]


@query(f"select * from {values(SPOOFS, 'host, looks_like, kind')} union all select distinct {HOST_SQL}, null, null from pages where {HOST_SQL} not like '%amazon%'")
def c_impersonation(spark: SparkSession, d: str) -> DataFrame:
    c = Catalogue.default(spark)
    hosts = spark.createDataFrame([(h,) for h, _, _ in SPOOFS], "host string").union(read(spark, d, "pages").select(urls.host_of(F.col("url"))))
    return host_facts(hosts, c).select("host", "looks_like", "kind")


NAMES = [("PayPal Security Team", "PayPal"), ("Bank Of America Alerts", "Bank of America"), ("Microsoft 365", "Microsoft"), ("Sarah Ahmad", None), ("Groups of friends", None), ("البنك العربي الوطني", "Arab National Bank"), ("البنک العربی", "Arab Bank"), ("p​ay​pal", "PayPal")]


@query(f"select * from {values(NAMES, 'name, brand')}")
def c_brand_mentions(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n, _ in NAMES], "name string")
    return names.join(mentioned_brands(names, Catalogue.default(spark)), "name", "left")


TEMPLATES = [
    ("PayPal Support", "service@paypal-billing.com", None, "Pay now", "https://paypa1.com/login", "invoice.pdf.exe"),
    ("Ann", "ann@company.com", None, "company.com", "https://company.com/report", "report.pdf"),
    ("Bank", "alerts@bank.example", "x@gmail.com", "https://www.paypal.com/", "https://bit.ly/x", "scan.zip"),
    ("News", "news@list.example", None, "read", "https://evil.xyz/", "page.html"),
]


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """Each document as the body of one of a few mail templates."""
    k = len(TEMPLATES)
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(TEMPLATES)], "k int, sender_name string, sender_email string, reply_to string, link_text string, href string, attachment string")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("email_id"), (F.col("doc_id") % k).cast("int").alias("k"), F.col("text").alias("body"))
    return docs.join(F.broadcast(t), "k").select(
        "email_id", F.left("body", F.lit(60)).alias("subject"), "sender_name", "sender_email", "reply_to", "body", F.lit(None).cast("string").alias("raw_headers"),
        F.array(F.struct(F.col("link_text").alias("text"), "href")).alias("links"), F.array(F.struct(F.col("attachment").alias("name"), F.lit(None).cast("string").alias("mime_type"))).alias("attachments"),
        F.array().cast("array<string>").alias("qr_code_urls"),
    )


# What the four templates score by rules alone, per signal: headers, links, attachments (password decides the third).
_SCORES = [
    "1 - (1 - 0.65) * (1 - 0.4) * 1", "0", "0.35", "0",
    "0.6", "0", "1 - (1 - 0.15) * (1 - 0.45)", "0.12",
    "1 - 0.4 * 0.4", "0", "case when pw then 0.4 else 0 end", "0.45",
]


@query(rf"""with m as (select doc_id as email_id, (doc_id % 4)::int as k, regexp_matches(text, '(?i)(?:password|passcode|pwd|pass|كلمة\s*(?:المرور|السر))\s*[:=]?\s*\S{{3,}}') as pw from documents),
s as (select email_id, case k when 0 then {_SCORES[0]} when 1 then {_SCORES[1]} when 2 then {_SCORES[2]} else {_SCORES[3]} end as headers, case k when 0 then {_SCORES[4]} when 1 then {_SCORES[5]} when 2 then {_SCORES[6]} else {_SCORES[7]} end as links,
  case k when 0 then {_SCORES[8]} when 1 then {_SCORES[9]} when 2 then {_SCORES[10]} else {_SCORES[11]} end as attachments from m),
f as (select email_id, 1 - (1 - 0.9 * 0.3) * (1 - headers) * (1 - links) * (1 - attachments) as score from s)
select email_id, case when score >= 0.5 then 'phishing' when score >= 0.25 then 'suspicious' else 'safe' end as verdict, round_even(score, 3)::double as score from f""")
def score_mails(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every mail through all rules, fused with a text score, to a verdict."""
    options = scoring.Options(phishing_threshold=0.5, suspicious_threshold=0.25)
    return scoring.analyse(submissions(spark, d), Catalogue.default(spark), scoring.FixedScorer(0.3), options, plain=True).select("email_id", "verdict", "score")


@query()
def explain_mails(spark: SparkSession, d: str) -> DataFrame:
    """Reasons, limitations and the breakdown of every mail."""
    return scoring.analyse(submissions(spark, d), Catalogue.default(spark), scoring.FixedScorer(0.6)).select("email_id", "verdict", "reasons", "limitations", "language")


# --- Joins ------------------------------------------------------------------------------------------------------------


@query(f"""with feed as (select distinct {KEY_SQL} as key, {HOST_SQL} as host from pages where url like 'https%')
select page_id, case when {KEY_SQL} in (select key from feed) then 'url' else 'host' end as hit from pages where {KEY_SQL} in (select key from feed) or {HOST_SQL} in (select host from feed)""")
def j1_feed_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    u, h = rules.feed_tables(p.where("url like 'https%'").select(F.lit("open").alias("feed"), F.col("url").alias("line")), ["open"])
    return rules.match_feeds(p.select("page_id", "url"), u, h).select("page_id", F.when(F.col("exact"), "url").otherwise("host").alias("hit"))


OWNED = [("docs.github.com", "GitHub"), ("attacker.github.io", None), ("contoso.sharepoint.com", None), ("sites.google.com", None), ("evilpaypal.com", None), ("mail.google.com", "Google")]


@query(f"select * from {values(OWNED, 'host, owner')}")
def j2_j3_owners(spark: SparkSession, d: str) -> DataFrame:
    return host_facts(spark.createDataFrame([(h,) for h, _ in OWNED], "host string"), Catalogue.default(spark)).select("host", "owner")


@query("""select o_orderkey, c_name, case when c_custkey is null then false else true end as known from orders left join (select * from customer where c_custkey % 2 = 0) c on o_custkey = c_custkey""")
def j7_left_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")  # the registrations known
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", F.col("c_custkey").isNotNull().alias("known"))


HOPS = [("https://bit.ly/a", 301, "https://tinyurl.com/b"), ("https://tinyurl.com/b", 302, "https://paypa1-secure.xyz/"), ("https://is.gd/c", 200, None), ("https://paypa1-secure.xyz/", 301, "https://never.example/")]


@query("select * from (values (1, 'https://bit.ly/a', 'https://paypa1-secure.xyz/', 2)) as v(email_id, short_url, destination, hops)")
def j8_short_links(spark: SparkSession, d: str) -> DataFrame:
    mails = rules.with_qr_links(_mails(spark, [{"email_id": 1, "links": [{"text": "a", "href": "https://bit.ly/a"}]}, {"email_id": 2, "links": [{"text": "c", "href": "https://is.gd/c"}]}]))
    found = rules.expand_short_links(rules.exploded_links(mails), spark.createDataFrame(HOPS, "short_url string, status int, location string"))
    return found.select(F.col("email_id").cast("int").alias("email_id"), "short_url", "destination", "hops")


@query(rf"""{_SHINGLES}, known as (select distinct shingle from q join documents using (doc_id) where {_bucket('text')} >= 20),
c as (select q.doc_id, count(*) as n_shingles, count(known.shingle) / count(*) as contained from q join documents d on d.doc_id = q.doc_id and {_bucket('d.text')} < 20 left join known on known.shingle = q.shingle group by q.doc_id)
select doc_id, n_shingles, contained::double as contained, case when n_shingles < 5 then 'too short' when contained < 0.5 then 'new' when contained < 0.8 then 'partly known' else 'near copy' end as bucket from c""")
def j13_g23_containment(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("test", labels.bucket_of(F.col("text")) < 20)
    test, train = (near_duplicates.shingle_rows(docs.where(w), "doc_id") for w in ("test", "not test"))
    return near_duplicates.containment(test, train, "doc_id").withColumn("bucket", near_duplicates.novelty_bucket())


@query("""select e.event_id, floor(epoch(e.ts - (timestamp '2023-01-01 00:00:00' + to_days((e.user_id % 300)::int))) / 86400)::int as age from events e""")
def j17_as_of_age(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    known = e.select("user_id").distinct().withColumn("registered_ts", F.timestamp_seconds(F.unix_timestamp(F.lit("2023-01-01 00:00:00").cast("timestamp")) + (F.col("user_id") % 300) * 86400))
    return e.join(known, "user_id").select("event_id", labels.age_days(F.col("ts"), F.col("registered_ts")).alias("age"))


# --- Aggregations -----------------------------------------------------------------------------------------------------


@query("""select user_id, event_type, arg_min(event_id, (-value, event_id)) as event_id from events where value is not null group by user_id, event_type""")
def g1_heaviest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("value is not null").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct(-F.col("value"), "event_id")).alias("event_id"))


_VOTES = "select case event_type when 'purchase' then 'phishing' when 'click' then 'suspicious' else 'safe' end as verdict, value > 50 as correct, user_id % 3 = 0 as has_email from events where value is not null"


@query(f"""with v as ({_VOTES}) select verdict, count(*) as total, count(*) filter (where correct) as correct, count(*) filter (where not correct) as wrong, count(*) filter (where has_email) as with_email from v group by verdict""")
def g4_feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "purchase", "phishing").when(F.col("event_type") == "click", "suspicious").otherwise("safe")
    votes = read(spark, d, "events").where("value is not null").select(verdict.alias("verdict"), (F.col("value") > 50).alias("correct"), (F.col("user_id") % 3 == 0).alias("has_email"))
    return operations.feedback_summary(votes)


@query(f"select le, count(*) as n from (select case {' '.join(f'when value / 100 <= {b} then {b}' for b in operations.BOUNDS)} else 'infinity'::double end as le from events where value is not null) group by le")
def g6_histogram(spark: SparkSession, d: str) -> DataFrame:
    return operations.histogram(read(spark, d, "events").where("value is not null"), F.col("value") / 100)


@query(f"""{_SHINGLES}, common as (select shingle from q group by shingle having count(*) > 50), rare as (select * from q where shingle not in (select shingle from common)),
enough as (select doc_id from rare group by doc_id having count(*) >= 3) select doc_id, count(*) as n from rare where doc_id in (select doc_id from enough) group by doc_id""")
def g7_shingle_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = near_duplicates.usable_shingles(near_duplicates.shingle_rows(read(spark, d, "documents"), "doc_id"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def g8_minhash_clusters(spark: SparkSession, d: str) -> DataFrame:
    """MinHash by a 64-bit hash that DuckDB lacks. The documents have no subject: equal text is their group."""
    docs = read(spark, d, "documents").withColumn("group_key", text.group_key(F.lit(""), text.content_hash(F.col("text"))))
    return near_duplicates.cluster(docs, "doc_id", group="group_key")


@query("""with recursive e as (select a.doc_id as u, b.v from (select doc_id, md5(lower(text)) as h from documents) a join (select md5(lower(text)) as h, min(doc_id) as v from documents group by 1) b using (h)),
s as (select u, v from e union select v, u from e), l as (select u as node, u as c from s union select s.u, l.c from l join s on l.node = s.v)
select node, min(c) as component from l group by node""")
def g9_components(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "documents").select("doc_id", F.md5(F.lower("text")).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("v"))
    return connected_components(h.join(first, "h").select("doc_id", "v"), "doc_id", "v")


@query("""select source, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'es') as es, count(*) filter (where lang = 'fr') as fr from documents group by source""")
def g10_corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.counts_by(read(spark, d, "documents"), ["source"], "lang", ["de", "en", "es", "fr"])


@query("""with a as (select source, doc_id, lower(text) as h, length(text) < 200 as short, lang <> 'en' as other from documents),
s as (select source, case when short then 'too_short' when other then 'non_english' when row_number() over (partition by h, not short and not other order by doc_id) > 1 then 'duplicate' else 'kept' end as status from a)
select source, count(*) as read, count(*) filter (where status = 'too_short') as too_short, count(*) filter (where status = 'non_english') as non_english, count(*) filter (where status = 'duplicate') as duplicate, count(*) filter (where status = 'kept') as kept from s group by source""")
def g11_source_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("source", "text", F.col("lang").alias("language"), F.sha1(F.lower("text")).alias("hash"), F.lit(0).alias("source_ord"), F.col("doc_id").alias("row_ord"))
    return corpus.source_stats(corpus.status(rows, 200))


_SCORED = "select l.doc_id, toxic = 1 as y, quality, (length(text) % 101) / 100.0::double as s, lang, source from labels l join documents d using (doc_id)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    return j.select("doc_id", (F.col("toxic") == 1).alias("y"), "quality", (F.length("text") % 101 / 100.0).alias("s"), "lang", "source")


_RATES = "coalesce(round_even(tp / nullif(tp + fp, 0), 4), 0) as precision, coalesce(round_even(tp / nullif(tp + fn, 0), 4), 0) as recall, coalesce(round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) as f1, coalesce(round_even(fp / nullif(fp + tn, 0), 4), 0) as fpr"
_COUNTS = "count(*) filter (where y and p) as tp, count(*) filter (where not y and p) as fp, count(*) filter (where not y and not p) as tn, count(*) filter (where y and not p) as fn"


@query(f"with r as ({_SCORED}), c as (select lang, {_COUNTS} from (select *, s >= 0.5 as p from r) group by lang) select *, {_RATES} from c")
def g12_binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.binary_metrics(_scored(spark, d), F.col("y"), F.col("s"), 0.5, ["lang"])


@query(f"""with r as ({_SCORED}), k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as k from r)
select (sum(k) filter (where y) - count(*) filter (where y) * (count(*) filter (where y) + 1) / 2.0) / (count(*) filter (where y) * count(*) filter (where not y)) as auc from k""")
def g13_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc(_scored(spark, d), F.col("y"), F.col("s"))


@query("""select quality, count(*) filter (where toxic = 0) as "0", count(*) filter (where toxic = 1) as "1" from labels group by quality""")
def g14_g15_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.matrix(read(spark, d, "labels"), "quality", "toxic", ["0", "1"])


@query(f"""with r as ({_SCORED}), c as (select distinct doc_id, y, unnest([lang, source, lang]) as code from r), t as (select count(*) filter (where y) as p, count(*) filter (where not y) as l from r)
select code, coalesce(round_even(count(*) filter (where y) / nullif(any_value(p), 0), 4), 0) as phishing_rate, coalesce(round_even(count(*) filter (where not y) / nullif(any_value(l), 0), 4), 0) as legitimate_rate from c, t group by code""")
def g16_rule_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select(F.when(F.col("y"), "phishing").otherwise("legitimate").alias("class"), F.array("lang", "source", "lang").alias("codes"))
    return evaluation.rule_rates(rows)


@query(f"""with r as ({_SCORED}) select count(*) as n, round_even(avg((s < 0.3)::int), 4) as any_failure, round_even(avg((s >= 0.3 and s < 0.8)::int), 4) as all_pass, round_even(avg((s >= 0.8)::int), 4) as missing from r""")
def g17_auth_rates(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("s") < 0.3, "spf-fail").when(F.col("s") < 0.8, "auth-pass").otherwise("auth-missing")
    return evaluation.auth_rates(_scored(spark, d).select(F.array(code).alias("codes")))


@query(f"""with r as (select *, s >= 0.5 as p from ({_SCORED})), c as (select lang, source, count(*) as n, {_COUNTS} from r group by grouping sets ((), (lang), (lang, source)) having count(*) >= 20) select *, {_RATES} from c""")
def g19_grouped_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("p", F.col("s") >= 0.5)
    return evaluation.grouped_metrics(rows, "y", "p", "lang", "source")


@query("""select source, given, predicted, count(*) as n from (select source, quality as given, (length(text) > 1000)::int as predicted from labels join documents using (doc_id)) where given <> predicted group by all""")
def g20_label_issues(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").select("source", F.col("quality").alias("given"), (F.length("text") > 1000).cast("int").alias("predicted"))
    return j.where("given <> predicted").groupBy("source", "given", "predicted").agg(F.count("*").alias("n"))


@query(f"with r as ({_SCORED}) select avg(pow(s - y::int, 2)) as brier from r")
def g21_brier(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.brier(_scored(spark, d), F.col("s"), F.col("y"))


@query()
def g22_platt_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = learning.fit_platt(_scored(spark, d), "s", "y")
    return spark.createDataFrame([(fit.a, fit.b, fit.brier_before, fit.brier_after)], "a double, b double, brier_before double, brier_after double")


@query(f"""with r as ({_SCORED}) select source as category, lang as language, count(*) as mails,
{', '.join(f"count(*) filter (where v{i} = '{v}') as {c}_{v}" for i, c in enumerate(('plain', 'corroborated', 'trusted')) for v in ('phishing', 'suspicious', 'safe'))},
count(*) filter (where v0 <> 'safe' and quality = 1) as text_only from (select *, case when s >= 0.7 then 'phishing' when s >= 0.4 then 'suspicious' else 'safe' end as v0, case when s >= 0.8 then 'phishing' when s >= 0.4 then 'suspicious' else 'safe' end as v1, case when s >= 0.9 then 'phishing' when s >= 0.6 then 'suspicious' else 'safe' end as v2 from r) group by source, lang""")
def g25_mailbox_report(spark: SparkSession, d: str) -> DataFrame:
    v = lambda hi, lo: F.when(F.col("s") >= hi, "phishing").when(F.col("s") >= lo, "suspicious").otherwise("safe")
    rows = _scored(spark, d).select(F.col("source").alias("category"), F.col("lang").alias("language"), v(0.7, 0.4).alias("plain"), v(0.8, 0.4).alias("corroborated"), v(0.9, 0.6).alias("trusted"), (1 - F.col("quality")).alias("other_score"))
    return evaluation.mailbox_report(rows)


@query(f"""with r as (select *, (1 - quality) * 0.3 as other from ({_SCORED})), c as (select * from (values (0.2, 10), (0.2, 100), (0.5, 10), (0.5, 100)) as v(factor, min_days)),
m as (select factor, min_days, y, 1 - (1 - s * case when doc_id % 200 >= min_days and other <= 0 then factor else 1 end) * (1 - other) as score, 1 - (1 - s) * (1 - other) as before from r, c)
select factor::double as factor, min_days, count(*) as n, round_even(avg((score >= 0.4)::int), 4) as warned, count(*) filter (where y and before >= 0.4 and score < 0.4) as lost from m group by factor, min_days""")
def g26_j15_what_if(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select(F.col("s").alias("p"), ((1 - F.col("quality")) * 0.3).alias("other"), (F.col("doc_id") % 200).alias("age_days"), F.when(F.col("y"), "phishing").otherwise("legitimate").alias("class"), F.lit(0.4).alias("threshold"))
    return evaluation.what_if(rows, spark.createDataFrame([(f, m) for f in (0.2, 0.5) for m in (10, 100)], "factor double, min_days int"))


@query("select source, lang, count(*) as count from documents group by source, lang order by count desc, source, lang limit 40")
def g27_g28_top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.top_pairs(read(spark, d, "documents"), ["source", "lang"])


@query("select bool_and(n > 10) as promote, coalesce(string_agg(source, ', ' order by source) filter (where n <= 10), '') as failed from (select source, count(*) as n from documents group by source)")
def g29_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gate(read(spark, d, "documents").groupBy("source").count().select(F.col("source").alias("name"), (F.col("count") > 10).alias("passed")))


@query("select lang, c as count, round_even(sqrt(sum(c) over () / (count(*) over () * c)), 6) as weight from (select lang, count(*) as c from documents group by lang)")
def g30_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.class_weights(read(spark, d, "documents"), "lang")


# --- Windows and sets -------------------------------------------------------------------------------------------------


@query("""select email_id, idx from (select 1 as email_id, idx, row_number() over (order by r, idx) as seat from (select i as idx, row_number() over (partition by i % 7 = 0 order by i) as r from range(260) t(i))) where seat <= 200""")
def w1_fair_cap(spark: SparkSession, d: str) -> DataFrame:
    links = [{"text": None, "href": f"https://{'other' if i % 7 == 0 else 'decoy'}.example/{i}"} for i in range(260)]
    mails = rules.with_qr_links(_mails(spark, [{"email_id": 1, "links": links}]))
    return rules.exploded_links(mails).select(F.col("email_id").cast("int").alias("email_id"), "idx")


@query("select doc_id from (select doc_id, row_number() over (partition by sha1(lower(text)) order by doc_id) as n from documents) where n = 1")
def w6_first_copies(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_copies(read(spark, d, "documents").withColumn("hash", text.content_hash(F.col("text"))), "hash", "doc_id").select("doc_id")


@query("select doc_id from (select doc_id, row_number() over (partition by source order by md5('42|' || doc_id), doc_id) as n from documents) where n <= 10")
def w7_seeded_cap(spark: SparkSession, d: str) -> DataFrame:
    return corpus.seeded_cap(read(spark, d, "documents"), 10, ["source"], "doc_id").select("doc_id")


@query(f"""with r as ({_SCORED}), t as (select i / 100.0::double as t, i from range(25, 96) x(i)), m as (select t, count(*) filter (where y and floor(s * 100 + 1e-9) >= i) as tp, count(*) filter (where not y and floor(s * 100 + 1e-9) >= i) as fp, count(*) filter (where y) as p, count(*) filter (where not y) as n from t, r group by t),
k as (select t, coalesce(fp / nullif(n, 0), 0) as fpr, coalesce(2 * tp / nullif(tp + fp + p, 0), 0) as f1 from m)
select coalesce((select t from k where t >= 0.5 and fpr <= 0.6 order by f1 desc, t limit 1), 0.9) as phishing, (select min(t) from k where fpr <= 0.7) as suspicious""")
def w8_j16_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.choose_thresholds(_scored(spark, d), F.col("y"), F.col("s"), 0.6, 0.7)


@query("select doc_id, (row_number() over (partition by source order by doc_id) - 1) / count(*) over (partition by source) as position from documents")
def w10_interleave(spark: SparkSession, d: str) -> DataFrame:
    return corpus.interleave(read(spark, d, "documents"), "source", "doc_id").select("doc_id", "position")


@query("select doc_id, unnest(range(1, case when lang = 'de' then 4 else 2 end))::int as copy from (select doc_id, lang, row_number() over (partition by source order by md5('42|' || doc_id), doc_id) as n from documents where lang <> 'en') where n <= 5 union all select doc_id, 1 from documents where lang = 'en'")
def w11_balance(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", (F.col("lang") == "en").alias("modern"), F.when(F.col("lang") == "de", "ar").otherwise("en").alias("language"))
    return corpus.balance(docs, 5, "source", "modern", "language", "doc_id", 3).select("doc_id", "copy")


@query("select doc_id from documents where doc_id in (select doc_id from labels) union all select doc_id from documents where doc_id not in (select doc_id from labels)")
def s1_s4_sets(spark: SparkSession, d: str) -> DataFrame:
    docs, known = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    return docs.join(known, "doc_id", "left_semi").unionByName(docs.join(known, "doc_id", "left_anti"))


@query("""select doc_id, lang <> 'en' as verdict, length(text) > 100 as version, length(source) > 4 as codes, length(text) > 20000 as email from documents""")
def b75_feedback_bounds(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    email = F.struct(F.col("text").alias("body"), none.alias("subject"), none.alias("sender_email"), F.array().cast("array<struct<text:string,href:string>>").alias("links"))
    vote = F.struct(F.when(F.col("lang") == "en", "safe").otherwise("other").alias("verdict"), F.col("text").alias("model_version"), F.lit("en").alias("language"), F.array(F.repeat("source", F.when(F.length("source") > 4, 65).otherwise(1))).alias("reason_codes"), email.alias("email"))
    m = read(spark, d, "documents").select("doc_id", vote.alias("vote")).select("doc_id", F.map_keys(labels.feedback_problems()).alias("p"))
    has = lambda k: F.array_contains("p", k)
    return m.select("doc_id", has("verdict").alias("verdict"), has("modelVersion").alias("version"), has("reasonCodes").alias("codes"), has("email").alias("email"))


@query(r"""select doc_id, case when length(source) > 300 or length(text) > 5000 then 'The demo accepts a subject of up to 300 and a body of up to 5000 characters.' when not regexp_matches(text, '[^\s\p{Z}]') then 'Provide a subject or a body.' end as body,
  length(text) > 200 as sender, length(text) > 500 as link from documents""")
def b75_demo_bounds(spark: SparkSession, d: str) -> DataFrame:
    t, none = F.col("text"), F.lit(None).cast("string")
    p = read(spark, d, "documents").select("doc_id", intake.demo_problems(none, t, t, none, none, t).alias("p"))
    return p.select("doc_id", F.get(F.try_element_at("p", F.lit("body")), F.lit(0)).alias("body"), F.map_contains_key("p", "sender").alias("sender"), F.map_contains_key("p", "link").alias("link"))


@query(r"""select page_id, 'a b' as subject, 'n' as link_text, url as href, 1 as n_links, case when length(url) > 40 then left(repeat(url, 9), 194) || '…' || right(repeat(url, 9), 60) else 'f' end as name, 1 as n_files, [url] as codes from pages""")
def b76_submission(spark: SparkSession, d: str) -> DataFrame:
    links = F.array(F.struct(F.lit(" n ").alias("text"), F.concat(F.lit("\t"), "url", F.lit(" ")).alias("href")), F.struct(F.lit("x").alias("text"), F.lit("  ").alias("href")))
    name = F.when(F.length("url") > 40, F.repeat("url", 9)).otherwise(F.lit(" f "))
    none = F.lit(None).cast("string")
    files = F.array(F.struct(F.lit("").alias("name"), none.alias("mime_type")), F.struct(name.alias("name"), none.alias("mime_type")))
    request = read(spark, d, "pages").select("page_id", F.lit(" a b ").alias("subject"), none.alias("sender_name"), none.alias("sender_email"), none.alias("reply_to"), links.alias("links"), files.alias("attachments"), F.array(F.lit(" "), F.concat(F.lit(" "), "url")).alias("qr_code_urls"))
    m = intake.submission(request)
    return m.select("page_id", "subject", F.col("links")[0]["text"].alias("link_text"), F.col("links")[0]["href"].alias("href"), F.size("links").alias("n_links"), F.col("attachments")[0]["name"].alias("name"), F.size("attachments").alias("n_files"), F.col("qr_code_urls").alias("codes"))


@query("""select doc_id, case when n_chars % 3 = 0 then [source, 'z'] when lang = source then [lang, 'z'] else [lang, source, 'z'] end as codes from documents""")
def b83_reason_codes(spark: SparkSession, d: str) -> DataFrame:
    f = lambda code, weight: F.struct(code.alias("code"), weight.cast("double").alias("weight"))
    part = lambda *fs: F.struct(F.array(*fs).alias("findings"))
    weight = F.when(F.col("n_chars") % 3 == 0, 0).otherwise(0.2)
    none = F.lit(None).cast("struct<findings:array<struct<code:string,weight:double>>>")
    b = F.struct(part(f(F.col("lang"), weight)).alias("headers"), part(f(F.col("source"), F.lit(0.1)), f(F.col("source"), F.lit(0.5))).alias("links"), none.alias("reputation"), part(f(F.lit("y"), F.lit(0))).alias("attachments"), part(f(F.lit("z"), F.lit(1))).alias("obfuscation"))
    return read(spark, d, "documents").select("doc_id", labels.reason_codes(b).alias("codes"))


@query(r"""with t as (select page_id, unnest(regexp_extract_all(html, '(?is)<(?:a|area)\b[^>]*?\bhref\s*=\s*["''][^"'']+["''][^>]*>|<form\b[^>]*?\baction\s*=\s*["''][^"'']+["''][^>]*>')) as t, generate_subscripts(regexp_extract_all(html, '(?is)<(?:a|area)\b[^>]*?\bhref\s*=\s*["''][^"'']+["''][^>]*>|<form\b[^>]*?\baction\s*=\s*["''][^"'']+["''][^>]*>'), 1) as i from pages),
k as (select page_id, i, lower(regexp_extract(t, '^<([A-Za-z0-9]+)', 1)) as tag, regexp_extract(t, '(?is)\b(?:href|action)\s*=\s*["'']([^"'']+)["'']', 1) as href from t)
select page_id, tag, href, (row_number() over (partition by page_id order by i) - 1)::int as idx from k where href not like '#%'""")
def a18_link_targets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.posexplode(intake.link_targets(F.col("html"))).alias("idx", "x")).select("page_id", "idx", "x.tag", "x.href")


@query("""select page_id, case when length(url) % 2 = 0 then ['https://mail.google.com/' || page_id] else [] end as images, [url] as targets from pages""")
def a21_qr_images(spark: SparkSession, d: str) -> DataFrame:
    image = lambda src, w, h: F.struct(src.alias("src"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    shown = F.concat(F.lit("https://mail.google.com/"), F.col("page_id").cast("string"))
    images = F.array(image(F.col("url"), F.lit(200), F.lit(200)), image(shown, F.when(F.length("url") % 2 == 0, 80).otherwise(79), F.lit(90)), image(F.lit("https://a.b.googleusercontent.com/x"), F.lit(100), F.lit(100)))
    return read(spark, d, "pages").select("page_id", intake.qr_images(images).alias("images"), intake.qr_targets(F.array("url", F.lit("mailto:a@b.c"), "url")).alias("targets"))


@query("""select doc_id, case when lang = 'en' then source when length(text) > 500 then lang else null end as value, case when lang = 'en' then 0 when length(text) > 500 then 1 else -1 end as strategy from documents""")
def a16_located(spark: SparkSession, d: str) -> DataFrame:
    found = intake.located(F.when(F.col("lang") == "en", F.col("source")), F.when(F.length("text") > 500, F.col("lang")))
    return read(spark, d, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.value", "x.strategy")


@query("""select email_id, idx from (select *, row_number() over (order by hidden, r, idx) as seat from (select 1 as email_id, i as idx, i % 3 = 0 as hidden, row_number() over (partition by i % 3 = 0, i % 7 = 0 order by i) as r from range(500) t(i))) where seat <= 300""")
def w2_visible_first(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    href = F.concat(F.when(i % 7 == 0, "https://other.example/").otherwise("https://decoy.example/"), i.cast("string"))
    links = spark.range(500).select(F.lit(1).alias("email_id"), i.alias("idx"), href.alias("href"), (i % 3 == 0).alias("hidden"))
    return intake.select_links(links).select("email_id", "idx")


@query("""select user_id as thread, event_id as begin, newest from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as newest from events where event_id % 3 <> 0) where newest <= 10""")
def w14_open_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every third message of a page holds a copy of itself."""
    e = read(spark, d, "events").select(F.col("user_id").alias("thread"), F.col("event_id").cast("double").alias("begin"))
    inner = e.where("begin % 3 <> 0").withColumn("end", F.col("begin") + 0.5)
    outer = inner.where("begin % 3 = 1").select("thread", (F.col("begin") - 0.1).alias("begin"), (F.col("begin") + 0.6).alias("end"))
    return intake.open_messages(inner.union(outer)).select("thread", F.col("begin").cast("long").alias("begin"), "newest")


@query("""select doc_id from (select doc_id, row_number() over (partition by source order by (lang = 'en') desc, md5('11|' || doc_id), doc_id) as n from documents) where n <= 8""")
def w9_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("modern", F.col("lang") == "en")
    return corpus.balanced_sample(docs, 8, ["source"], "modern", "doc_id").select("doc_id")


@query("""select doc_id from (select doc_id, row_number() over (partition by source order by doc_id) as n from documents where lang <> 'de') where n <= 6 union all select doc_id from documents where lang = 'de'""")
def w13_capped_unless_scarce(spark: SparkSession, d: str) -> DataFrame:
    return corpus.capped_unless(read(spark, d, "documents"), 6, ["source"], F.col("lang") == "de", "doc_id").select("doc_id")


@query(f"""with h as (select distinct {HOST_SQL} as domain, length(url) % 2 = 0 as known from pages) select distinct domain from h where domain not in (select domain from h where known)""")
def j18_unknown_domains(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select(urls.host_of(F.col("url")).alias("domain"), (F.length("url") % 2 == 0).alias("known"))
    return corpus.unknown_domains(p, p.where("known").select("domain").distinct())


@query(f"""with r as (select source, (y = (s > 0.5))::int as hit from ({_SCORED})) select source, count(*) as n, round_even(avg(hit), 4) as accuracy from r group by grouping sets ((), (source))""")
def g18_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select("source", F.when(F.col("y"), "phishing").otherwise("legitimate").alias("class"), F.create_map(F.lit("phishing"), F.col("s"), F.lit("legitimate"), F.lit(0.5)).alias("p"))
    return evaluation.accuracy(rows, "class", "p", "source")


# --- Operations -------------------------------------------------------------------------------------------------------


@query("select event_id, row_number() over (partition by event_type, date_trunc('minute', ts) order by ts, event_id) <= 1 as allowed from events")
def t1_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return operations.rate_limit(read(spark, d, "events"), F.col("event_type"), F.col("ts"), 1).select("event_id", "allowed")


@query("""with o as (select *, row_number() over (partition by event_type, date_trunc('minute', ts) order by ts, event_id) <= 2 as own from events)
select event_id, own and row_number() over (partition by date_trunc('minute', ts), own order by ts, event_id) <= 3 as allowed from o""")
def t2_demo_limit(spark: SparkSession, d: str) -> DataFrame:
    return operations.demo_limit(read(spark, d, "events"), F.col("event_type"), F.col("ts"), 2, 3).select("event_id", "allowed")


@query("""select event_id from events where epoch(timestamp '2024-01-15 12:00:00') < epoch(ts) + case when user_id % 2 = 0 then 86400 else 600 end""")
def t4_t5_fresh_cache(spark: SparkSession, d: str) -> DataFrame:
    cache = read(spark, d, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("checked"), F.col("ts").cast("timestamp").alias("checked_at"))
    return operations.fresh(cache, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("event_id")


@query("select date_trunc('minute', ts) as start, event_type, count(*) as n from events group by 1, 2")
def t6_t8_minute_counts(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of ``stream_counts``."""
    return operations.stream_counts(read(spark, d, "events"), "ts", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select distinct user_id from events")
def t7_first_of_message(spark: SparkSession, d: str) -> DataFrame:
    return operations.first_of_message(read(spark, d, "events").select("user_id"), "user_id")


# --- Learning ---------------------------------------------------------------------------------------------------------


@query()
def m1_m4_linear_model(spark: SparkSession, d: str) -> DataFrame:
    """Language from n-grams, trained on all documents and applied to them."""
    rows = read(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("class"))
    return learning.classify(learning.train(rows, words=1000, chars=500, iterations=5), rows).select("doc_id", "class", "predicted")
