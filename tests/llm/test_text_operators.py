"""Quality rules, chat formatting, PII, mixing and token counts against brute force."""

import collections
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.llm import chat_format, mixing, pii, quality_rules, token_counts

ODD = [None, "", " \n\t ", "a", "a b c a b c", "line\nline\nother\nline", "é ß " * 3, "x# $y %%", "w " * 3000]
SCHEMA = "doc_id long, text string, source string, n_chars long, _row string"


def odd_docs(spark, texts=ODD):
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", 0, "clash") for i, t in enumerate(texts)] + [(None, "no id here", "s1", 0, None), (1, "", "s1", 0, None)]
    return spark.createDataFrame(rows, SCHEMA)


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts_match_brute_force(spark):
    for r in quality_rules.statistics(odd_docs(spark)).collect():
        text = "no id here" if r.doc_id is None else None if r.doc_id >= len(ODD) else ODD[r.doc_id]
        if r.doc_id == 1:
            text = ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text), r.doc_id


def test_quality_keeps_rows_whole_and_handles_empty(spark):
    docs = odd_docs(spark)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_label_model_finds_the_informative_rule():
    model = quality_rules.fit([("++", 900), ("-+", 60), ("--", 30), ("+0", 10)], 2)
    assert model.posterior_of("++") > 0.9 > 0.5 > model.posterior_of("--")
    assert model.posterior_of("-+") < 0.5
    assert quality_rules.fit([], 2).prior == quality_rules.START_PRIOR


CONTROLS = st.lists(st.sampled_from(["</s>", "[INST]", "[/INST] ", "<s> ", "[ROLE x] ", "\\o", "\\", "[", "<", "]", "\n", "é", "a ", "[/ROLE]", ""]), max_size=6).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a] b", None]), st.one_of(st.none(), CONTROLS)), min_size=1, max_size=5), min_size=1, max_size=6))
def test_chat_round_trip(spark, conversations):
    rows = [(c, t, r, x, "clash") for c, turns in enumerate(conversations) for t, (r, x) in enumerate(turns)]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))).collect()}
    for c, turns in enumerate(conversations):
        whole = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
        loss = "".join(x or "" for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_empty_table(spark):
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_has_no_control_string_left_in_texts(spark):
    out = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")).first()
    assert out.formatted.count("[INST]") == 1 and out.formatted.count("[/INST]") == 1 and "</s>" not in out.formatted and out.n_escaped == 1


@pytest.mark.parametrize("n", [2, 3, 7, 100, 1000, 4097])
def test_permutation(n):
    p = pii.Permutation(b"k", n, "t")
    images = [p.apply(i) for i in range(n)]
    assert sorted(images) == list(range(n)) and all(i != x for i, x in enumerate(images))
    assert all(p.apply(x, inverse=True) == i for i, x in enumerate(images))


PERSONAL = [
    "mail Enpa.68@MAIL7.example.com### now", "éñ.5@b.org", "4000-0000-0000-0002 and 9807915762804490", "+1 (017) 555-7713!!", "97.51.17.173,",
    "123-45-6789", "2024-02-29", "3/4/2020", "13.4.2020", "12/25/2001", "DE89 3704 0044 0532 0130 00", "1.1.1999",
]


@pytest.mark.parametrize("text", PERSONAL)
def test_pseudonyms_round_trip_and_keep_their_format(text):
    safe, found = pii.pseudonymise(text)
    assert found and safe != text and pii.reveal(safe) == text
    assert [k for _, _, k in pii.pseudonymise(safe)[1]] == [k for _, _, k in found]
    if all(k != "ipv4" for _, _, k in found):
        assert [c.isdigit() for c in safe] == [c.isdigit() for c in text]
    assert pii.pseudonymise(text)[0] == safe and pii.pseudonymise(text, b"other")[0] != safe


@pytest.mark.parametrize("text", ["9807915762804491", "300.1.1.1", "1999-13-01", "version 3. 4.0.", "000-12-3456", "a@b", "30.2.2020", "token = b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "x1234567812345670"])
def test_what_is_no_personal_data_stays(text):
    assert pii.pseudonymise(text) == (text, [])


def test_linked_across_documents_and_cases():
    a, b = pii.pseudonymise("was.91@mail6.example.com")[0], pii.pseudonymise("x WAS.91@MAIL6.EXAMPLE.COM y")[0]
    assert b == f"x {a.upper()} y"


def test_alphabets_are_classes():
    for c in "aZ5éÉßÿяЯёωΩ日ĸʟªºا٣":
        letters = pii._alphabet(c)
        assert c in letters and len(set(letters)) == len(letters) > 1
        assert all(pii._alphabet(x) == letters for x in letters[:40]), c


ADDRESSES = ["иван@mail.ru", "ИВАНОВ.П@почта.рф", "straße@x.de", "ß@x.de", "ivan+иван@x.de", "a" * 80 + "@b.org", "long" * 900 + "@b.org", "日本@x.jp", "éñ.5@b.org"]


@pytest.mark.parametrize("value", ADDRESSES)
def test_no_part_of_an_address_stays(value):
    text = f"write to {value}, soon"
    safe, found = pii.pseudonymise(text)
    local = value.split("@")[0]
    assert [k for _, _, k in found] == ["email"] and pii.reveal(safe) == text
    new = safe[len("write to ") :].split("@")[0]
    assert len(new) == len(local) and not any(local[i : i + 6] == new[i : i + 6] for i in range(max(1, len(local) - 6)))


@pytest.mark.parametrize("forms,canonical", [
    (["2024-02-29", "29.02.2024", "29/02/2024", "2/29/2024", "02/29/2024"], lambda s: tuple(sorted(map(int, re.findall(r"\d+", s))))),
    (["3/4/2020", "03/04/2020", "3.4.2020", "2020-04-03"], lambda s: tuple(sorted(map(int, re.findall(r"\d+", s))))),
    (["+962791234567", "+962 79 123 4567", "+962-79-1234567"], lambda s: re.sub(r"\D", "", s)),
    (["(415) 555-2671", "415 555 2671", "415-555-2671", "1-415-555-2671", "+1 (415) 555-2671"], lambda s: re.sub(r"\D", "", s)[-10:]),
    (["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"], lambda s: s.replace(" ", "")),
    (["4000-0000-0000-0002", "4000 0000 0000 0002", "4000000000000002"], lambda s: re.sub(r"\D", "", s)),
])
def test_one_value_in_all_its_forms(forms, canonical):
    safe = [pii.pseudonymise(f)[0] for f in forms]
    assert len({canonical(s) for s in safe}) == 1 and canonical(safe[0]) != canonical(forms[0])
    assert [pii.reveal(s) for s in safe] == forms
    assert [re.sub(r"\d|[A-Z](?=[\dA-Z])", "9", s) for s in safe] == [re.sub(r"\d|[A-Z](?=[\dA-Z])", "9", f) for f in forms]


def test_values_beside_others():
    for text, kinds in [("ES9121000418450200051332 EUR 12", ["iban"]), ("at 2001:db8::1 and 12:30:45 std::x", ["ipv6"]), ("2001:0db8:0000:0000:0000:ff00:0042:8329", ["ipv6"]), ("a@b.cc 1.1.1999@x", ["email", "date"])]:
        safe, found = pii.pseudonymise(text)
        assert [k for _, _, k in found] == kinds and pii.reveal(safe) == text and safe != text


FILLER = st.lists(st.sampled_from(["lorem", "ipsum;", "\n", "12", "x7", "(see", "end.", "", "—", "№ 5"]), max_size=5).map(" ".join)
PLANTED = st.sampled_from(["anna.b@mail.example.com", "иван@mail.ru", "4000-0000-0000-0002", "123-45-6789", "97.51.17.173", "+962 79 123 4567", "(017) 555-7713", "2001-03-04", "DE89 3704 0044 0532 0130 00"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(FILLER, PLANTED), min_size=1, max_size=4))
def test_planted_values_are_found_whatever_stands_around(parts):
    text = "".join(f"{f} {v} " for f, v in parts)
    safe, found = pii.pseudonymise(text)
    assert len(found) == len(parts) and pii.reveal(safe) == text
    assert [text[s:e] for s, e, _ in found] == [v.split("@")[0] if "@" in v else v for _, v in parts]
    assert not any(v in safe for _, v in parts)


def test_protect_table(spark):
    out = {r.doc_id: r for r in pii.protect(odd_docs(spark, [None, "", "ip 97.51.17.173"]).dropDuplicates(["doc_id"])).collect()}
    clash = pii.protect(spark.createDataFrame([("a@b.org", "old", 1)], "text string, pii string, start int")).first()
    assert clash["text"] != "a@b.org" and clash["pii"][0]["kind"] == "email" and clash["start"] == 1
    assert out[0].text is None and out[2].text != "ip 97.51.17.173" and out[2]["_row"] == "clash"
    assert pii.protect(odd_docs(spark).limit(0)).count() == 0


def poisson_count(u, mean):
    import math

    p = c = math.exp(-mean)
    k = 0
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixing_counts(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7), "big" if i % 3 else None, 9) for i in range(600)], "doc_id long, text string, source string, copy long")
    out = mixing.mix(docs, {"big": 1.0, None: 3.0}, budget=6000)
    got = collections.Counter(r.doc_id for r in out.collect())
    size = collections.Counter()
    for i in range(600):
        size["big" if i % 3 else None] += i % 7 + 1
    for i in range(600):
        source = "big" if i % 3 else None
        u = int(hashlib.md5(f"42:0:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert got[i] == poisson_count(u, 6000 * (0.25 if source else 0.75) / size[source]), i
    keys = [r.shuffle_key for r in out.collect()]
    assert len(set(keys)) == len(keys) and keys != sorted(keys, key=lambda k: k % 1000)


def test_mixing_clashing_columns_and_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (i % 5), f"s{i % 3}", 1, 2, 3, 4) for i in range(200)], "doc_id long, text string, source string, _source int, _rate int, _n int, row int")
    few = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == few
    assert all(r[3:7] == (1, 2, 3, 4) for r in few) and mixing.mix(docs).columns == [*docs.columns, "copy", "repetition", "shuffle_key"]


def test_mixing_large_means_and_edges(spark):
    one = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert 1700 < mixing.mix(one, budget=4000.0).count() < 2300
    assert mixing.mix(one.limit(0)).count() == 0
    assert mixing.mix(one, {"other": 1.0}).count() == 0
    assert mixing.mix(odd_docs(spark)).columns[-3:] == ["copy", "repetition", "shuffle_key"]


def test_token_counts_by_brute_force(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [None, "", "a\n\nb  \n c", "é\nßé end", "x" * 5000 + "\ny", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = collections.defaultdict(list)
    for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).orderBy("doc_id", "section").collect():
        rows[r.doc_id].append(r)
    for i, text in enumerate(texts):
        text = text or ""
        begins = [0]
        for line in text.split("\n")[:-1]:
            begins.append(begins[-1] + len(line) + 1)
        tokens = [o[0] for o in whole.encode(text, add_special_tokens=False).offsets]
        expected = [sum(b <= t < e for t in tokens) for b, e in zip(begins, [*begins[1:], len(text) + 1])]
        assert [r.n_tokens for r in rows[i]] == expected and [r.start for r in rows[i]] == begins
        assert all(r.doc_tokens == len(tokens) for r in rows[i])
    two = token_counts.count_tokens(spark.createDataFrame([(1, "ab", "cd")], "doc_id long, a string, b string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["a", "b"], by_line=False)
    assert {r.field: r.start for r in two.collect()} == {"a": 0, "b": 3}
    assert token_counts.count_tokens(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
