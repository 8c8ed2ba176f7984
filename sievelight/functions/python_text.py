"""The few text functions that the JVM lacks, as Arrow-batched Python."""

import html
import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INVISIBLE = re.compile("[­͏؜​-‏‪-‮⁠-⁤⁦-⁩﻿]")
_INVALID = re.compile("[\ud800-\udfff￾￿]")


def fold_text(text: str) -> str:
    """Invisible characters and invalid code points out, then NFKC."""
    return unicodedata.normalize("NFKC", _INVALID.sub("", _INVISIBLE.sub("", text)))


def normalisation_available() -> bool:
    return fold_text("ﬁ") == "fi"


def _mapped(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A column function of a text function; null stays null. Made when called: workers import this module too."""

    def column(text: Column | str) -> Column:
        def each(part: pd.Series) -> pd.Series:
            return part.map(f, na_action="ignore")

        return F.pandas_udf(each, kind)(text)

    return column


def decode_entities_and_fold(text: Column, entities: bool = True) -> Column:
    """One Python step for both."""
    return _mapped((lambda t: fold_text(html.unescape(t))) if entities else fold_text, "string")(text)


def host_to_unicode(host: str) -> str:
    """Punycode labels decoded; the host itself where that fails."""
    try:
        return ".".join(p[4:].encode("ascii").decode("punycode") if p.startswith("xn--") else p for p in host.split("."))
    except (UnicodeError, ValueError):
        return host


to_unicode = _mapped(host_to_unicode, "string")


def chunk_text(text: str, soft: int = 350, hard: int = 600) -> list[str]:
    """Sentences put together while they have ``soft`` characters at most; what is longer by itself keeps ``hard`` of them."""
    out, now = [], ""
    for sentence in re.split(r"(?<=[.!?\n])\s+", text):
        if now and len(now) + len(sentence) > soft:
            out.append(now)
            now = ""
        now = f"{now} {sentence}" if now else sentence
    return [c[:hard] for c in (*out, now) if c.strip()]


chunks = _mapped(chunk_text, "array<string>")


def _is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)))


def _is_punctuation(c: str) -> bool:
    return (33 <= ord(c) <= 126 and not c.isalnum()) or unicodedata.category(c).startswith("P")


def wordpiece(text: str, vocab: dict[str, int], max_length: int, lower: bool = False) -> list[int]:
    """Greedy longest-match word pieces between [CLS] and [SEP]; words over 100 characters are unknown."""
    spaced = []
    for c in text:
        category = unicodedata.category(c)
        if c in "\t\n\r" or category == "Zs":
            spaced.append(" ")
        elif category in ("Cc", "Cf") or ord(c) in (0, 0xFFFD):
            continue
        else:
            spaced.append(f" {c} " if _is_cjk(c) or _is_punctuation(c) else c)
    ids = []
    for word in "".join(spaced).split():
        word = word.lower() if lower else word
        pieces, at = [], 0
        while at < len(word) and len(word) <= 100:
            for end in range(len(word), at, -1):
                piece = word[at:end] if at == 0 else "##" + word[at:end]
                if piece in vocab:
                    pieces.append(vocab[piece])
                    at = end
                    break
            else:
                break
        ids += pieces if at == len(word) else [vocab["[UNK]"]]
    return [vocab["[CLS]"], *ids[: max_length - 2], vocab["[SEP]"]]


def wordpiece_column(vocab: Sequence[str], max_length: int = 256, lower: bool = False):
    """A column function that encodes text with a vocabulary whose place in the list is the id."""
    table = {t: i for i, t in enumerate(vocab)}
    return _mapped(lambda t: wordpiece(t, table, max_length, lower), "array<int>")
