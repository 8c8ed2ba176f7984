"""Personal data replaced by format-preserving Feistel pseudonyms.

E-mail addresses, payment card numbers (Luhn), IBANs (mod 97), telephone numbers, US social security numbers, IPv4 and
IPv6 addresses and calendar dates are found, validated, and mapped within their own format by a keyed permutation. Equal
values get equal pseudonyms in all documents, different values of one format different ones, and no value stays as it
is. With the key ``reveal`` undoes it.

The permutation P over [0, n) is a ten-round Feistel network on the next even number of bits, with cycle walking. What
is applied is ``P^-1((P(x) + step) mod n)`` with 0 < step < n: a permutation too, but without fixed points.

What is permuted is the value, not its spelling, and the result is written in the form in which the value stood: a date is
the same day in ISO, dotted, slashed, padded or month-first form, a telephone number its country code and digits whatever
stands between them, an address the same in either case. So that a form can be read again, a day keeps the number of digits
of its day and month and whether its day is above 12, and an IPv6 address is permuted digit by digit (its spellings with and
without leading zeros are different values). The letters of an address, of any script, stay within their kind: letters of
the same case, script block and category. Long ones are permuted in stretches of ``STRETCH`` characters, all of them.

Defined results: a null text stays null, an empty one empty. Numbers that fail their check (Luhn, mod 97, octets over
255, days that do not exist) are left alone, and so are digits inside longer runs of letters or digits and ten digits without
any mark, which may be anything. Very long texts are read whole; a pseudonym needs its match alone. Repeated rows give repeated
results; an empty table an empty one. All other columns are passed on, but for ``pii``, which is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The key of tests and of the queries; whoever publishes data passes a secret one.
DEMO_KEY = b"sievelight demonstration key"
ROUNDS = 10
KINDS = ("email", "card", "iban", "phone", "ssn", "ipv4", "ipv6", "date")
STRETCH = 256

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Country calling codes of one and two digits; all others have three.
_CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98"
).split()

_NUMBER = re.compile(
    r"""(?<![\w@/])(?<!\d[.\-])(?:
      (?P<date>\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?![\w/]|[.\-]\d)
    | (?P<ipv4>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w|\.\d)
    | (?P<ipv6>(?<!:)(?:[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{1,4}:){0,5}:))(?![\w:]|\.\d)
    | (?P<ssn>\d{3}-\d\d-\d{4})(?!\w|-\d)
    | (?P<phone>(?:\+\d{1,3}[ .\-]?|1[ .\-])?(?:\(\d{3}\)[ .\-]?|\d{3}[.\-]|[2-9]\d\d[ ](?=\d{3}[ ]))\d{3}[ .\-]\d{4}|\+\d{1,3}(?:[ .\-]?\d){7,12})(?!\w|-\d)
    | (?P<card>\d{13,19}|\d{4}(?P<sep>[ \-])\d{4}(?P=sep)\d{4}(?P=sep)\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\w|-\d)
    | (?P<iban>[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)
    )""",
    re.X | re.A,
)
_DIGIT = re.compile(r"[0-9]|:")
_BEFORE_AT = re.compile(r"[\w.%+\-]*")
_AFTER_AT = re.compile(r"(?:[\w\-]+\.)+[^\W\d_]{2,}")


class Permutation:
    """A keyed permutation of [0, n) without fixed points (n >= 2), and its inverse."""

    def __init__(self, key: bytes, n: int, tweak: str):
        self.n, self.key = n, hashlib.blake2b(tweak.encode(), key=key[:64], digest_size=32).digest()
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.step = 1 + int.from_bytes(hashlib.blake2b(b"step", key=self.key, digest_size=16).digest(), "big") % (n - 1) if n > 1 else 0

    def _f(self, i: int, x: int) -> int:
        size = (self.half + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(x.to_bytes(size, "big") + bytes((i, block & 255, block >> 8)), key=self.key).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & self.mask

    def _forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(ROUNDS):
                a, b = b, a ^ self._f(i, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def _backward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(ROUNDS)):
                a, b = b ^ self._f(i, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def apply(self, x: int, inverse: bool = False) -> int:
        return self._backward((self._forward(x) + (-self.step if inverse else self.step)) % self.n)


@lru_cache(maxsize=4096)
def _permutation(key: bytes, n: int, tweak: str) -> Permutation:
    return Permutation(key, n, tweak)


def _partner(x: str) -> str | None:
    """The same letter in the other case, if there is one and it leads back."""
    other = x.upper() if x.islower() else x.lower()
    return other if len(other) == 1 and other != x and (other.lower() if x.islower() else other.upper()) == x else None


@lru_cache(maxsize=10_000)
def _kin(begin: int, size: int, category: str, paired: bool) -> str:
    """The letters and digits beyond ASCII of one category in a block. Those that are alone of their kind in a block of 64 meet
    in one of 1024, and those alone there in all of Unicode, so that each belongs to one alphabet."""
    if size == 64:
        block = map(chr, range(max(128, begin), begin + 64))
        return "".join(x for x in block if (x.isalnum() or unicodedata.combining(x)) and unicodedata.category(x) == category and (_partner(x) is not None) == paired)
    smaller = 64 if size == 1024 else 1024
    alone = (_kin(at, smaller, category, paired) for at in range(begin, begin + size, smaller))
    return "".join(x for x in alone if len(x) == 1)


@lru_cache(maxsize=100_000)
def _alphabet(c: str) -> str | None:
    """The characters among which ``c`` is permuted: ASCII letters of a case, ASCII digits, or its kin of one category. A letter
    with a partner in the other case is among such, and its partner is among their partners."""
    for letters in (_LOWER, _UPPER, _DIGITS):
        if c in letters:
            return letters
    if not (c.isalnum() or unicodedata.combining(c)):
        return None
    upper = _partner(c) is not None and not c.islower()
    base = c.lower() if upper else c
    for size in (64, 1024, 0x110000):
        found = _kin(ord(base) // size * size, size, unicodedata.category(base), _partner(base) is not None)
        if len(found) > 1:
            return "".join(map(_partner, found)) if upper else found
    return None


def _spell(key: bytes, text: str, tweak: str, inverse: bool, letters_as_lower: bool = False) -> str:
    """Permutes the letters and digits of ``text``, each within its alphabet; everything else keeps its place. With
    ``letters_as_lower`` the case is a matter of form and not of value."""
    if len(text) > STRETCH:
        return "".join(_spell(key, text[i : i + STRETCH], f"{tweak}|{i}", inverse, letters_as_lower) for i in range(0, len(text), STRETCH))
    shape = [_alphabet(c) for c in text]
    classes = [_alphabet(c.lower()) if a and letters_as_lower and len(c.lower()) == 1 else a for c, a in zip(text, shape)]
    value, n = 0, 1
    for c, a in zip(text, classes):
        if a:
            value = value * len(a) + a.index(c if c in a else c.lower())
            n *= len(a)
    if n < 2:
        return text
    # The tweak carries the form, so that each form is permuted on its own.
    value = _permutation(key, n, f"{tweak}|{''.join(a[0] if a else '.' for a in classes)}").apply(value, inverse)
    out = []
    for c, a, original in zip(reversed(text), reversed(classes), reversed(shape)):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
            if original != a:
                c = c.upper()
        out.append(c)
    return "".join(reversed(out))


def _put(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in form)


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` followed by it pass the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(key: bytes, s: str, inverse: bool) -> str | None:
    d = "".join(c for c in s if c in _DIGITS)
    if luhn_digit(d[:-1]) != d[-1] or not d.strip("0"):
        return None
    body = _spell(key, d[:-1], "card", inverse)
    return _put(s, body + luhn_digit(body))


def _iban_end(s: str) -> int:
    """The length of the longest beginning of ``s`` that is a valid IBAN and ends with a group; 0 if there is none."""
    for end in [len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] == " ")]:
        plain = s[:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return 0


def _iban(key: bytes, s: str, inverse: bool) -> str | None:
    plain = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    body = _spell(key, plain[4:], f"iban {plain[:2]}", inverse)
    new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _phone(key: bytes, s: str, inverse: bool) -> str | None:
    """The country's code stays as it is written. Ten digits without one are of country 1."""
    digits = "".join(c for c in s if c in _DIGITS)
    if s[0] == "+":
        code = next((c for c in _CALLING_CODES if digits.startswith(c)), digits[:3])
    else:
        code = "1" if len(digits) == 11 else ""
    rest = digits[len(code) :]
    return _put(s, code + _spell(key, rest, f"phone {code or 1}", inverse))


def _ipv6(key: bytes, s: str, inverse: bool) -> str | None:
    """Digit by digit, as it is spelt; the result is as valid as the value."""
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return None
    digits = [c for c in s if c != ":"]
    if len(digits) < 3:
        return None
    value = int("".join(digits), 16)
    new = f"{_permutation(key, 16 ** len(digits), 'ipv6 ' + ''.join(c if c == ':' else 'x' for c in s)).apply(value, inverse):0{len(digits)}x}"
    it = iter(new)
    upper = any(c in "ABCDEF" for c in s)
    return "".join(c if c == ":" else next(it) for c in s).upper() if upper else "".join(c if c == ":" else next(it) for c in s)


def _ssn(key: bytes, s: str, inverse: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(_permutation(key, 898 * 99 * 9999, "ssn").apply(rank, inverse), 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ipv4(key: bytes, s: str, inverse: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = _permutation(key, 1 << 32, "ipv4").apply(int.from_bytes(bytes(map(int, parts)), "big"), inverse)
    return ".".join(map(str, value.to_bytes(4, "big")))


_FIRST_YEAR, _LAST_YEAR = 1900, 2099


def _kind_of_day(d: datetime.date) -> tuple[bool, int, int]:
    """What a pseudonym keeps of a day, so that it reads the same way in every form: whether the day of the month is above
    12 (told from a month), and the widths of day and month where leading zeros are left out."""
    return d.day > 12, len(str(d.day)), len(str(d.month))


@lru_cache(maxsize=1)
def _days() -> dict[tuple[bool, int, int], tuple[list[datetime.date], dict[datetime.date, int]]]:
    """The days of each kind, and their places."""
    kinds: dict = {}
    for n in range(datetime.date(_FIRST_YEAR, 1, 1).toordinal(), datetime.date(_LAST_YEAR, 12, 31).toordinal() + 1):
        d = datetime.date.fromordinal(n)
        days, places = kinds.setdefault(_kind_of_day(d), ([], {}))
        places[d] = len(days)
        days.append(d)
    return kinds


def _date(key: bytes, s: str, inverse: bool) -> str | None:
    mark = "-" if "-" in s else "/" if "/" in s else "."
    fields = s.split(mark)
    a, b, c = map(int, fields)
    month_first = mark != "-" and b > 12
    try:
        day = datetime.date(a, b, c) if mark == "-" else datetime.date(c, a, b) if month_first else datetime.date(c, b, a)
    except ValueError:
        return None
    if not _FIRST_YEAR <= day.year <= _LAST_YEAR:
        return None
    days, places = _days()[_kind_of_day(day)]
    new = days[_permutation(key, len(days), f"date {_kind_of_day(day)}").apply(places[day], inverse)]
    if mark == "-":
        return new.isoformat()
    x, y = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{x:0{len(fields[0])}d}{mark}{y:0{len(fields[1])}d}{mark}{new.year}"


def _email(key: bytes, local: str, domain: str, inverse: bool) -> str:
    return _spell(key, local, f"email {domain.lower()}", inverse, letters_as_lower=True)


_NUMBERS = {"card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "ipv4": _ipv4, "ipv6": _ipv6, "date": _date}


def pseudonymise(text: str, key: bytes = DEMO_KEY, inverse: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its personal data replaced, and (start, end, kind) of each item in the original."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        after = _AFTER_AT.match(text, at + 1)
        if after:
            # Back to the last sign that no address holds: a text is read over once, since "@" is one of these.
            start = at - _BEFORE_AT.match(text[done:at][::-1]).end()
            start += len(text[start:at]) - len(text[start:at].lstrip(".%+-"))
            new = _email(key, text[start:at], after.group(), inverse) if start < at else ""
            if new != text[start:at]:
                found.append((start, at, "email", new))
                done = after.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        mails = [(f[0], f[1]) for f in found]
        begins = [f[0] for f in mails]
        pos = 0
        while m := _NUMBER.search(text, pos):
            kind = m.lastgroup if m.lastgroup != "sep" else "card"
            end = m.start() + _iban_end(m.group()) if kind == "iban" else m.end()
            pos = m.end() if end == m.start() else end
            i = bisect_right(begins, m.start())
            if end == m.start() or (i and mails[i - 1][1] > m.start()) or (i < len(mails) and begins[i] < end):
                continue
            new = _NUMBERS[kind](key, text[m.start() : end], inverse)
            if new is not None:
                found.append((m.start(), end, kind, new))
        found.sort()
    if not found:
        return text, []
    out, last = [], 0
    for start, end, _, new in found:
        out += [text[last:start], new]
        last = end
    return "".join(out) + text[last:], [(s, e, k) for s, e, k, _ in found]


def reveal(text: str, key: bytes = DEMO_KEY) -> str:
    """The text from which ``pseudonymise`` made ``text``."""
    return pseudonymise(text, key, inverse=True)[0]


def protect(docs: DataFrame, text: str = "text", key: bytes = DEMO_KEY) -> DataFrame:
    """``docs`` with ``text`` pseudonymised; adds ``pii``: array<struct<start,end,kind>> in the original text. A column
    of that name is replaced."""

    @F.pandas_udf("text string, pii array<struct<start int, end int, kind string>>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [(None, None) if t is None else pseudonymise(t, key) for t in part]
            yield pd.DataFrame({"text": [t for t, _ in done], "pii": [None if p is None else [{"start": s, "end": e, "kind": k} for s, e, k in p] for _, p in done]})

    return docs.withColumn("pii", each(F.col(text))).withColumn(text, F.col("pii.text")).withColumn("pii", F.col("pii.pii"))
