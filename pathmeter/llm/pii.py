"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation (operator 1)."""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Iterator
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DAY0 = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - DAY0

#: What each kind looks like. A candidate counts only if its check holds.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<![0-9A-Za-z])(?:"
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)"
    r"|(?P<date>(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})"
    r"|(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?!\.[0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})"
    r"|(?P<card>[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}|3[0-9]{3}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})"
    r")(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<phone>(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,5}"
    r"|\+[0-9]{8,15})(?![0-9A-Za-z])",
    re.ASCII,
)
KINDS = ("email", "iban", "date", "ip", "ssn", "card", "phone")
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_HINT = re.compile(r"[0-9@]")


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0..size-1: unbalanced Feistel rounds on a x b >= size, walked until inside."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + _round(right, i, key, tweak)) % a
            else:
                right = (right + _round(left, i, key, tweak)) % b
        value = left * b + right
        if value < size:
            return value


def restore(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """The inverse of ``permute``."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = (left - _round(right, i, key, tweak)) % a
            else:
                right = (right - _round(left, i, key, tweak)) % b
        value = left * b + right
        if value < size:
            return value


def _round(half: int, i: int, key: bytes, tweak: bytes) -> int:
    data = tweak + b"|%d|%d" % (i, half)
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big")


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` + digit valid."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


_ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def _shuffle_chars(value: str, key: bytes, tweak: bytes) -> str:
    """Permute digits among digits and letters among letters of a case; other characters stay."""
    places = [(i, a) for i, c in enumerate(value) for a in _ALPHABETS if c in a]
    number, size = 0, 1
    for i, a in places:
        number = number * len(a) + a.index(value[i])
        size *= len(a)
    number = permute(number, size, key, tweak)
    out = list(value)
    for i, a in reversed(places):
        number, r = divmod(number, len(a))
        out[i] = a[r]
    return "".join(out)


def _with_digits(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value of a kind, in the same format; None if the value is not valid."""
    tweak = kind.encode()
    if kind == "email":
        local, _, domain = value.partition("@")
        # The domain is part of the tweak, so a person keeps one pseudonym for one address.
        return f"{_shuffle_chars(local, key, tweak + domain.lower().encode())}@{domain}"
    if kind == "iban":
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        account = _shuffle_chars(plain[4:], key, tweak + plain[:2].encode())
        made = iter(plain[:2] + iban_check(plain[:2], account) + account)
        return "".join(" " if c == " " else next(made) for c in value)
    if kind == "date":
        return _date(value, key, tweak)
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255:
            return None
        number = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, tweak)
        return ".".join(str(b) for b in number.to_bytes(4, "big"))
    digits = _digits(value)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, tweak)).zfill(len(digits) - 1)
        return _with_digits(value, body + luhn_digit(body))
    if kind == "ssn":
        area, group, serial = digits[:3], digits[3:5], digits[5:]
        if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
            return None
        # Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999.
        number = ((int(area) - 1 - (int(area) > 666)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
        number, serial_ = divmod(permute(number, 898 * 99 * 9999, key, tweak), 9999)
        area_, group_ = divmod(number, 99)
        return f"{area_ + 1 + (area_ >= 665):03d}-{group_ + 1:02d}-{serial_ + 1:04d}"
    if not 8 <= len(digits) <= 15:
        return None
    country = re.match(r"\+[0-9]{1,3}(?=[\x20.(-])", value)
    keep = len(country.group()) - 1 if country else 0
    size = len(digits) - keep
    body = str(permute(int(digits[keep:]), 10**size, key, tweak + digits[:keep].encode())).zfill(size)
    return _with_digits(value, digits[:keep] + body)


def _date(value: str, key: bytes, tweak: bytes) -> str | None:
    iso = "-" in value
    parts = [int(p) for p in re.split(r"[-./]", value)]
    year, month, day = parts if iso else (parts[2], parts[1], parts[0])
    try:
        number = datetime.date(year, month, day).toordinal() - DAY0
    except ValueError:
        return None
    made = datetime.date.fromordinal(DAY0 + permute(number, DAYS, key, tweak))
    if iso:
        return made.isoformat()
    marks = re.findall(r"[./]", value)
    return f"{made.day:02d}{marks[0]}{made.month:02d}{marks[1]}{made.year}"


def _iban(value: str, key: bytes) -> tuple[str | None, int]:
    """The pseudonym of an IBAN with which ``value`` begins, and where that ends.

    Words behind it may look like its groups, so every beginning that ends
    before a space is tried: first that of the country's length, then the longest.
    """
    ends = [i for i, c in enumerate(value) if c == " "] + [len(value)]
    length = IBAN_LENGTHS.get(value[:2])
    for end in sorted(ends, key=lambda i: (len(value[:i].replace(" ", "")) != length, -i)):
        made = pseudonym("iban", value[:end], key)
        if made is not None:
            return made, end
    return None, len(value)


def _pseudonym_at(m: re.Match, key: bytes) -> tuple[str | None, int]:
    """The pseudonym of a match, None if it is not valid, and the end of its value in the text."""
    kind = m.lastgroup
    if kind == "iban":
        made, end = _iban(m.group(kind), key)
        return made, m.start(kind) + end
    return pseudonym(kind, m.group(kind), key), m.end(kind)


def _checked_inside(text: str, phone: re.Match, key: bytes) -> bool:
    """Whether a valid card or IBAN starts inside what looks like a phone number."""
    pos = phone.start() + 1
    while (m := PATTERN.search(text, pos)) is not None and m.start() < phone.end():
        if m.lastgroup in ("card", "iban") and _pseudonym_at(m, key)[0] is not None:
            return True
        pos = m.start() + 1
    return False


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced in the old text."""
    if not _HINT.search(text):
        return text, []
    out, spans, at, pos, barred = [], [], 0, 0, 0
    while (m := PATTERN.search(text, pos)) is not None:
        kind = m.lastgroup
        made, end = _pseudonym_at(m, key)
        if kind == "phone" and made is not None and (m.start() < barred or _checked_inside(text, m, key)):
            made = None
        if made is None:
            # Not valid as this kind: another may start inside it, but part of a long number is no phone.
            barred = max(barred, m.end()) if kind == "card" else barred
            pos = m.start() + 1
            continue
        out += [text[at : m.start(kind)], made]
        spans.append((kind, m.start(kind), end))
        at = pos = end
    out.append(text[at:])
    return "".join(out), spans


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal data in ``text``; adds ``pii_spans`` array<struct<kind, start, end>> of the old text.

    E-mail addresses (local part), phone numbers, payment cards (Luhn), IBANs
    (mod 97), social security numbers, IPv4 addresses and dates from 1900 to
    2099 are permuted within their format under ``key``, so equal values stay
    equal over all rows and different ones of a format stay different. Values
    that fail their check stay. A null text stays null without spans, an empty
    one empty; other columns, repeated and null keys included, are kept. A
    column called ``pii_spans`` is replaced.
    """
    secret = hashlib.sha256(key.encode()).digest()

    @F.pandas_udf("struct<text:string,spans:array<struct<kind:string,start:int,end:int>>>")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, spans = [], []
            for t in part:
                new, found = (None, []) if t is None else replace(t, secret)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "spans": pd.Series(spans, dtype=object)})

    columns = [c for c in docs.columns if c != "pii_spans"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), made(F.col(text)).alias("made"))
    order = [(F.col("made.text") if c == text else F.col("row")[c]).alias(c) for c in columns]
    return packed.select(*order, F.col("made.spans").alias("pii_spans"))
