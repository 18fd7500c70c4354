"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

A found value is checked (Luhn digit, IBAN remainder, calendar, octets), read as a number whose digits
have the radixes that its format allows, permuted by a Feistel network under a secret key, and written
back in the same format and length. Equal values get equal pseudonyms in every document, different
values different ones, and the holder of the key can go back (``restore``). Letters and digits of any script change
within their script and case; the kinds with a check are found in ASCII digits. Candidates that fail their check
are tried in shorter forms and as other kinds; what passes none stays as it is. Only where a pseudonym
would let such a failed candidate pass, the value gets the next one of the permutation's cycle, so that
it is found again on the way back; it is then not linked to its other places.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

ROUNDS = 10
KINDS = ("email", "iban", "ip", "date", "card", "ssn", "phone")
# Days are permuted within their span, so that those of usual years stay in usual years.
SPANS = ((date(1900, 1, 1), date(2099, 12, 31)), (date.min, date(1899, 12, 31)), (date(2100, 1, 1), date.max))

_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
# More telling formats first: of two candidates that start together the first kind wins.
_FORMATS = {
    "email": r"(?<![\w.+-])[\w.+-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9][0-9](?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])",
    "date": rf"{_EDGE}(?:[0-9]{{4}}(?P<ymd>[-/.])[0-9]{{1,2}}(?P=ymd)[0-9]{{1,2}}|[0-9]{{1,2}}(?P<dmy>[-/.])[0-9]{{1,2}}(?P=dmy)[0-9]{{4}}){_END}",
    "card": rf"{_EDGE}[0-9](?:[ -]?[0-9]){{12,18}}{_END}",
    "ssn": rf"{_EDGE}[0-9]{{3}}-[0-9][0-9]-[0-9]{{4}}{_END}",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+?\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}{_END}"
    rf"|(?<![0-9A-Za-z+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,4}}{_END}"
    rf"|{_EDGE}\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}{_END}",
}
PATTERN = re.compile("|".join(f"(?P<{kind}>{format_})" for kind, format_ in _FORMATS.items()))
_PATTERNS = {kind: re.compile(format_) for kind, format_ in _FORMATS.items()}
_GROUP = re.compile(r"[^0-9A-Za-z]*[0-9A-Za-z]+")
# No format but that of e-mail addresses, which have no check, is longer.
_LONGEST = 64
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_MAYBE = re.compile(r"[\d@]")

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")
_PLACE = {c: (letters, i) for letters in _ALPHABETS for i, c in enumerate(letters)}
# Characters of one kind in the same row of code points are an alphabet too: a letter keeps its script and case.
ROW = 128
_KINDS_OF_SIGNS = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"))


def feistel(key: bytes, tweak: str, digits: list[int], radixes: list[int], back: bool = False) -> list[int]:
    """A permutation of all numbers with these radixes; ``back`` undoes it."""
    half = len(digits) // 2
    sizes = [prod(radixes[:half]), prod(radixes[half:])]
    parts = [_number(digits[:half], radixes[:half]), _number(digits[half:], radixes[half:])]
    label = f"{tweak}:{radixes}".encode()
    for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
        side = n % 2
        message = b"%b:%d:%d" % (label, n, parts[1 - side])
        step = int.from_bytes(hmac.new(key, message, hashlib.sha256).digest())
        parts[side] = (parts[side] + (-step if back else step)) % sizes[side]
    return _digits(parts[0], radixes[:half]) + _digits(parts[1], radixes[half:])


def _number(digits: list[int], radixes: list[int]) -> int:
    value = 0
    for d, r in zip(digits, radixes):
        value = value * r + d
    return value


def _digits(value: int, radixes: list[int]) -> list[int]:
    out = []
    for r in reversed(radixes):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


@lru_cache(maxsize=4096)
def _row(row: int, kind: str) -> str:
    known = (chr(c) for c in range(row * ROW, (row + 1) * ROW))
    return "".join(c for c in known if c not in _PLACE and unicodedata.category(c) == kind)


def _place(c: str) -> tuple[str, int] | None:
    """The alphabet of a character and its place there; None for what stays as it is."""
    if c in _PLACE:
        return _PLACE[c]
    kind = unicodedata.category(c)
    if c.isascii() or kind not in _KINDS_OF_SIGNS:
        return None
    letters = _row(ord(c) // ROW, kind)
    return letters, letters.index(c)


def _signs(key: bytes, kind: str, text: str, back: bool) -> str:
    """Every letter and digit changes within its alphabet; other signs stay."""
    places = [(i, *place) for i, c in enumerate(text) if (place := _place(c))]
    new = feistel(key, kind, [n for _, _, n in places], [len(letters) for _, letters, _ in places], back)
    out = list(text)
    for (i, letters, _), d in zip(places, new):
        out[i] = letters[d]
    return "".join(out)


def _luhn_digit(digits: str) -> str:
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _like(text: str, digits: str) -> str:
    """``digits`` written into the places of the letters and digits of ``text``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isalnum() else c for c in text)


def _card(key: bytes, text: str, back: bool) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if _luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = _signs(key, "card", digits[:-1], back)
    return _like(text, body + _luhn_digit(body))


def _iban(key: bytes, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")

    def remainder(country: str, check: str, body: str) -> int:
        return int("".join(str(int(c, 36)) for c in body + country + check)) % 97

    country, body = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or remainder(country, plain[2:4], body) != 1:
        return None
    body = _signs(key, f"iban{country}", body, back)
    return _like(text, f"{country}{98 - remainder(country, '00', body):02d}{body}")


def _ip(key: bytes, text: str, back: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    lows, sizes = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    new = feistel(key, "ip", [int(o) - lows[len(o)] for o in octets], [sizes[len(o)] for o in octets], back)
    return ".".join(str(d + lows[len(o)]) for d, o in zip(new, octets))


def _read_date(text: str) -> tuple[str, date] | None:
    """The order of a written date's parts and its day; day before month where both fit."""
    parts = re.split("[-/.]", text)
    for order in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        year, month, day = (int(parts[order.index(c)]) for c in "ymd")
        try:
            return order, date(year, month, day)
        except ValueError:
            continue
    return None


def _date(key: bytes, text: str, back: bool) -> str | None:
    found = _read_date(text)
    if found is None:
        return None
    order, widths = found[0], [len(p) for p in re.split("[-/.]", text)]
    place, (first, last) = next((i, span) for i, span in enumerate(SPANS) if span[0] <= found[1] <= span[1])
    sign = next(c for c in text if not c.isdigit())

    def write(day: date) -> str:
        values = {"y": day.year, "m": day.month, "d": day.day}
        return sign.join(f"{values[c]:0{n}d}" for c, n in zip(order, widths))

    if write(found[1]) != text:
        return None
    days = (last - first).days + 1
    side = int(days**0.5) + 1
    value = (found[1] - first).days
    tweak = f"date{order}{widths}{place or ''}"
    while True:  # numbers beyond the calendar, or of another form when written, are walked over
        value = _number(feistel(key, tweak, list(divmod(value, side)), [side, side], back), [side, side])
        if value < days:
            day = first + timedelta(value)
            new = write(day)
            if len(new) == len(text) and _read_date(new) == (order, day):
                return new


def _email(key: bytes, text: str, back: bool) -> str:
    name, _, top = text.rpartition(".")
    return f"{_signs(key, 'email', name, back)}.{top}"


def _phone(key: bytes, text: str, back: bool) -> str:
    country = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    start = country.end() if country else 0
    return text[:start] + _signs(key, "phone", text[start:], back)


def _ssn(key: bytes, text: str, back: bool) -> str | None:
    if text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[7:] == "0000":
        return None
    return _signs(key, "ssn", text, back)


_CHANGE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "card": _card, "ssn": _ssn, "phone": _phone}


@lru_cache(maxsize=50_000)
def pseudonym(key: bytes, kind: str, value: str, back: bool = False) -> str | None:
    """The pseudonym of a value, or None where the value fails the check of its kind."""
    return _CHANGE[kind](key, value, back)


def _ends(kind: str, value: str) -> list[int]:
    """Lengths of the beginnings of a candidate that may be the value, all at borders of its groups.

    Of a card the shortest comes first, so that the same number is found whatever digits follow it; of an
    IBAN that with its country's length.
    """
    if kind not in ("card", "iban"):
        return [len(value)]
    least = 13 if kind == "card" else 15
    borders = [i for i, c in enumerate(value) if not c.isalnum() and sum(map(str.isalnum, value[:i])) >= least]
    if kind == "card":
        return [*borders, len(value)]
    ends = [len(value), *reversed(borders)]
    usual = IBAN_LENGTHS.get(value[:2])
    return sorted(ends, key=lambda n: len(value[:n].replace(" ", "")) != usual)


def _next_value(text: str, at: int, key: bytes, back: bool) -> tuple[str, int, int, int | None] | None:
    """Kind, start and end of the next valid value, and the place of the first candidate that failed before it.

    Where a candidate fails, its shorter forms and the other kinds are tried; then the search goes on one
    group later.
    """
    failed = None
    while match := PATTERN.search(text, at):
        start = match.start()
        for kind, pattern in _PATTERNS.items():
            found = pattern.match(text, start)
            for n in _ends(kind, found[0]) if found else ():
                if pseudonym(key, kind, found[0][:n], back) is not None:
                    return kind, start, start + n, failed
                failed = start if failed is None else failed
        at = _GROUP.match(text, start).end()
    return None


def replace_text(text: str, key: bytes, back: bool = False) -> tuple[str, Counter]:
    """Text with every valid value exchanged, and how many values of each kind there were."""
    counts: Counter = Counter()
    if not _MAYBE.search(text):
        return text, counts
    parts, at = [], 0
    while found := _next_value(text, at, key, back):
        kind, start, end, failed = found
        new = pseudonym(key, kind, text[start:end], back)
        if failed is not None:  # pseudonyms with which an earlier candidate would pass are walked over
            low, high = max(at - 1, failed - 1, 0), end + _LONGEST
            expected = (kind, start - low, end - low)
            while True:
                found = _next_value(text[low:start] + new + text[end:high], failed - low, key, back)
                if found and found[:3] == expected:
                    break
                new = pseudonym(key, kind, new, back)
        counts[kind] += 1
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), counts


def pseudonymized(text: Column, key: bytes, back: bool = False) -> Column:
    """Struct of the new text and the count of each kind; NULL text stays NULL, with counts of 0."""
    schema = T.StructType(
        [T.StructField("text", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]]
    )

    @arrow_udf(schema)
    def change(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [(None, Counter()) if t is None else replace_text(t, key, back) for t in batch.to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string())]
            columns += [pa.array([f[1][k] for f in found], pa.int64()) for k in KINDS]
            yield pa.StructArray.from_arrays(columns, names=schema.fieldNames())

    return change(text)


def pseudonymized_documents(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The documents with their texts exchanged; all columns keep their names, places and lengths."""
    changed = pseudonymized(F.col(f"`{text_col}`"), key)["text"]
    return docs.select(*[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
