"""Personal data replaced by keyed pseudonyms of the same format.

Each value found is mapped to a number below the size of its format's domain,
permuted there by a Feistel network under a secret key, and written back in the
same format. Equal values get equal pseudonyms in every document, different
ones different ones, and whoever has the key can invert the mapping. Numbers
with check digits and dates are taken only if valid, and stay valid.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cratewise.llm.text import slices

ROUNDS = 10
KINDS = ("email", "iban", "date", "ssn", "ip", "phone", "card")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# The formats that are looked for, by kind.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<mark>[/.])[0-9]{1,2}(?P=mark)[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?P<gap>[\x20-])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}|[0-9]{4}(?P<space>[\x20-])[0-9]{6}(?P=space)[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
}
ANY = re.compile("|".join(f"(?P<{k}>{FORMATS[k]})" for k in KINDS))
HINT = re.compile("[0-9@]")


def feistel(value: int, size: int, key: bytes, tweak: str, invert: bool = False) -> int:
    """A keyed permutation of 0..size-1; values outside are walked on until one lies inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    wide = (half + 7) // 8

    def mixed(turn: int, x: int) -> int:
        out = b""
        while len(out) < wide:
            out += hashlib.blake2b(f"{tweak}|{size}|{turn}|{len(out)}|{x}".encode(), key=key, digest_size=64).digest()
        return int.from_bytes(out[:wide], "big") & mask

    while True:
        left, right = value >> half, value & mask
        if invert:
            for turn in reversed(range(ROUNDS)):
                left, right = right ^ mixed(turn, left), left
        else:
            for turn in range(ROUNDS):
                left, right = right, left ^ mixed(turn, right)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` with it a valid number."""
    total = 0
    for place, c in enumerate(reversed(body)):
        d = int(c) * (2 if place % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, body: str) -> str:
    moved = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(moved) % 97:02d}"


def _issued(digits: str) -> bool:
    """Areas, groups and serials of social security numbers that can be issued."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _written(template: str, fresh: str) -> str:
    """``template`` with its letters and digits replaced in order by those of ``fresh``."""
    rest = iter(fresh)
    return "".join(next(rest) if c.isalnum() else c for c in template)


def _alphabets(value: str) -> list[str]:
    return [string.digits if c.isdigit() else string.ascii_uppercase if c.isupper() else string.ascii_lowercase
            for c in value if c.isalnum()]


def _permuted(value: str, key: bytes, tweak: str, invert: bool) -> str:
    """Digits to digits and letters to letters of their case; other characters stay."""
    sets, number, size = _alphabets(value), 0, 1
    for c, letters in zip((c for c in value if c.isalnum()), sets):
        number, size = number * len(letters) + letters.index(c), size * len(letters)
    number = feistel(number, size, key, tweak, invert)
    out = []
    for letters in reversed(sets):
        number, at = divmod(number, len(letters))
        out.append(letters[at])
    return _written(value, "".join(reversed(out)))


def _date_parts(value: str) -> tuple[str, datetime.date] | None:
    """The order of year, month and day, and the day. With slashes a first number up to 12 is the month, with points the day is first.

    Pseudonyms are written with two digits for day and month."""
    numbers = [int(x) for x in re.split("[-/.]", value)]
    if "-" in value:
        order = "ymd"
    elif "." in value or numbers[0] > 12:
        order = "dmy"
    else:
        order = "mdy"
    parts = dict(zip(order, numbers))
    try:
        day = datetime.date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    return (order, day) if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, invert: bool = False) -> str | None:
    """The pseudonym of a value of ``kind``, or None if the value isn't valid."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{_permuted(local, key, f'email|{domain}', invert)}@{domain}"
    digits = "".join(c for c in value if c.isalnum())
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = digits[:-1]
        while True:  # the domain is that of valid numbers other than one repeated digit
            body = _permuted(body, key, "card", invert)
            fresh = body + luhn_digit(body)
            if len(set(fresh)) > 1:
                return _written(value, fresh)
    if kind == "iban":
        country, check, body = digits[:2], digits[2:4], digits[4:]
        if not 15 <= len(digits) <= 34 or iban_digits(country, body) != check:
            return None
        body = _permuted(body, key, f"iban|{country}", invert)
        return _written(value, country + iban_digits(country, body) + body)
    if kind == "ssn":
        if not _issued(digits):
            return None
        while True:  # walk on to a number that can be issued
            digits = _permuted(digits, key, "ssn", invert)
            if _issued(digits):
                return _written(value, digits)
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        number = feistel(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip", invert)
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "phone":
        at = len(digits) - 10  # the country code stays
        return _written(value, digits[:at] + _permuted(digits[at:], key, f"phone|{digits[:at]}", invert))
    parts = _date_parts(value)
    if parts is None:
        return None
    order, day = parts
    size = LAST_DAY - FIRST_DAY + 1
    number = day.toordinal() - FIRST_DAY
    while True:  # walk on to a day that reads back in the same order
        number = feistel(number, size, key, f"date|{order}", invert)
        day = datetime.date.fromordinal(FIRST_DAY + number)
        if order != "dmy" or "." in value or day.day > 12:
            break
    numbers = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
    marks = re.findall("[-/.]", value)
    return numbers[order[0]] + marks[0] + numbers[order[1]] + marks[1] + numbers[order[2]]


def replace_values(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value in the original."""
    if not HINT.search(text):
        return text, []
    out, spans, at, seek = [], [], 0, 0
    while match := ANY.search(text, seek):
        kind = match.lastgroup
        fresh = pseudonym(kind, match.group(), key)
        if fresh is None:  # another format may start inside
            seek = match.start() + 1
            continue
        out += [text[at:match.start()], fresh]
        spans.append((kind, match.start(), match.end()))
        at = seek = match.end()
    return "".join([*out, text[at:]]), spans


def pseudonymize(docs: DataFrame, key: bytes, *, text: str = "text", count: str = "n_private", spans: str = "private_spans") -> DataFrame:
    """All columns of ``docs`` with the text replaced, and columns named by ``count`` and ``spans``.

    ``spans`` is ``kind:start:end`` of each value in the original text
    (code points, end exclusive), joined by commas. A null text stays null and
    has no values. Each row is treated alone. Columns with the two names are
    replaced.
    """
    kept = [c for c in docs.columns if c not in (text, count, spans)]
    ordered = docs.select(*kept, F.col(text).cast("string").alias(text))
    schema = StructType([*ordered.schema.fields, StructField(count, LongType()), StructField(spans, StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, counts, places = [], [], []
            for body in batch.column(text).to_pylist():
                fresh, found = (None, []) if body is None else replace_values(body, key)
                texts.append(fresh)
                counts.append(len(found))
                places.append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
            columns = [batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(places, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, text, count, spans])

    return ordered.mapInArrow(work, schema)
