"""Operator 8, PII: format-preserving pseudonyms from keyed Feistel permutations.

A found value is a number within its format: the digits of a card without the check digit, an address's 32 bits, a day
of two centuries. A keyed Feistel permutation of that format's numbers gives the pseudonym's, written as the value was.
So a pseudonym is as valid as its value and has its format, two values never share one, and equal values get equal ones in all
documents.

A date's format is its order, its separator and the digits of its day and month: 1/2/2020 becomes another date of one-digit
day and month. What can be day first is; month first are only those whose second number is over 12, and they stay among
themselves. Dates written in full, year first or day first, are linked; those of fewer digits only among their likes."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.shared import as_text, slices

ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)

#: What may be personal; each find is validated before it counts.
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?<![A-Za-z0-9])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?P<secret>[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}[ .-]\d{3,4}|\+\d{7,15}|\+\d{1,3}(?:[ -]\d{2,4}){2,4})(?!\d|[.-]\d)"
    r"|(?P<local>\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<iso>\d{4}(?P<s1>[-/.])\d{2}(?P=s1)\d{2})(?!\d)"
    r"|(?P<day>\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?!\d)"
    r"|(?<!\d\.)(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\d|\.\d)"
    r"|(?P<card>\d(?:[ -]?\d){11,18})(?![A-Za-z0-9])"
    r")"
)
_DIGIT = re.compile("[0-9]")


def permuted(x: int, left: int, right: int, key: bytes, inverse: bool = False) -> int:
    """The place of x among left * right numbers: each round adds a keyed hash of one part to the other."""
    a, b = divmod(x, right)
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        source, most = (b, left) if i % 2 else (a, right)
        told = hashlib.blake2b(b"%d,%d,%d,%d" % (i, left, right, source), key=key, digest_size=32).digest()
        step = int.from_bytes(told, "big") % most * (-1 if inverse else 1)
        if i % 2:
            a = (a + step) % left
        else:
            b = (b + step) % right
    return a * right + b


def walked(x: int, n: int, key: bytes, inverse: bool = False) -> int:
    """The same among 0 to n - 1 for any n: numbers outside are walked past."""
    right = max(2, int(n**0.5))
    left = -(-n // right)
    x = permuted(x, left, right, key, inverse)
    while x >= n:
        x = permuted(x, left, right, key, inverse)
    return x


def digits(text: str, key: bytes, inverse: bool = False) -> str:
    """The permuted digits of a string of digits, as many."""
    half = len(text) // 2
    return f"{permuted(int(text), 10 ** (len(text) - half), 10**half, key, inverse):0{len(text)}d}"


def _filled(form: str, new: str) -> str:
    """The alphanumerics of form replaced by those of new, in turn."""
    at = iter(new)
    return "".join(next(at) if c.isalnum() else c for c in form)


def luhn(body: str) -> int:
    """The check digit of body."""
    doubled = [int(c) * 2 if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body))]
    return -sum(v - 9 if v > 9 else v for v in doubled) % 10


def iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def letters(text: str, key: bytes, inverse: bool = False) -> str:
    """Permuted alphanumerics: a digit for a digit, a letter for a letter of the same case; other characters stay."""
    kinds = [(10, "0") if c.isdigit() else (26, "a" if c.islower() else "A") for c in text if c.isascii() and c.isalnum()]
    if not kinds:
        return text
    x, left, right = 0, 1, 1
    for i, (n, _) in enumerate(kinds):
        if i < (len(kinds) + 1) // 2:
            left *= n
        else:
            right *= n
    for c, (n, zero) in zip((c for c in text if c.isascii() and c.isalnum()), kinds, strict=True):
        x = x * n + ord(c) - ord(zero)
    x, out = permuted(x, left, max(right, 1), key, inverse), []
    for n, zero in reversed(kinds):
        x, k = divmod(x, n)
        out.append(chr(ord(zero) + k))
    return _filled(text, "".join(reversed(out)))


def _card(found: str, key: bytes, inverse: bool) -> str | None:
    plain = re.sub(r"\D", "", found)
    if not 13 <= len(plain) <= 19 or luhn(plain[:-1]) != int(plain[-1]):
        return None
    body = digits(plain[:-1], key, inverse)
    return _filled(found, f"{body}{luhn(body)}")


def _number(found: str, key: bytes, inverse: bool) -> str:
    """Any other long number: all digits are permuted."""
    return _filled(found, digits(re.sub(r"\D", "", found), key, inverse))


@cache
def days_of(day_digits: int, month_digits: int, month_first: bool) -> list[int]:
    """The days, as ordinals, that are written with so many digits; month first: those that can't be read as day first."""
    every = map(dt.date.fromordinal, range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1))
    return [x.toordinal() for x in every if (day_digits == 2 or x.day < 10) and (month_digits == 2 or x.month < 10) and (not month_first or x.day > 12)]


def _date(found: str, key: bytes, inverse: bool) -> str | None:
    sep = re.search(r"\D", found)[0]
    parts = found.split(sep)
    y, m, d = (0, 1, 2) if len(parts[0]) == 4 else (2, 0, 1) if int(parts[1]) > 12 else (2, 1, 0)
    try:
        day = dt.date(int(parts[y]), int(parts[m]), int(parts[d]))
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    days = days_of(len(parts[d]), len(parts[m]), (m, d) == (0, 1))
    new = dt.date.fromordinal(days[walked(bisect_left(days, day.toordinal()), len(days), key, inverse)])
    out = [""] * 3
    out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:0{len(parts[m])}d}", f"{new.day:0{len(parts[d])}d}"
    return sep.join(out)


def _ip(found: str, key: bytes, inverse: bool) -> str | None:
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255:
        return None
    x = permuted(int.from_bytes(bytes(octets), "big"), 1 << 16, 1 << 16, key, inverse)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(found: str, key: bytes, inverse: bool) -> str | None:
    plain = found.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in body + plain[:4])) % 97 != 1:
        return None
    body = letters(body, key, inverse)
    return _filled(found, f"{country}{iban_check(country, body):02d}{body}")


def _phone(found: str, key: bytes, inverse: bool) -> str | None:
    head = re.match(r"\+\d{1,3}(?=\D)|\+\d", found)
    code, rest = (head[0], found[head.end() :]) if head else ("", found)
    plain = re.sub(r"\D", "", rest)
    if not 7 <= len(plain) + len(code) <= 16 or len(plain) < 6:
        return None
    return code + _filled(rest, digits(plain, key, inverse))


def _ssn(found: str, key: bytes, inverse: bool) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas, groups, serials = 898, 99, 9999
    x = ((area - 1 - (area > 666)) * groups + group - 1) * serials + serial - 1
    x, serial = divmod(walked(x, areas * groups * serials, key, inverse), serials)
    area, group = divmod(x, groups)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _email(found: str, key: bytes, inverse: bool) -> str:
    """Case stays where it was: addresses that differ in it only get pseudonyms that differ in it only."""
    rest, _, top = found.rpartition(".")
    new = letters(rest.lower(), key, inverse)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, rest, strict=True)) + f".{top}"


def _secret(found: str, key: bytes, inverse: bool) -> str:
    half = len(found) // 2
    new = f"{permuted(int(found, 16), 16 ** (len(found) - half), 16**half, key, inverse):0{len(found)}x}"
    return new.upper() if found.upper() == found else new


KINDS = {"email": _email, "iban": _iban, "secret": _secret, "phone": _phone, "local": _phone, "ssn": _ssn, "iso": _date, "day": _date, "ip": _ip, "card": _card}


def pseudonym(kind: str, found: str, key: bytes, inverse: bool = False) -> str | None:
    """The pseudonym of a find, or with `inverse` the value behind one; None where it isn't a valid value of its kind."""
    own = hashlib.blake2b(KINDS[kind].__name__.encode(), key=key, digest_size=32).digest()
    return KINDS[kind](found, own, inverse)


def pseudonymized(text: str, key: bytes) -> tuple[str, list[tuple[str, int, str]]]:
    """The text with all valid finds replaced, and (kind, start in the new text, pseudonym) of each."""
    if "@" not in text and not _DIGIT.search(text):
        return text, []
    out, at, length, found = [], 0, 0, []
    for m in PATTERN.finditer(text):
        new = pseudonym(m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k]), m[0], key)
        if new is None:
            continue
        out.append(text[at : m.start()])
        length += m.start() - at
        kind = next(k for k in KINDS if m[k])
        found.append((kind, length, new))
        out.append(new)
        length += len(new)
        at = m.end()
    return ("".join([*out, text[at:]]), found) if found else (text, found)


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("value", T.StringType())]))


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with `text` pseudonymized, and a column pii_found of (kind, start, value) for what stands there now.

    Who has the key can invert all pseudonyms, so it is the caller's to keep; 1 to 64 bytes.

    Every row and every other column stays (a column named pii_found is replaced). A null text stays null, with no finds;
    an empty text and one without finds stay as they are. Equal values get equal pseudonyms under one key, in any row."""
    if not 1 <= len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    docs = docs.drop("pii_found")
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_found", FOUND)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            column = part.column(text)
            done = [pseudonymized(t, key) for t in as_text(column).to_pylist()]
            texts = pa.array([None if gone else t for (t, _), gone in zip(done, column.is_null().to_pylist(), strict=True)], column.type)
            found = pa.array([[{"kind": k, "start": s, "value": v} for k, s, v in f] for _, f in done], kind)
            columns = [texts if name == text else part.column(name) for name in part.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*part.schema.names, "pii_found"])

    return docs.mapInArrow(run, schema)


def linked(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_found and found (the pseudonyms, by which documents are linked) of each row."""
    out = pseudonymize(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")), key)
    return out.select("doc_id", "text", F.size("pii_found").cast("bigint").alias("n_found"), F.transform("pii_found", lambda x: x["value"]).alias("found"))
