"""Operator 9: format-preserving pseudonyms for validated numbers, dates and addresses."""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, others, quoted

#: The setting of the session that holds the key. Spark keeps settings of this name out of its logs and pages.
KEY_SETTING = "spark.weftlink.secret"
ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
KINDS = ("email", "phone", "card", "ip", "ssn", "date")
# In text: bytes of other scripts count as letters, so that a match never begins or ends within a word.
FOUND = re.compile(
    rb"(?P<email>(?<![A-Za-z0-9._%+\x80-\xff-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    rb"|(?P<phone>\+\d{1,3}[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d))"
    rb"|(?P<ip>(?<![A-Za-z0-9.\x80-\xff])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d|[A-Za-z\x80-\xff]))"
    rb"|(?P<date>(?<![A-Za-z0-9./-])(?:\d{4}([-/.])\d{2}\5\d{2}|\d{2}([-/.])\d{2}\6\d{4})(?![A-Za-z0-9]|[-/.]\d))"
    rb"|(?P<ssn>(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9]|-\d))"
    rb"|(?P<card>(?<![A-Za-z0-9\x80-\xff])(?:\d{13,19}|\d{4}([ -])\d{4}\9\d{4}\9\d{1,7})(?![A-Za-z0-9\x80-\xff]))"
)
HINT = re.compile(rb"[0-9@]")


def rounded(key: bytes, tweak: str, n: int, half: int, size: int) -> int:
    said = hashlib.shake_256(key + f"|{tweak}|{n}|{half}".encode()).digest(16 + (size.bit_length() + 7) // 8)
    return int.from_bytes(said, "big") % size


def permute(value: int, size: int, tweak: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 to size - 1: a Feistel network on pairs (left, right), walked until it stays in range."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a <<= 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if n % 2:
                right = (right + sign * rounded(key, tweak, n, left, b)) % b
            else:
                left = (left + sign * rounded(key, tweak, n, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def mixed(digits: list[int], radixes: list[int], tweak: str, key: bytes, back: bool) -> list[int]:
    """Permute a number written with a radix of its own at each place."""
    value, size = 0, 1
    for d, r in zip(digits, radixes, strict=True):
        value, size = value * r + d, size * r
    value = permute(value, size, tweak, key, back)
    out = []
    for r in reversed(radixes):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def refill(text: str, digits: Iterator[str]) -> str:
    return "".join(next(digits) if c.isdigit() else c for c in text)


def check_digit(digits: str) -> str:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 if k % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def digits_of(text: str, tweak: str, key: bytes, back: bool) -> str:
    own = [int(c) for c in text]
    return "".join(map(str, mixed(own, [10] * len(own), f"{tweak}{len(own)}", key, back)))


def email(text: str, key: bytes, back: bool) -> str | None:
    """The part before the @: letters and digits are permuted, other characters and the domain stay."""
    local, _, domain = text.partition("@")
    sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    own = [(k, next(s for s in sets if c in s)) for k, c in enumerate(local) if c.isalnum()]
    shape = "".join("aA0"[sets.index(s)] for _, s in own)
    new, out = mixed([s.index(local[k]) for k, s in own], [len(s) for _, s in own], f"email {shape}", key, back), list(local)
    for (k, s), d in zip(own, new, strict=True):
        out[k] = s[d]
    return "".join(out) + "@" + domain


def phone(text: str, key: bytes, back: bool) -> str | None:
    """The last ten digits are permuted; the country code stays."""
    own = re.sub(r"\D", "", text)
    return refill(text, iter(own[:-10] + digits_of(own[-10:], "phone", key, back)))


def card(text: str, key: bytes, back: bool) -> str | None:
    """Numbers that pass the Luhn test are permuted into numbers that pass it."""
    own = re.sub(r"\D", "", text)
    if check_digit(own[:-1]) != own[-1] or not 13 <= len(own) <= 19:
        return None
    new = digits_of(own[:-1], "card", key, back)
    return refill(text, iter(new + check_digit(new)))


def ip(text: str, key: bytes, back: bool) -> str | None:
    """Each part keeps its number of digits and stays at most 255."""
    parts = text.split(".")
    if any(str(int(p)) != p or int(p) > 255 for p in parts):
        return None
    low = [{1: 0, 2: 10, 3: 100}[len(p)] for p in parts]
    new = mixed([int(p) - m for p, m in zip(parts, low, strict=True)], [{0: 10, 10: 90, 100: 156}[m] for m in low], f"ip {low}", key, back)
    return ".".join(str(d + m) for d, m in zip(new, low, strict=True))


def ssn(text: str, key: bytes, back: bool) -> str | None:
    a, b, c = map(int, text.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not b or not c:
        return None
    a, b, c = mixed([areas.index(a), b - 1, c - 1], [len(areas), 99, 9999], "ssn", key, back)
    return f"{areas[a]:03}-{b + 1:02}-{c + 1:04}"


def day(text: str, key: bytes, back: bool) -> str | None:
    """Days of the years 1900 to 2099, by year, month and day, or day, month and year, or else month, day and year."""
    mark = re.search(r"\D", text)[0]
    parts = text.split(mark)
    for order in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        at = dict(zip(order, map(int, parts), strict=True))
        try:
            when = date(at["y"], at["m"], at["d"])
        except ValueError:
            continue
        if not FIRST_DAY <= when <= LAST_DAY:
            return None
        if order == "mdy":  # among the days that no other order explains
            size, value = (LAST_DAY.year - FIRST_DAY.year + 1) * 12 * 19, ((when.year - FIRST_DAY.year) * 12 + when.month - 1) * 19 + when.day - 13
            while True:
                value = permute(value, size, "mdy", key, back)
                y, m, d = value // 228 + FIRST_DAY.year, value // 19 % 12 + 1, value % 19 + 13
                try:
                    new = date(y, m, d)
                    break
                except ValueError:
                    continue
        else:
            new = FIRST_DAY + timedelta(permute((when - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "day", key, back))
        return mark.join(f"{getattr(new, {'y': 'year', 'm': 'month', 'd': 'day'}[x]):0{4 if x == 'y' else 2}}" for x in order)
    return None


RULES = {"email": email, "phone": phone, "card": card, "ip": ip, "ssn": ssn, "date": day}


def pseudonyms(text: bytes, key: bytes, back: bool = False) -> tuple[bytes, dict[str, int]]:
    """The text with its validated values exchanged, and how many of each kind; back: undo it."""
    if not HINT.search(text):
        return text, {}
    counts: dict[str, int] = {}

    def swap(m: re.Match) -> bytes:
        kind = next(k for k in KINDS if m[k] is not None)
        new = RULES[kind](m[0].decode(), key, back)
        if new is None:
            return m[0]
        counts[kind] = counts.get(kind, 0) + 1
        return new.encode()

    return FOUND.sub(swap, text), counts


def session_key(spark: SparkSession) -> bytes:
    """The session's key: as set, or else drawn once, so that nobody without it can undo the pseudonyms."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """docs with each validated value in the text exchanged for its pseudonym, and the columns n_email, n_phone, n_card, n_ip, n_ssn, n_date.

    Equal values get equal pseudonyms in all documents, in the same format; back=True undoes it. Numbers that fail their check
    (Luhn, parts over 255, days that don't exist) stay. A null text stays null, an empty one empty; repeated rows are treated
    alike, an empty table gives none. Columns of docs with the names of the counts are replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    counts = [f"n_{k}" for k in KINDS]
    fields = [T.StructField("__new", T.StringType())] + [T.StructField(c, T.LongType()) for c in counts]

    def start():
        def made(batch: list[bytes]) -> list:
            done = [pseudonyms(t, key, back) for t in batch]
            return [pa.array([x for x, _ in done], pa.binary()).cast(pa.string()), *(pa.array([n.get(k, 0) for _, n in done], pa.int64()) for k in KINDS)]

        return made

    out = map_text(docs.select(*[F.col(quoted(c)) for c in others(docs.columns, counts)]), text_col, fields, start)
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("__new"))).drop("__new")
