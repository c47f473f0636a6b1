"""Format-preserving pseudonyms for personal data, linked across documents.

Numbers and dates that validate (card numbers by Luhn, IBANs by mod 97, IPv4 by octet range, calendar dates, phone and
social-security numbers by their numbering rules), mail addresses and assigned secrets are replaced within their
format. A value is ranked into 0..N-1 of its format's domain, sent through a keyed Feistel permutation of
that domain and written back, so a pseudonym validates like its original, equal values have equal pseudonyms in
every document whatever their separators, and different values different ones. Everything else of a text stays as it is.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

KEY = b"tideline-pseudonyms"
#: A deployment sets its own key here.
KEY_CONF = "spark.tideline.pseudonyms.key"
ROUNDS = 10
#: Characters of a secret that are permuted as one number; longer values aren't cached either.
LONG = 256

MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?=[A-Za-z0-9])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,63}(?![A-Za-z0-9])")
#: Assigned secrets: within quotes anything up to the line's end; bare after = three characters or more; bare after : the same with a digit
#: among them, or 16 or more, as prose follows colons.
_NAMES, _VALUE = r"token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key", r"[A-Za-z0-9+/_=.!@#$%^&*~-]"
SECRET = re.compile(rf"(?i)\b(?:{_NAMES})\b\s{{0,3}}(?:[:=]\s{{0,3}}(?P<quoted>\"[^\"\n]+\"|'[^'\n]+')|=\s{{0,3}}(?P<given>{_VALUE}{{3,}})|:\s{{0,3}}(?P<told>{_VALUE}{{16,}}|(?={_VALUE}*\d){_VALUE}{{3,}}))")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|(?=::))(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![\w:]|\.\d)")
#: Where IP6 may be.
GROUPS = re.compile(r"::|:[0-9A-Fa-f]{1,4}:")
KINDS = {
    "date": r"\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "ssn": r"\d{3}(?P<s3>[ -])\d{2}(?P=s3)\d{4}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,9}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
_END = r"(?![\w]|[.-]\d)"
#: What may follow a value; a date may also be followed by T and a time.
ENDS = {kind: rf"(?:(?=[Tt]\d\d)|{_END})" if kind == "date" else _END for kind in KINDS}
NUMBER = re.compile(r"(?<![\w.+-])(?:" + "|".join(f"(?P<{kind}>{p}){ENDS[kind]}" for kind, p in KINDS.items()) + ")")
#: Kinds alone, for the shorter ends of a match that doesn't validate; and where those may be.
ALONE = {kind: (re.compile(f"(?:{p}){ENDS[kind]}"), re.compile(p), re.compile(ENDS[kind])) for kind, p in KINDS.items()}
SEPARATOR = re.compile(r"[^\w()]")
#: Where NUMBER may begin, and what SECRET needs; a text without these is not searched for them.
DIGIT = re.compile(r"\d")
ASSIGNED = re.compile(r"[:=]")
FIRST, LAST = datetime.date(1900, 1, 1), datetime.date(2100, 1, 1)


def permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1: a Feistel network over a x b >= n, walked until it is within n again."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    name = f"{tweak}|{n}|".encode()
    while True:
        left, right, p, q = x // b, x % b, a, b
        for i in range(ROUNDS):
            data = name + b"%d|%d" % (i, right)
            f = int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=32).digest(), "big") if q < 1 << 120 else int.from_bytes(b"".join(hashlib.blake2b(data + b"|%d" % j, key=key[:64]).digest() for j in range(q.bit_length() // 512 + 2)), "big")
            left, right, p, q = right, (left + f) % p, q, p
        x = left * b + right if p == a else right * b + left
        if x < n:
            return x


def _digits(text: str, new: str) -> str:
    """text with its digits replaced, in order, by new; separators stay."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _luhn(digits: str) -> int:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10


def _characters(text: str, key: bytes, kind: str, lower: bool = False) -> str:
    """Letters and digits permuted within their classes, other characters kept."""
    radix = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 0 for c in text]
    n, x = 1, 0
    for c, r in zip(text, radix):
        if r:
            n, x = n * r, x * r + (int(c) if r == 10 else ord(c.lower()) - 97)
    shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", text.lower()))
    x = permuted(x, n, key, f"{kind}|{shape}")
    out = []
    for c, r in zip(reversed(text), reversed(radix)):
        if r:
            x, d = divmod(x, r)
            c = str(d) if r == 10 else chr((65 if c.isupper() and not lower else 97) + d)
        out.append(c)
    return "".join(reversed(out))


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or len(set(digits)) < 2 or _luhn(digits):
        return None
    n = len(digits) - 1
    body = str(permuted(int(digits[:-1]), 10**n, key, "card")).zfill(n)
    return _digits(text, body + str(-_luhn(body + "0") % 10))


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ip6(text: str, key: bytes) -> str | None:
    """An IPv6 address in any spelling, of two groups at least; one address has one pseudonym, spelled shortest."""
    if len(re.findall("[0-9A-Fa-f]+", text)) < 2:
        return None
    try:
        x = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(permuted(int(x), 1 << 128, key, "ip6")))


def _phone(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    # The last digits are permuted; a country code stays. So +1 (017) 555-7713 and 017-555-7713 stay linked.
    n = min(10, len(digits) - 1 if text[0] == "+" else len(digits))
    new = str(permuted(int(digits[-n:]), 10**n, key, "phone")).zfill(n)
    return _digits(text, digits[:-n] + new)


def _ssn(text: str, key: bytes) -> str | None:
    sep = text[3]
    area, group, serial = map(int, text.split(sep))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    x = permuted((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn")
    x, serial = divmod(x, 9999)
    place, group = divmod(x, 99)
    return f"{place + 1 + (place >= 665):03}{sep}{group + 1:02}{sep}{serial + 1:04}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text: str, key: bytes) -> str | None:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34 or _mod97(bare[4:] + bare[:4]) != 1:
        return None
    body = _characters(bare[4:], key, f"iban {bare[:2]}")
    new = iter(f"{bare[:2]}{98 - _mod97(body + bare[:2] + '00'):02}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _other_date(day: datetime.date, key: bytes) -> datetime.date:
    """The pseudonym of a date: days to 12, which could be months, among their like, later ones among theirs."""
    if day.day <= 12:
        x = permuted(((day.year - FIRST.year) * 12 + day.month - 1) * 12 + day.day - 1, (LAST.year - FIRST.year) * 144, key, "date early")
        return datetime.date(FIRST.year + x // 144, x // 12 % 12 + 1, x % 12 + 1)
    x, first, n = day.toordinal(), FIRST.toordinal(), LAST.toordinal() - FIRST.toordinal()
    while True:
        x = first + permuted(x - first, n, key, "date late")
        if (found := datetime.date.fromordinal(x)).day > 12:
            return found


def _date(text: str, key: bytes) -> str | None:
    """A calendar date in any layout: a year first, or a day first, or a month first where it can only be so; one date has one pseudonym in all."""
    sep = re.search(r"\D", text)[0]
    parts = text.split(sep)
    numbers = list(map(int, parts))
    for order in ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            day = datetime.date(*(numbers[i] for i in order))
        except ValueError:
            continue
        if FIRST <= day < LAST:
            new, found = [0, 0, 0], _other_date(day, key)
            for i, v in zip(order, (found.year, found.month, found.day)):
                new[i] = v
            return sep.join(str(v).zfill(max(2, len(p))) if len(p) > 1 or v > 9 else str(v) for v, p in zip(new, parts))
    return None


def _blocks(text: str, key: bytes, kind: str, lower: bool = False) -> str:
    """A secret's hex digits, or letters and digits within their classes; of more than LONG characters by blocks, each keyed by all before it."""
    hexed, out, seen = kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text), [], hashlib.blake2b()
    for at in range(0, len(text), LONG):
        part = text[at : at + LONG]
        place = f"|{len(text)}|{seen.copy().hexdigest()}" if len(text) > LONG else ""
        if hexed:
            new = f"{permuted(int(part, 16), 16 ** len(part), key, 'hex' + place):0{len(part)}x}"
            out.append(new.upper() if text.isupper() else new)
        else:
            out.append(_characters(part, key, kind + place, lower))
        seen.update(part.encode("utf-8", "surrogatepass"))
    return "".join(out)


_HOW = {"card": _card, "ip": _ip, "ip6": _ip6, "phone": _phone, "ssn": _ssn, "iban": _iban, "date": _date}


@lru_cache(maxsize=20_000)
def pseudonym(kind: str, value: str, key: bytes = KEY) -> str | None:
    """The pseudonym of a value of a kind, or None if it doesn't validate."""
    if kind == "mail":
        local, _, domain = value.rpartition("@")
        return f"{_blocks(local, key, 'mail', lower=local.islower())}@{domain}"
    if kind == "secret":
        inner = value[1:-1] if value[0] in "\"'" else value
        return value.replace(inner, _blocks(inner, key, "secret"))
    return _HOW[kind](value, key)


def _first_valid(text: str, start: int, key: bytes) -> tuple[int, str, str] | None:
    """End, kind and pseudonym of the longest value at start that validates, at the kinds' own ends or at separators within them."""
    tries = []
    for order, (kind, (ended, bare, end)) in enumerate(ALONE.items()):
        m = ended.match(text, start)
        if m:
            # A card's digits are checked: it may end before a hyphen and more digits, as other kinds may not.
            inner = (s.start() for s in SEPARATOR.finditer(text, start + 1, m.end()))
            tries += [(-m.end(), order, kind)] + [(-e, order, kind) for e in inner if (kind == "card" or end.match(text, e)) and bare.fullmatch(text, start, e)]
    for e, _, kind in sorted(tries):
        if new := pseudonym(kind, text[start:-e], key):
            return -e, kind, new
    return None


def find(text: str, key: bytes = KEY) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym of each validated value of a text, in order and without overlap.

    Where a match as a whole doesn't validate, its shorter ends are tried, then the search resumes within it.
    """
    found = []
    whole = lambda kind, value: (pseudonym if len(value) <= LONG else pseudonym.__wrapped__)(kind, value, key)
    if "@" in text:
        found += [(m.start(), m.end(), "mail", whole("mail", m[0])) for m in MAIL.finditer(text)]
    if ASSIGNED.search(text):
        found += [(*m.span(m.lastgroup), "secret", whole("secret", m[m.lastgroup])) for m in SECRET.finditer(text)]
    if GROUPS.search(text):
        found += [(m.start(), m.end(), "ip6", new) for m in IP6.finditer(text) if (new := pseudonym("ip6", m[0], key))]
    if DIGIT.search(text):
        at = 0
        while m := NUMBER.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            new = pseudonym(kind, m[0], key)
            at = m.end()
            if new is None and (valid := _first_valid(text, m.start(), key)):
                at, kind, new = valid
            if new is None:
                at = m.start() + 1
            else:
                found.append((m.start(), at, kind, new))
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def replaced(text: str | None, key: bytes = KEY) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and start, end and kind of each within it."""
    spans, parts, at, out = find(text, key) if text else [], [], 0, []
    if not spans:
        return text, []
    length = 0
    for start, end, kind, new in spans:
        parts += [text[at:start], new]
        length += start - at
        out.append((length, length + len(new), kind))
        length += len(new)
        at = end
    return "".join([*parts, text[at:]]), out


SPANS = "array<struct<start:int,end:int,kind:string>>"


def pseudonymised(docs: DataFrame, key: bytes | None = None, spans: str | None = None) -> DataFrame:
    """docs(text, ...) with personal data of every whole text replaced; spans names a column for the places, in code points.

    The key is the argument's, else that of the session's KEY_CONF, else KEY, which is public: pseudonyms under it can be undone.
    Null texts stay null, empty ones empty; rows, repeated ones too, and all other columns stay as they are, but that one named as
    spans gives way to the places. No rows give no rows.
    """

    given = docs.sparkSession.conf.get(KEY_CONF, None)
    key = key or (given.encode() if given else KEY)

    @F.pandas_udf(f"text string, spans {SPANS}")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            done = [replaced(t, key) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in done], "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in done]})

    name = fresh(docs, "__pii")
    done = docs.withColumn(name, run(F.col("text").cast("string")))
    columns = [F.col(f"{name}.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() != (spans or "text ").lower()]
    return done.select(*columns, *([F.col(f"{name}.spans").alias(spans)] if spans else []))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, how many there are, and their kinds and places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, spans="spans").select("doc_id", "text", F.size("spans").cast("long").alias("n_pii"), "spans")
