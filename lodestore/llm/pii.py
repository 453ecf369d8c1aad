"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Found values are validated (Luhn, mod 97, ranges, calendar), reduced to their digits or letters and
permuted by a keyed Feistel network within all values of their format; check digits are made anew.
So a pseudonym is valid where its original was, equal values get equal pseudonyms in every document
however they are punctuated, and whoever has the key can go back. Kinds: e-mail addresses (the name
before the @ by letters and digits, the domain's first label too), payment cards, IBANs, US social
security numbers, telephone numbers, IPv4 addresses, calendar dates. What doesn't validate stays.

A network over pairs (left, right) adds a keyed hash of one half to the other, modulo that half's
size, in turn; that is a permutation for any two sizes. Values that must also satisfy a rule are
walked along their cycle until they do. Of digits in a row with a card among them the longest valid
run is the card; a number beside one can, one time in ten, make a longer valid run of it, in the text
or in what it becomes, and then the way back isn't sure. An IBAN is as long as its country's are, in
any letter case; what follows it isn't part of it. The country code
of a number after + is told by the E.164 plan, so that it isn't permuted. Dates are those of 1900 to 2099
in numbers. Where a kind doesn't validate the others are tried at the same place, then the next word.
Defined results: null text stays null with 0 found; a text without any is returned as it is. The key
has no default.
"""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

ROUNDS = 10


class Feistel:
    def __init__(self, key: bytes):
        self.key = key

    def _mix(self, kind: str, turn: int, half: int, size: int) -> int:
        digest = blake2b(f"{kind}|{turn}|{half}".encode(), key=self.key, digest_size=24).digest()
        return int.from_bytes(digest, "big") % size

    def halves(self, kind: str, left: int, right: int, m: int, n: int, back: bool = False) -> tuple[int, int]:
        """A permutation of pairs below (m, n)."""
        turns = range(ROUNDS)
        for t in reversed(turns) if back else turns:
            sign = -1 if back else 1
            if t % 2:
                right = (right + sign * self._mix(kind, t, left, n)) % n
            else:
                left = (left + sign * self._mix(kind, t, right, m)) % m
        return left, right

    def below(self, kind: str, value: int, size: int, valid=lambda v: True, back: bool = False) -> int:
        """A permutation of the valid numbers below size, by walking the cycle of a permutation of
        pairs that covers them."""
        n = max(1, int(size**0.5))
        m = -(-size // n)
        while True:
            left, right = self.halves(kind, value // n, value % n, m, n, back)
            value = left * n + right
            if value < size and valid(value):
                return value

    def digits(self, kind: str, text: str, valid=lambda s: True, back: bool = False) -> str:
        """Among the valid digit strings of one length."""
        size = 10 ** len(text)
        found = self.below(f"{kind}{len(text)}", int(text), size, lambda v: valid(str(v).zfill(len(text))), back)
        return str(found).zfill(len(text))

    def word(self, kind: str, text: str, back: bool = False) -> str:
        """Letters a-z and A-Z and digits each within their kind; other characters stay and count as
        part of the kind."""
        sets = ["0123456789" if c.isascii() and c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else "" for c in text]
        shape = "".join(c if not s else s[0] for c, s in zip(text, sets))
        places = [i for i, s in enumerate(sets) if s]
        if not places:
            return text
        size = 1
        value = 0
        for i in places:
            size, value = size * len(sets[i]), value * len(sets[i]) + sets[i].index(text[i])
        if size < 100_000:  # too few values to hide in: still a permutation
            shape += "!"
        value = self.below(f"{kind}{shape}", value, size, back=back)
        out = list(text)
        for i in reversed(places):
            value, k = divmod(value, len(sets[i]))
            out[i] = sets[i][k]
        return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _poured(shape: str, chars: str) -> str:
    """chars in the places of the shape's letters and digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not _is_card(digits):
        return None
    body = f.digits("card", digits[1:-1], back=back)  # the network's first digit stays
    last = next(c for c in "0123456789" if luhn(digits[0] + body + c))
    return _poured(text, digits[0] + body + last)


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return f"{98 - int(number) % 97:02d}"


#: How long an IBAN of a country is.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    flat = text.replace(" ", "").upper()
    if len(flat) != IBAN_LENGTH.get(flat[:2]) or _iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    body = f.word(f"iban{flat[:2]}", flat[4:], back)
    new = _poured(text, flat[:2] + _iban_check(flat[:2], body) + body)
    return "".join(c.lower() if was.islower() else c for was, c in zip(text, new))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    return _poured(text, f.digits("ssn", digits, _ssn_valid, back)) if _ssn_valid(digits) else None


#: Country codes of two digits; those that start with 1 or 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_code(digits: str) -> str:
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGITS else digits[:3]


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    head = country_code(digits) if text.startswith("+") else ""
    if not head and len(digits) != 10:
        return None
    return _poured(text, head + f.digits("phone" + (head or "1"), digits[len(head) :], back=back))


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    v = int.from_bytes(bytes(map(int, parts)), "big")
    left, right = f.halves("ip", v >> 16, v & 0xFFFF, 1 << 16, 1 << 16, back)
    return ".".join(map(str, ((left << 16) | right).to_bytes(4, "big")))


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(f: Feistel, text: str, back: bool) -> str | None:
    a, sep, b, _, c = re.match(r"(\d+)([-./])(\d+)([-./])(\d+)", text).groups()
    orders = ((a, b, c), "ymd") if len(a) == 4 else ((c, b, a), "dmy") if sep == "." or int(a) > 12 else ((c, a, b), "mdy")
    try:
        day = date(*map(int, orders[0]))
    except ValueError:
        return None
    if not 0 <= (n := (day - _FIRST).days) < _DAYS:
        return None
    new = _FIRST + timedelta(f.below("date", n, _DAYS, back=back))
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return sep.join({"ymd": (y, m, d), "dmy": (d, m, y), "mdy": (m, d, y)}[orders[1]])


def _email(f: Feistel, text: str, back: bool) -> str | None:
    name, _, domain = text.rpartition("@")
    label, dot, rest = domain.partition(".")
    return f"{f.word('name', name, back)}@{f.word('domain', label, back)}{dot}{rest}"


KINDS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
_PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+",
    "iban": r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{8,15}(?![\w-])|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])",
}
_OTHERS = "|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items())
_RUN = r"(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-]|\.\d))"
_FIND, _FIND_OTHERS, _FIND_RUN = re.compile(f"{_OTHERS}|{_RUN}"), re.compile(_OTHERS), re.compile(_RUN)
_KIND = {k: re.compile(p) for k, p in _PATTERNS.items()}
_ANY, _WORD = re.compile(r"[0-9@]"), re.compile(r"[^\W_]+|.", re.DOTALL)


def _valid(f: Feistel, kind: str, found: str, back: bool) -> tuple[str, int] | None:
    """The pseudonym of what was found, or of its start, and how many characters of it that replaces."""
    ends = [m.start() for m in re.finditer(" ", found)][::-1] if kind == "iban" else []
    for end in [len(found), *ends]:
        if (new := KINDS[kind](f, found[:end], back)) is not None:
            return new, end
    return None


def _cards_in(text: str) -> list[tuple[int, int]]:
    """Where the cards are in a run of digits and single separators of any length: each run of
    consecutive pieces may be one; the longest come first, of equals the leftmost."""
    pieces = [m.span() for m in re.finditer(r"\d+", text)]
    valid = []
    for i, (start, _) in enumerate(pieces):
        digits = ""
        for a, end in pieces[i:]:
            digits += text[a:end]
            if len(digits) > 19:
                break
            if _is_card(digits):
                valid.append((-len(digits), start, end))
    found: list[tuple[int, int]] = []
    for _, start, end in sorted(valid):
        if all(end <= a or b <= start for a, b in found):
            found.append((start, end))
    return sorted(found)


@lru_cache(maxsize=8)
def feistel(key: bytes) -> Feistel:
    return Feistel(key)


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, int]:
    """The text with pseudonyms, and how many values it holds."""
    if not text or not _ANY.search(text):
        return text, 0
    return _replaced(feistel(key), text, back, _FIND)


def _replaced(f: Feistel, text: str, back: bool, find: re.Pattern) -> tuple[str, int]:
    out, n, at = [], 0, 0
    while m := find.search(text, at):
        out.append(text[at : m.start()])
        kind, run = m.lastgroup, m
        if kind != "card":
            tried = [(kind, m[0]), *((k, x[0]) for k, p in _KIND.items() if k != kind and (x := p.match(text, m.start())))]
            new = next((found for k, s in tried if (found := _valid(f, k, s, back))), None)
            if new is not None:
                out.append(new[0])
                n, at = n + 1, m.start() + new[1]
                continue
            run = _FIND_RUN.match(text, m.start()) if find is _FIND else None
            if run is None:  # on with the next word
                at = _WORD.match(text, m.start()).end()
                out.append(text[m.start() : at])
                continue
        at = run.start()
        for start, end in [*_cards_in(run[0]), (len(run[0]), len(run[0]))]:
            between, found = _replaced(f, text[at : run.start() + start], back, _FIND_OTHERS)
            out.append(between)
            n += found
            if start < end:
                out.append(_card(f, run[0][start:end], back))
                n += 1
            at = run.start() + end
    out.append(text[at:])
    return "".join(out), n


def redact(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_values for each row of docs."""

    ship(docs.sparkSession)

    @F.pandas_udf("text string, n_values long")
    def apply(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pseudonymise(t, key) for t in text], columns=["text", "n_values"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), apply(F.col(f"`{text_col}`")).alias("_r"))
    return rows.select("doc_id", "_r.text", "_r.n_values")
