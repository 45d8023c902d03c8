"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel network.

A value is found by its shape, validated (Luhn, mod 97, calendar, octets,
area numbers), reduced to its digits or letters, and permuted within the set
of values of that format. The permutation depends on the key and the kind
only, so a value that occurs in several documents, written with other
separators or not, keeps one pseudonym everywhere and two values never share
one. Nothing is looked up or stored, so documents are independent.
"""

from __future__ import annotations

import calendar
import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ROUNDS = 8
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


class Feistel:
    """Keyed permutations of the integers below n, one for each kind."""

    def __init__(self, key: bytes):
        self.key = key
        self.below = lru_cache(1 << 16)(self._below)

    def _round(self, kind: str, n: int, r: int, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{n}|{r}|{value}".encode(), key=self.key, digest_size=16).digest())

    def _once(self, kind: str, n: int, a: int, b: int, value: int) -> int:
        """An alternating network over pairs (left below a, right below b)."""
        left, right = divmod(value, b)
        for r in range(0, ROUNDS, 2):
            left = (left + self._round(kind, n, r, right)) % a
            right = (right + self._round(kind, n, r + 1, left)) % b
        return left * b + right

    def _below(self, kind: str, n: int, value: int) -> int:
        """Where the permutation of 0..n-1 takes value: walks on while it is outside."""
        b = max(2, int(n**0.5) + 1)
        a = -(-n // b)
        out = self._once(kind, n, a, b, value)
        while out >= n:
            out = self._once(kind, n, a, b, out)
        return out

    def digits(self, kind: str, text: str) -> str:
        return str(self.below(kind, 10 ** len(text), int(text))).zfill(len(text)) if text else ""

    def letters(self, kind: str, text: str, alphabet: str) -> str:
        value = 0
        for ch in text:
            value = value * len(alphabet) + alphabet.index(ch)
        value = self.below(kind, len(alphabet) ** len(text), value)
        out = []
        for _ in text:
            value, i = divmod(value, len(alphabet))
            out.append(alphabet[i])
        return "".join(reversed(out))


def luhn_digit(body: str) -> int:
    """The check digit that makes body + digit valid."""
    total = 0
    for i, ch in enumerate(reversed(body)):
        d = int(ch) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def refill(shape: str, chars: str) -> str:
    """The characters of `chars` in place of the letters and digits of `shape`."""
    it = iter(chars)
    return "".join(next(it) if ch.isalnum() else ch for ch in shape)


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def card(f: Feistel, s: str) -> str | None:
    """Account numbers: all but the check digit are permuted, and the last keeps its distance from the Luhn digit, so valid numbers stay valid and others stay invalid."""
    d = _digits(s)
    if len(set(d)) == 1:
        return None
    body = f.digits("card", d[:-1])
    return refill(s, body + str((int(d[-1]) - luhn_digit(d[:-1]) + luhn_digit(body)) % 10))


def phone(f: Feistel, s: str) -> str | None:
    """All digits of the subscriber's number after a country code."""
    country = re.match(r"\+\d{1,3}(?=[ (.-])", s)
    head = country.group() if country else ""
    return head + refill(s[len(head) :], f.digits("phone" + head, _digits(s[len(head) :])))


def ssn(f: Feistel, s: str) -> str | None:
    """Nine digits with a possible area (not 000, 666 or 9xx), group and serial."""

    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = _digits(s)
    if not valid(d):
        return None
    d = f.digits("ssn", d)
    while not valid(d):
        d = f.digits("ssn", d)
    return refill(s, d)


def ipv4(f: Feistel, s: str) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    n = f.below("ipv4", 1 << 32, int.from_bytes(bytes(map(int, parts))))
    return ".".join(map(str, n.to_bytes(4)))


def iban(f: Feistel, s: str) -> str | None:
    """Country kept, digits and letters permuted each among themselves, check digits computed anew."""
    raw = s.replace(" ", "")

    def rest(x: str) -> int:
        return int("".join(str(int(ch, 36)) for ch in x)) % 97

    if not 15 <= len(raw) <= 34 or rest(raw[4:] + raw[:4]) != 1:
        return None
    body = raw[4:]
    digits, capitals = f.digits("iban", _digits(body)), re.sub(r"\d", "", body)
    capitals = f.letters("iban", capitals.lower(), LOWER).upper() if capitals else ""
    d, c = iter(digits), iter(capitals)
    body = "".join(next(d) if ch.isdigit() else next(c) for ch in body)
    return refill(s, f"{raw[:2]}{98 - rest(body + raw[:2] + '00'):02d}{body}")


def iso_date(f: Feistel, s: str) -> str | None:
    return _date(f, s, (0, 1, 2))


def day_first(f: Feistel, s: str) -> str | None:
    return _date(f, s, (2, 1, 0)) or _date(f, s, (2, 0, 1))


def _date(f: Feistel, s: str, order: tuple[int, int, int]) -> str | None:
    """A real calendar day, as another day in the same notation."""
    parts, marks = re.findall(r"\d+", s), re.findall(r"\D+", s)
    y, m, d = (int(parts[i]) for i in order)
    if not (FIRST_DAY.year <= y <= LAST_DAY.year and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    n = (LAST_DAY - FIRST_DAY).days + 1
    new = FIRST_DAY + timedelta(f.below("date", n, (date(y, m, d) - FIRST_DAY).days))
    for i, v in zip(order, (new.year, new.month, new.day)):
        parts[i] = str(v).zfill(len(parts[i]))
    return parts[0] + "".join(a + b for a, b in zip(marks, parts[1:]))


def email(f: Feistel, s: str) -> str | None:
    """Letters and digits of the local part, case kept; the host stays."""
    local, host = s.rsplit("@", 1)
    out = _mixed(f, "email@" + host.lower(), local)
    return f"{out}@{host}"


def secret(f: Feistel, s: str) -> str | None:
    """Long hexadecimal keys, upper or lower case."""
    if not (re.search(r"\d", s) and re.search(r"[a-fA-F]", s)):
        return None
    new = f.letters("hex", s.lower(), HEX)
    return new.upper() if s.isupper() else new


def _mixed(f: Feistel, kind: str, s: str) -> str:
    letters = "".join(ch for ch in s if ch.isascii() and ch.isalpha()).lower()
    digits = "".join(ch for ch in s if ch in DIGITS)
    a = iter(f.letters(kind + f"|{len(digits)}|{digits}", letters, LOWER) if letters else "")
    b = iter(f.digits(kind, digits) if digits else "")
    return "".join((next(a).upper() if ch.isupper() else next(a)) if ch.isascii() and ch.isalpha() else next(b) if ch in DIGITS else ch for ch in s)


#: Kind, shape and replacement; a place belongs to the first kind in this order whose value is valid.
KINDS: list[tuple[str, str, Callable[[Feistel, str], str | None]]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])", secret),
    ("phone", r"(?<![\w+])\+[0-9]{1,3} ?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])", phone),
    ("phone", r"(?<![\w+(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![\w+.-])[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9A-Za-z])", phone),
    ("date", r"(?<![\w.-])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![\w-])", iso_date),
    ("date", r"(?<![\w.-])[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}(?![\w-])", day_first),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    ("ipv4", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])", ipv4),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])", card),
]
_KINDS = [(k, re.compile(p), f) for k, p, f in KINDS]
_HINT = re.compile("[0-9@]")


def find(text: str) -> list[tuple[int, int, str, Callable]]:
    """Places (start, end, kind, replacement) in a text by shape, possibly overlapping, in the order of KINDS."""
    return [(m.start(), m.end(), kind, f) for kind, p, f in _KINDS for m in p.finditer(text)]


def pseudonymise(text: str, f: Feistel) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with every valid value replaced, and (start, end, kind, pseudonym) of each in the original text."""
    if not _HINT.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    marked = bytearray(len(text))
    for a, b, kind, make in find(text):
        if marked.find(1, a, b) < 0 and (new := make(f, text[a:b])) is not None:
            taken.append((a, b, kind, new))
            marked[a:b] = b"\1" * (b - a)
    taken.sort()
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], taken


def replace_personal(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (pseudonymised), n_found, found (array of start, end, kind, pseudonym).

    Other columns are ignored. A null text stays null with nothing found; an
    empty one stays empty; equal rows give equal rows; null ids are kept.
    """
    schema = "doc_id long, text string, n_found int, found array<struct<start:int,end:int,kind:string,pseudonym:string>>"
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for b in slices(batches):
            done = [(None, []) if t is None else pseudonymise(t, f) for t in b.column(1).to_pylist()]
            found = [[dict(zip(("start", "end", "kind", "pseudonym"), x)) for x in d[1]] for d in done]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(item))], names=["doc_id", "text", "n_found", "found"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def replace_in_place(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with the same columns and rows, the text pseudonymised; null and empty texts stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for b in slices(batches, text_col):
            new = [None if t is None else pseudonymise(t, f)[0] for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
