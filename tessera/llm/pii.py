"""Format-preserving pseudonyms for validated numbers, addresses and dates.

A candidate is found by its shape and taken only if it is valid (Luhn digit,
IBAN check digits, calendar, number plan, octets). Its value is a number in
the format's domain; a keyed Feistel network permutes that domain (values that
leave it are walked on), and the result is written in the same format with
check digits made anew. The permutation depends on key and kind alone, so equal
values get equal pseudonyms in every document, and different ones stay apart.

Narrow: no shuffle, no state. Equal dates (or cards, phones) in different
spellings share one pseudonym, each in its spelling.

Defined cases: null stays null, a text without a valid value is returned
unchanged; overlapping candidates are taken from the left, the first kind in
the order of ``PATTERN`` winning. Letters are permuted within their case.

Dates are taken as 1980-02-28 (also in front of a time, T10:00), 1980/02/28,
28.2.1980, 28/2/1980, 28-2-1980, and with English month names: 28 February
1980, 28th Feb 1980, February 28, 1980. Not taken: years of two digits, dates
without a year, 1980.02.28 (a version number as often as a date), month names
of other languages. IPv6 addresses are taken in the global range (2000::/3),
link-local (fe80::/16) and private (fc00::/7) ones within their first group; the result
is in the usual short spelling. Numbers with 00 for + need a separator, as
plain digits may be any number.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytescan import flat, pieces

DEMO_KEY = b"tessera-demo-key"
ROUNDS = 10
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + "|Sept)"

#: Shapes, first match wins. Validity is checked afterwards.
PATTERN = re.compile(r"""
  (?P<email>(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))
 |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
 |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
 |(?P<ip6>(?=[23Ff])(?<![\w:.])(?:[23][0-9A-Fa-f]{3}|[Ff](?:[Ee]80|[CcDd][0-9A-Fa-f]{2}))(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:]|\.\d))
 |(?P<ymd>(?<![\w-])\d{4}-\d{2}-\d{2}(?:(?=T\d{2}:?\d{2})|(?![\w]|-\d)))
 |(?P<ysd>(?<![\w/.-])\d{4}/\d{1,2}/\d{1,2}(?![\w/]|[.-]\d))
 |(?P<dhy>(?<![\w./-])\d{1,2}-\d{1,2}-\d{4}(?![\w]|[./-]\d))
 |(?P<dayname>(?<![\w./-])\d{1,2}(?i:st|nd|rd|th)?[ ]MONTH\.?,?[ ]\d{4}(?!\w))
 |(?P<nameday>(?<!\w)(?=[JFMASONDjfmasond][A-Za-z]{2,8}\.?[ ]\d)MONTH\.?[ ]\d{1,2}(?i:st|nd|rd|th)?,?[ ]\d{4}(?!\w))
 |(?P<dmy>(?<![\w./])\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?![\w]|[./]\d))
 |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d))
 |(?P<phone>(?<![\w.-])(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w]|-\d))
 |(?P<intl>(?<![\w.-])\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}(?![\w]|-\d))
 |(?P<out>(?<![\w.-])(?<!\d[ ])00[1-9]\d{0,2}(?:[ .-]?\d{2,5}){2,5}(?![\w]|-\d))
 |(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w]|-\d))
""".replace("MONTH", _MONTH), re.VERBOSE | re.ASCII)
MAYBE = re.compile("[0-9@]")
PIECE = 1 << 20     # bytes of text that a worker holds as Python objects at once
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of 0 .. size - 1."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _f(self, tag: bytes, r: int, x: int) -> int:
        h = hashlib.blake2b(b"%s|%d|%d" % (tag, r, x), key=self.key, digest_size=24)
        return int.from_bytes(h.digest(), "big")

    def permute(self, tag: str, x: int, size: int) -> int:
        """Unbalanced halves a x b >= size; values outside are walked on."""
        t = f"{tag}|{size}".encode()
        a = 1 << -(-size.bit_length() // 2)
        b = -(-size // a)
        while True:
            left, right = x % a, x // a
            for r in range(0, ROUNDS, 2):
                left = (left + self._f(t, r, right)) % a
                right = (right + self._f(t, r + 1, left)) % b
            x = left + a * right
            if x < size:
                return x

    def undo(self, tag: str, x: int, size: int) -> int:
        """The inverse of ``permute``."""
        t = f"{tag}|{size}".encode()
        a = 1 << -(-size.bit_length() // 2)
        b = -(-size // a)
        while True:
            left, right = x % a, x // a
            for r in range(ROUNDS - 2, -1, -2):
                right = (right - self._f(t, r + 1, left)) % b
                left = (left - self._f(t, r, right)) % a
            x = left + a * right
            if x < size:
                return x


Step = Callable[[str, int, int], int]


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """Digits of ``shape`` replaced in order; other characters stay."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _mixed(step: Step, tag: str, chars: str, shape: str) -> str:
    """Permute a string of digits and letters within its character classes."""
    size, x = 1, 0
    alphabets = [("0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz")
                 for c in chars]
    for c, al in zip(chars, alphabets):
        x = x * len(al) + al.index(c)
        size *= len(al)
    y = step(f"{tag}|{shape}", x, size)
    out = []
    for al in reversed(alphabets):
        y, r = divmod(y, len(al))
        out.append(al[r])
    return "".join(reversed(out))


def _classes(s: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" for c in s)


def _card(v: str, step: Step) -> str | None:
    d = re.sub(r"\D", "", v)
    if not 13 <= len(d) <= 19 or len(set(d)) < 2 or (" " in v and "-" in v) or int(d[-1]) != luhn_digit(d[:-1]):
        return None
    # the first digit (the network) stays, the rest is permuted
    n = len(d) - 2
    body = d[0] + str(step(f"card|{d[0]}", int(d[1:-1]), 10 ** n)).zfill(n)
    return _refill(v, body + str(luhn_digit(body)))


def _iban_check(country: str, bban: str) -> int:
    digits = "".join(str(int(c, 36)) for c in bban + country + "00")
    return 98 - int(digits) % 97


def _iban(v: str, step: Step) -> str | None:
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or int(s[2:4]) != _iban_check(s[:2], s[4:]):
        return None
    bban = _mixed(step, "iban", s[4:], s[:2] + _classes(s[4:]))
    new = iter(f"{s[:2]}{_iban_check(s[:2], bban):02d}{bban}")
    return "".join(c if c == " " else next(new) for c in v)


def _email(v: str, step: Step) -> str | None:
    local, domain = v.split("@")
    body = re.sub(r"[^A-Za-z0-9]", "", local)
    new = iter(_mixed(step, "email", body, domain.lower() + "|" + _classes(body)))
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in local) + "@" + domain


def _ip(v: str, step: Step) -> str | None:
    o = [int(p) for p in v.split(".")]
    if max(o) > 255 or not 1 <= o[0] <= 223 or any(len(p) > 1 and p[0] == "0" for p in v.split(".")):
        return None
    x = step("ip", ((o[0] - 1) * 256 + o[1]) * 65536 + o[2] * 256 + o[3], 223 * 2**24)
    return f"{x // 2**24 + 1}.{x // 2**16 % 256}.{x // 256 % 256}.{x % 256}"


def _ip6(v: str, step: Step) -> str | None:
    try:
        old = int(ipaddress.IPv6Address(v))
    except ValueError:
        return None
    if not re.search("[0-9]", v):
        return None
    bits = 125 if old >> 125 == 1 else 112              # the range, or the first group, stays
    x = old >> bits << bits | step(f"ip6|{old >> bits}", old & ((1 << bits) - 1), 1 << bits)
    new = str(ipaddress.IPv6Address(x))
    return new.upper() if re.search("[A-F]", v) else new


def _day(y: int, m: int, d: int, step: Step) -> dt.date | None:
    try:
        day = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    return dt.date.fromordinal(FIRST_DAY + step("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))


def _ymd(v: str, step: Step) -> str | None:
    new = _day(int(v[:4]), int(v[5:7]), int(v[8:]), step)
    return new and new.isoformat()


def _ysd(v: str, step: Step) -> str | None:
    y, m, d = v.split("/")
    new = _day(int(y), int(m), int(d), step)
    return new and "/".join([str(new.year), *(f"{x:02d}" if len(old) == 2 else str(x) for x, old in ((new.month, m), (new.day, d)))])


def _named(v: str, step: Step) -> str | None:
    """Month names keep their length (short or full) and case, days their
    ordinal endings."""
    words = re.findall(r"[A-Za-z]+|\d+|[^A-Za-z\d]+", v)
    at = next(i for i, w in enumerate(words) if w[:3].title() in {m[:3] for m in MONTHS})
    nums = [i for i, w in enumerate(words) if w.isdigit()]
    name, day = words[at], words[nums[0]]
    new = _day(int(words[nums[1]]), [m[:3] for m in MONTHS].index(name[:3].title()) + 1, int(day), step)
    if new is None:
        return None
    full = MONTHS[new.month - 1]
    full = full if name.title() in MONTHS else full[:3]
    words[at] = full.upper() if name.isupper() else full.lower() if name.islower() else full
    words[nums[0]] = f"{new.day:02d}" if len(day) == 2 else str(new.day)
    end = words[nums[0] + 1]
    if end.lower() in ("st", "nd", "rd", "th"):
        right = "th" if new.day // 10 == 1 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
        words[nums[0]] = str(new.day)
        words[nums[0] + 1] = right.upper() if end.isupper() else right
    words[nums[1]] = str(new.year)
    return "".join(words)


def _dmy(v: str, step: Step) -> str | None:
    """Day first; month first where only that is a date."""
    a, sep, b, _, y = re.split(r"([./-])", v)
    if new := _day(int(y), int(b), int(a), step):
        a, b = (f"{x:02d}" if len(old) == 2 else str(x) for x, old in ((new.day, a), (new.month, b)))
    elif new := _day(int(y), int(a), int(b), step):
        a, b = (f"{x:02d}" if len(old) == 2 else str(x) for x, old in ((new.month, a), (new.day, b)))
    return new and f"{a}{sep}{b}{sep}{new.year}"


def _ssn(v: str, step: Step) -> str | None:
    a, g, s = int(v[:3]), int(v[4:6]), int(v[7:])
    if a in (0, 666) or a >= 900 or not g or not s:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    x = step("ssn", (areas.index(a) * 99 + g - 1) * 9999 + s - 1, len(areas) * 99 * 9999)
    return f"{areas[x // (99 * 9999)]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def _phone(v: str, step: Step) -> str | None:
    d = re.sub(r"\D", "", v)
    head, d = d[:-10], d[-10:]
    if d[0] in "01" or d[3] in "01":
        return None
    x = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:])
    x = step("phone", x, 800 * 800 * 10_000)
    return _refill(v, f"{head}{x // 8_000_000 + 200}{x // 10_000 % 800 + 200}{x % 10_000:04d}")


def _intl(v: str, step: Step) -> str | None:
    d = re.sub(r"\D", "", v)
    if not 8 <= len(d) <= 15 or d[0] == "0":
        return None
    n = len(d) - 2                             # the first two digits (calling code) stay
    return _refill(v, d[:2] + str(step(f"intl|{d[:2]}", int(d[2:]), 10 ** n)).zfill(n))


def _out(v: str, step: Step) -> str | None:
    """00 in place of +: the same pseudonym as the number with +."""
    new = _intl(v[2:], step) if re.search("[ .-]", v) else None
    return new and "00" + new


KINDS = {"email": _email, "iban": _iban, "ip": _ip, "ip6": _ip6, "ymd": _ymd, "ysd": _ysd, "dhy": _dmy, "dayname": _named,
         "nameday": _named, "dmy": _dmy, "ssn": _ssn, "phone": _phone, "intl": _intl, "out": _out, "card": _card}


def pseudonymise(text: str, step: Step) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with every valid value replaced, and (kind, start, end,
    pseudonym) of each, in places of the given text."""
    if not MAYBE.search(text):
        return text, []
    out, found, done, pos = [], [], 0, 0
    while m := PATTERN.search(text, pos):
        kind, v = m.lastgroup if m.lastgroup != "sep" else "dmy", m.group()
        # a number behind a card or account may have been taken for its last group
        cuts = [m.end() - m.start(), *(c.start() for c in list(re.finditer("[ -]", v))[::-1])] if kind in ("card", "iban") else [len(v)]
        if kind == "ip6" and v.endswith(":"):  # a colon of the sentence
            cuts.append(len(v) - 1)
        if kind == "card":                     # the usual lengths first
            cuts.sort(key=lambda c: sum(x.isdigit() for x in v[:c]) not in (15, 16))
        new = None
        for cut in cuts:
            if new := KINDS[kind](v[:cut], step):
                v = v[:cut]
                break
        if new is None:                        # not valid: look again behind its first run of digits or letters
            pos = m.start() + max(1, len(re.match(r"\w*", v).group()))
            continue
        out += [text[done:m.start()], new]
        found.append((kind, m.start(), m.start() + len(v), new))
        done = pos = m.start() + len(v)
    return "".join([*out, text[done:]]), found


def pseudonymise_table(docs: DataFrame, text_col: str = "text", key: bytes = DEMO_KEY,
                       found_col: str = "pii") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` pseudonymised, and
    ``found_col``: kind, start, end and pseudonym of each value."""
    entity = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                           T.StructField("end", T.IntegerType()), T.StructField("pseudonym", T.StringType())])
    entity_arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
    names = [c for c in docs.columns if c != found_col]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(found_col, T.ArrayType(entity))])
    at = names.index(text_col)
    net = Feistel(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, j - i) for whole in batches for i, j in pieces(flat(whole.column(at))[1], PIECE)):
            texts, found = [], []
            for t in b.column(at).to_pylist():
                t, f = (t, []) if t is None else pseudonymise(t, net.permute)
                texts.append(t)
                found.append([dict(zip(("kind", "start", "end", "pseudonym"), x)) for x in f])
            cols = [b.column(c) if c != at else pa.array(texts, pa.string()) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, entity_arrow)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)
