"""Personal data and secrets replaced by format-preserving pseudonyms.

Numbers, dates and addresses are found by pattern and validated (Luhn, mod 97, calendar, octets).  Phones are found by their
shape: +country code (or 00 and a gap) with 7 to 15 digits, three, three and four digits, or a trunk 0 with groups; digits
without any of these are not phones.  A valid
value is written as a number below the size of its kind's domain and permuted there by a keyed Feistel network:
two unequal halves of the domain, ten rounds of blake2b, and cycle-walking where the halves' product is larger than
the domain.  The result is written back in the value's own format, separators included, so it is valid again,
equal values get equal pseudonyms in all documents and formats, and different values different ones.

kinds: card, ssn, phone, ip (both versions), iban, date, email (local part and host up to its last label; read without
case, so John@x.com and john@x.com are linked), secret (access keys of known forms, the body of private-key blocks; values of at least
six characters after password, passwd, pwd, secret, token or api key and = or :, the name alone or a part between
underscores or hyphens; after `is` only a value with a digit).  A secret's value goes up to its closing quote, without one up to white space, however long it is;
letters and digits are replaced, other characters stay.  Dates are read year first, day first with dots, and with slashes or
hyphens month first where that is a date, else day first; the new date is written in the same order, without leading zeros where
the old one had none.  Null text stays null with nothing found.  Rows are independent: repeated rows, null ids and
further columns change nothing; an empty table gives an empty table.  The key is the caller's secret: a
permutation can be undone with it, and values can't be linked with those under another key.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROUNDS = 10
#: Longer texts are permuted in pieces of this many characters, chained in both directions.
_PIECE = 128
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

_PATTERN = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))
|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\ [A-Z0-9]{4}){2,7}(?:\ [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))
|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-]))
|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
|(?P<ip6>(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![0-9A-Za-z:]))
|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|3[47][0-9]{2}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5})(?![0-9]))
|(?P<phone>(?<![0-9A-Za-z+])(?:
  (?:\+1[\ .-]?|(?<![0-9][\ .-])1[\ .-])?(?:\([0-9]{3}\)[\ .-]?|[0-9]{3}[\ .-])[0-9]{3}[\ .-][0-9]{4}(?![0-9])
  |(?:\+|00(?=[1-9][0-9]{0,2}[\ .(-]))(?:[1-9][0-9]{0,2}[\ .-]?(?:\(0\)[\ .-]?[0-9](?:[\ .-]?[0-9]){5,11}|\([0-9]{1,5}\)(?:[\ .-]?[0-9]){4,8})|[1-9](?:[\ .-]?[0-9]){6,14})(?![0-9]|[.-][0-9])
  |(?:\(0[1-9][0-9]{0,4}\)[\ .-]?[0-9](?:[\ -]?[0-9]){4,8}|0[1-9][0-9]{0,3}(?P<gap3>[\ /-])[0-9]{2}(?:(?P=gap3)?[0-9]){5,8})(?![0-9]|[.-][0-9])))
|(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))
|(?P<vendor>(?<![A-Za-z0-9_])(?:gh[opsur]_|github_pat_|glpat-|[sr]k_(?:live|test)_|xox[abeprs]-|AIza|npm_|hf_|sk-(?=[A-Za-z0-9_-]{0,12}[A-Za-z0-9]{20}))(?P<token>[A-Za-z0-9_-]{16,}+))
|(?P<block>-----BEGIN\ (?:[A-Z]{1,20}\ ){0,3}PRIVATE\ KEY(?:\ BLOCK)?-----(?P<body>[^-]++(?:-(?!----END)[^-]*+)*+)-----END)
|(?P<said>(?<![A-Za-z0-9_-])(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key)\ (?i:is)[:]?\ ["']?(?P<value>(?=[^\s"']{0,64}[0-9])[^\s"'.,;]{6,}+))
|(?P<named>(?<![A-Za-z0-9_-])[_-]*+(?i:(?:[A-Za-z0-9]++[_-]++)*?(?:password|passwd|pwd|secret|token|api[_-]?key)(?:[_-]++[A-Za-z0-9]++)*+)[_-]*+["']?[\ \t]{0,8}[=:][\ \t]{0,8})
  (?:"(?P<double>(?:\\.|[^"\\\r\n]){6,}+)"|'(?P<single>(?:\\.|[^'\\\r\n]){6,}+)'|["']?(?P<bare>(?:[^\s"']|["'](?=[A-Za-z0-9])){6,}+))""",
    re.VERBOSE | re.ASCII,
)
_TEN = re.compile(r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_TWO_DIGIT_COUNTRIES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_WORTH = re.compile(r"[0-9@]|::|(?i:passw|pwd|secret|token|key)")


class Feistel:
    """Keyed permutations of range(n) for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, i: int, x: int) -> int:
        size = max(16, (n.bit_length() + 7) // 8 + 8)
        seed = hashlib.blake2b(f"{kind}|{n}|{i}|{x}".encode(), key=self.key, digest_size=min(64, size)).digest()
        if size > 64:
            seed = hashlib.shake_256(seed).digest(size)
        return int.from_bytes(seed, "big")

    def permute(self, kind: str, x: int, n: int, back: bool = False) -> int:
        """A bijection of range(n); back undoes it."""
        if n < 2:
            return x
        a = 1 << ((n - 1).bit_length() + 1) // 2
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            rounds = range(_ROUNDS)
            for i in reversed(rounds) if back else rounds:
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(kind, n, i, left)) % b
                else:
                    left = (left + sign * self._round(kind, n, i, right)) % a
            x = left * b + right
            if x < n:
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


@functools.cache
def _alike(c: str) -> str:
    """Letters and digits of the same block of 128 characters and the same case; other characters are alone."""
    if not c.isalnum():
        return c
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if x.isalnum() and x.islower() == c.islower())


def _mixed(f: Feistel, kind: str, text: str) -> str:
    """Every letter and digit within its own class, all places permuted together."""
    hexes = kind == "secret" and all(c in "0123456789abcdef" for c in text)
    classes = [("0123456789abcdef" if hexes else "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isascii() and c.isalnum() else _alike(c) for c in text]
    starts = range(0, max(1, len(text)), _PIECE)
    pieces = [text[i : i + _PIECE] for i in starts]
    for way in ((1, -1) if len(pieces) > 1 else (0,)):  # each piece hangs on all before it, then on all behind it
        chain = hashlib.blake2b(key=f.key, digest_size=16)
        for j in range(len(pieces))[:: way or 1]:
            tag = f"{kind}|{way}{chain.hexdigest()}" if way else kind
            pieces[j] = _piece(f, tag, pieces[j], classes[starts[j] : starts[j] + _PIECE])
            chain.update(pieces[j].encode())
    return "".join(pieces)


def _piece(f: Feistel, kind: str, text: str, classes: list[str]) -> str:
    x, n = 0, 1
    for c, allowed in zip(text, classes, strict=True):
        x, n = x * len(allowed) + allowed.index(c), n * len(allowed)
    y, out = f.permute(f"{kind}|{'|'.join(str(len(c)) + c[0] for c in classes)}", x, n), []
    for allowed in reversed(classes):
        y, place = divmod(y, len(allowed))
        out.append(allowed[place])
    return "".join(reversed(out))


def _card(f: Feistel, s: str) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    middle = len(d) - 2
    payload = d[0] + str(f.permute("card", int(d[1:-1]), 10**middle)).zfill(middle)
    return _refill(s, payload + luhn_digit(payload))


def _ssn(f: Feistel, s: str) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.permute("ssn", x, 898 * 99 * 9999), 9999)
    area, group = divmod(x, 99)
    area += 1 + (area >= 665)
    return f"{area:03}-{group + 1:02}-{serial + 1:04}"


def _north_american(d: str) -> bool:
    return d[0] > "1" and d[3] > "1"


def _phone_digits(f: Feistel, country: str, d: str) -> str:
    """The digits after the country code (0 for a trunk prefix): ten of the North American plan stay in or out of it, others keep their leading zeros."""
    if country == "1" and len(d) == 10:
        if _north_american(d):
            x = (int(d[:3]) - 200) * 800 + int(d[3:6]) - 200
            x, line = divmod(f.permute("phone", x * 10000 + int(d[6:]), 800 * 800 * 10000), 10000)
            area, exchange = divmod(x, 800)
            return f"{area + 200:03}{exchange + 200:03}{line:04}"
        while True:  # walks the cycle to the next number outside the plan
            d = f"{f.permute('phone|other', int(d), 10**10):010}"
            if not _north_american(d):
                return d
    rest = d.lstrip("0")
    if not rest:
        return d
    least = 10 ** (len(rest) - 1)
    return d[: len(d) - len(rest)] + str(f.permute(f"phone|{country}|{len(d)}", int(rest) - least, 9 * least) + least)


def _phone(f: Feistel, s: str) -> str | None:
    d = _digits(s)
    if s[0] == "+" or s.startswith("00"):
        lead = 0 if s[0] == "+" else 2
        size = 1 if d[lead] in "17" else 2 if d[lead : lead + 2] in _TWO_DIGIT_COUNTRIES else 3
        country, head = d[lead : lead + size], lead + size
        if "(0)" in s and d[head] == "0":  # the trunk prefix isn't part of the number
            head += 1
    elif d[0] == "0" and not _TEN.fullmatch(s):
        country, head = "0", 1
    else:
        country, head = "1", len(d) - 10
    return _refill(s, d[:head] + _phone_digits(f, country, d[head:]))


def _ip(f: Feistel, s: str) -> str | None:
    parts = s.split(".")
    octets = [int(x) for x in parts]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in parts) or not octets[0]:
        return None
    x = f.permute("ip", int.from_bytes(bytes(octets), "big") - (1 << 24), 255 << 24) + (1 << 24)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(f: Feistel, s: str) -> str | None:
    flat = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _mixed(f, "iban" + flat[:2], flat[4:])
    fresh = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02}" + body
    left = iter(fresh)
    return "".join(c if c == " " else next(left) for c in s)


def _ip6(f: Feistel, s: str) -> str | None:
    """Its written form stays; without case, so both are linked."""
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return None
    digits = "".join(c for c in s.lower() if c != ":")
    if len(digits) < 8:  # names between colons rather than an address, or one that says nothing of anybody
        return None
    while True:  # a group's first digit isn't 0 where it wasn't, so the form stays
        digits = _mixed(f, "secret", digits)
        left = iter(digits)
        new = "".join(c if c == ":" else next(left) for c in s)
        if all((a[:1] == "0") == (b[:1] == "0") or len(a) == 1 for a, b in zip(s.split(":"), new.split(":"), strict=True)):
            return new.upper() if s.isupper() else new


def _date(f: Feistel, s: str) -> str | None:
    sign = re.search(r"[-/.]", s)[0]
    parts = s.split(sign)
    a, b, c = map(int, parts)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0)] if sign == "." else [(2, 0, 1), (2, 1, 0)]  # places of year, month, day
    for order in orders:
        year, month, day = ((a, b, c)[i] for i in order)
        try:
            x = datetime.date(year, month, day).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= x < _DAYS:
            continue
        short = any(len(p) == 1 for p in parts)
        new = datetime.date.fromordinal(f.permute("date", x, _DAYS) + _FIRST_DAY)
        fresh = [""] * 3
        for place, value in zip(order, (f"{new.year:04}", new.month, new.day), strict=True):
            fresh[place] = value if isinstance(value, str) else f"{value}" if short else f"{value:02}"
        return sign.join(fresh)
    return None


def _in_case(new: str, shape: str) -> str:
    return "".join(x.upper() if c.isupper() else x for x, c in zip(new, shape, strict=True))


def _email(f: Feistel, s: str) -> str | None:
    local, _, host = s.partition("@")
    name, _, last = host.rpartition(".")
    fresh = _in_case(_mixed(f, "email|" + host.lower(), local.lower()), local)
    return f"{fresh}@{_in_case(_mixed(f, 'host|' + last.lower(), name.lower()), name)}.{last}"


_BY_KIND: dict[str, Callable[[Feistel, str], str | None]] = {"card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "ip6": _ip6, "iban": _iban, "date": _date, "email": _email}
KINDS = tuple(k for k in _BY_KIND if k != "ip6")


def pseudonymize(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of what was found, by places in the given text."""
    if not _WORTH.search(text):
        return text, []
    found, out, at, place = [], [], 0, 0
    while (m := _PATTERN.search(text, place)) is not None:
        start, end = m.span()
        if m["named"] is not None:
            kind, (start, end) = "secret", next(m.span(g) for g in ("double", "single", "bare") if m[g] is not None)
            new = _mixed(f, "secret", text[start:end]) if any(map(str.isalnum, text[start:end])) else None
        elif m["said"] is not None:
            kind, (start, end) = "secret", m.span("value")
            new = _mixed(f, "secret", text[start:end])
        elif m["block"] is not None:
            kind, (start, end) = "secret", m.span("body")
            new = _mixed(f, "secret", text[start:end]) if any(map(str.isalnum, text[start:end])) else None
        elif m["vendor"] is not None:
            kind, (start, end) = "secret", m.span("token")
            new = _mixed(f, "secret", text[start:end])
        elif m["aws"] is not None:
            kind, new = "secret", m["aws"][:4] + _mixed(f, "secret", m["aws"][4:])
        else:
            kind = next(k for k in _BY_KIND if m[k] is not None)
            new = _BY_KIND[kind](f, m[0])
            kind = "ip" if kind == "ip6" else kind
        if new is None:  # not valid: what begins inside may be
            place = m.start() + 1
            continue
        found.append((kind, start, end, new))
        out += [text[at:start], new]
        at = end
        place = max(end, m.end()) if m["block"] is None else end
    return "".join([*out, text[at:]]), found


_SPANS = "array<struct<kind:string,start:int,end:int,pseudonym:string>>"


def protect(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, clean text, and spans (kind, start, end in the given text, pseudonym)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(secret)
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                done = [(None, []) if t is None else pseudonymize(t, f) for t in part.column(1).to_pylist()]
                rows = [[dict(zip(("kind", "start", "end", "pseudonym"), x, strict=True)) for x in d[1]] for d in done]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.string()), pa.array(rows, spans)], names=[key, "clean", "spans"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, clean string, spans {_SPANS}")
