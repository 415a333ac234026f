"""Format-preserving pseudonyms for personal data.

Each value found is *validated* first (card numbers by prefix and check digit,
bank account numbers by their check digits, social security numbers by their
number ranges, IP addresses by their octets, dates by the calendar, phone
numbers by length), so digit runs that only look alike stay as they are. A valid
value is read as an integer of its format's domain, run through a keyed Feistel
permutation of that domain (cycle walking keeps it inside), and written back in
the same layout; check digits are made valid again. The permutation depends only
on the key and the format, so equal values get equal pseudonyms in every
document, different values different ones, and the holder of the key can invert
it. E-mail addresses and long hexadecimal secrets are permuted the same way over
their letters and digits.

A pattern takes the longest run, which may hold more than the value. So the shorter
ends of a card, account or phone number are tried too: cards by the usual lengths
of their first digit, then from long to short (Luhn); accounts by the length of their
country, then from long to short; phones by the length of their country and never
into a card, address, date or social security number behind them. Where no end is
valid, the other kinds and then the later starts in the run get their turn. The order
depends on layout, first digit and country only, which the pseudonym keeps; still,
text behind a new value may by chance make another end valid, and then only the value,
not the whole text, is inverted.

Defined results: a null text stays null, an empty one empty, nothing is cut from
long ones; repeated rows get the same result; an empty table gives an empty one;
all other columns pass through (``n_pii`` and ``pii_kinds`` are replaced). Overlaps go
to the value that starts first (ties: the order of ``KINDS``).
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from mlqa.llm import textkernels as tk

ROUNDS = 10


class Feistel:
    """Keyed permutation of ``range(size)``; ``tweak`` names the format."""

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.base = hashlib.blake2b(tweak.encode() + b"|" + str(size).encode(), key=key[:64], digest_size=32).digest()

    def _round(self, r: int, x: int) -> int:
        raw = x.to_bytes((self.half + 7) // 8, "big")
        out = b""
        while len(out) * 8 < self.half:
            out += hashlib.blake2b(bytes([r, len(out) & 255]) + raw, key=self.base, digest_size=32).digest()
        return int.from_bytes(out, "big") & self.mask

    def _once(self, x: int, order) -> int:
        left, right = x >> self.half, x & self.mask
        for r in order:
            left, right = right, left ^ self._round(r, right)
        return (right << self.half) | left

    def forward(self, x: int) -> int:
        y = self._once(x, range(ROUNDS))
        while y >= self.size:  # cycle walking: stays a permutation of the domain
            y = self._once(y, range(ROUNDS))
        return y

    def inverse(self, y: int) -> int:
        # swapping the halves of the output turns the network around
        x = self._once(y, range(ROUNDS - 1, -1, -1))
        while x >= self.size:
            x = self._once(x, range(ROUNDS - 1, -1, -1))
        return x


def luhn_digit(payload: str) -> int:
    """Check digit that makes payload + digit valid."""
    total = 0
    for i, ch in enumerate(reversed(payload)):
        d = int(ch)
        if i % 2 == 0:
            d = d * 2 - 9 * (d > 4)
        total += d
    return -total % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonyms:
    """Finds, validates and permutes values; one object per task."""

    def __init__(self, key: str, backwards: bool = False) -> None:
        self.key = hashlib.sha256(key.encode()).digest()
        self.back = backwards
        self.boxes: dict = {}

    def permute(self, tweak: str, size: int, x: int) -> int:
        box = self.boxes.get((tweak, size))
        if box is None:
            if len(self.boxes) > 10_000:
                self.boxes.clear()
            box = self.boxes[(tweak, size)] = Feistel(self.key, tweak, size)
        return box.inverse(x) if self.back else box.forward(x)

    def digits(self, tweak: str, s: str) -> str:
        """Permute the digits of ``s``; everything else stays in place."""
        d = re.sub(r"[^0-9]", "", s)
        if not d:
            return s
        new = iter(str(self.permute(tweak, 10 ** len(d), int(d))).zfill(len(d)))
        return "".join(next(new) if "0" <= ch <= "9" else ch for ch in s)

    def alnum(self, tweak: str, s: str) -> str:
        """Permute ASCII letters among letters (case stays) and digits among digits."""
        size, value, shape = 1, 0, []
        for ch in s:
            c = ch.lower() if ch.isascii() else ch
            base, digit = (26, ord(c) - 97) if "a" <= c <= "z" else (10, ord(c) - 48) if "0" <= c <= "9" else (1, 0)
            shape.append(base)
            value, size = value * base + digit, size * base
        if size == 1:
            return s
        value = self.permute(f"{tweak}:{''.join('a' if b == 26 else '9' if b == 10 else '-' for b in shape)}", size, value)
        out = []
        for ch, base in zip(reversed(s), reversed(shape)):
            value, digit = divmod(value, base)
            new = ch if base == 1 else chr(97 + digit) if base == 26 else chr(48 + digit)
            out.append(new.upper() if base == 26 and ch.isupper() else new)
        return "".join(reversed(out))

    # one method per kind: the pseudonym, or None for a value that is not valid

    def email(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        name, dot, suffix = domain.rpartition(".")
        return f"{self.alnum('email', local)}@{self.alnum('domain', name)}{dot}{suffix}"

    def secret(self, s: str) -> str | None:
        if s.isdigit() or s.isalpha():
            return None
        low = s.lower()
        parts = [low[k:k + HEX_PART] for k in range(0, len(low), HEX_PART)]
        new = "".join(format(self.permute("hex", 16 ** len(x), int(x, 16)), f"0{len(x)}x") for x in parts)
        return new.upper() if s.isupper() else new

    def iban(self, s: str) -> str | None:
        raw = s.replace(" ", "").upper()
        if not 15 <= len(raw) <= 34 or iban_rest(raw) != 1:
            return None
        bban = self.alnum("iban" + raw[:2], raw[4:])
        new = iter(raw[:2] + str(98 - iban_rest(raw[:2] + "00" + bban)).zfill(2) + bban)
        return "".join(ch if ch == " " else next(new) for ch in s)

    def card(self, s: str) -> str | None:
        d = re.sub(r"[^0-9]", "", s)
        if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn_digit(d[:-1]) != int(d[-1]):
            return None
        body = str(self.permute(f"card{d[0]}", 10 ** (len(d) - 2), int(d[1:-1]))).zfill(len(d) - 2)
        new = iter(d[0] + body + str(luhn_digit(d[0] + body)))
        return "".join(next(new) if ch.isdigit() else ch for ch in s)

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        y = self.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, y.to_bytes(4, "big")))

    def ssn(self, s: str) -> str | None:
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a = area - 1 - (area > 666)  # areas 1-665 and 667-899 as 0..897
        y = self.permute("ssn", 898 * 99 * 9999, (a * 99 + group - 1) * 9999 + serial - 1)
        y, serial = divmod(y, 9999)
        a, group = divmod(y, 99)
        return f"{a + 1 + (a >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

    def date(self, s: str) -> str | None:
        sep = re.search(r"[-/.]", s)[0]
        p = s.split(sep)
        orders = ("ymd",) if len(p[0]) == 4 else ("dmy", "mdy") if sep != "/" else ("mdy", "dmy")
        for order in orders:
            part = dict(zip(order, p))
            try:
                day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal()
            except ValueError:
                continue
            if not self.FIRST <= day <= self.LAST:
                return None
            y = datetime.date.fromordinal(
                self.FIRST + self.permute("date", self.LAST - self.FIRST + 1, day - self.FIRST))
            new = {"y": f"{y.year}", "m": f"{y.month:02d}", "d": f"{y.day:02d}"}
            return sep.join(new[k] for k in order)
        return None

    def phone(self, s: str) -> str | None:
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", s)
        head = country[0] if country else ""
        if not 7 <= len(re.sub(r"[^0-9]", "", s[len(head):])) <= 14:
            return None
        return head + self.digits("phone" + head, s[len(head):])

    def _ends(self, kind: str, text: str, a: int, b: int, loose: bool) -> list[int]:
        """Ends to try, the best first, for a run of ``kind`` from ``a`` to ``b``."""
        if kind not in ("iban", "phone", "card"):
            return [b]
        ends = [m.start() for m in WORD_END.finditer(text, a + 1, b + 1) if m.start() <= b]
        if kind == "iban":
            size = {e: len(text[a:e].replace(" ", "")) for e in ends}
            return sorted(ends, key=lambda e: (size[e] != IBAN_LENGTHS.get(text[a:a + 2]), -e))
        size = {e: len(re.findall("[0-9]", text[a:e])) for e in ends}
        if kind == "card":
            usual = CARD_LENGTHS.get(text[a], ())
            # short groups (lists of small numbers) count as a card in the longest run only
            regular = {e: all(len(g) >= 3 for g in re.split("[ -]", text[a:e])[:-1]) for e in ends}
            return sorted((e for e in ends if size[e] >= 13 and (regular[e] or loose and e == b)),
                          key=lambda e: (not regular[e], usual.index(size[e]) if size[e] in usual else len(usual), -e))
        if text[a] != "+":
            return [b]
        head = re.match(r"\+([0-9]{1,3})(?=[ .(-])", text[a:b])
        skip, usual = (len(head[1]), PHONE_LENGTHS.get(head[1], ())) if head else (0, ())
        ends = [e for e in ends if 7 <= size[e] - skip <= 14 and RULES["phone"].fullmatch(text, a, e)]
        for m in DIGITS_START.finditer(text, a + 1, b):
            other = self._value(text, m.start(), False, ("ip", "date", "ssn", "card"))
            if other:
                before = [e for e in ends if e <= m.start()]
                if before or other[0] == "card":
                    ends = before
                    break
        return sorted(ends, key=lambda e: (size[e] - skip not in usual, -e))

    def _value(self, text: str, a: int, loose: bool, kinds) -> tuple[str, int, str] | None:
        """Kind, end and pseudonym of the value that starts at ``a``."""
        for kind in kinds:
            m = RULES[kind].match(text, a)
            for b in self._ends(kind, text, a, m.end(), loose) if m else ():
                new = getattr(self, kind)(text[a:b])
                if new is not None:
                    return kind, b, new
        return None

    def replace(self, text: str) -> tuple[str, Counter]:
        found: Counter = Counter()
        out, done, at, failed = [], 0, 0, 0
        mails = _Mails(text)
        m, looked = None, -1
        while True:
            if looked < at:         # the first value of another kind stays the first until it is passed
                m = PATTERN.search(text, at)
                looked = m.start() if m else len(text)
            mail = mails.start(at)
            if m is None and mail is None:
                break
            first = mail is not None and mail <= looked
            a, kinds = (mail, ORDER) if first else (looked, ORDER[ORDER.index(m.lastgroup):])
            end = mails.end if first else m.end()
            value = self._value(text, a, a >= failed, kinds)
            if value is None:
                at, failed = a + 1, max(failed, end)
                continue
            kind, at, new = value
            found[kind] += 1
            out += [text[done:a], new]
            done = at
        return "".join([*out, text[done:]]), found


class _Mails:
    """Starts of e-mail addresses, found from their ``@`` on, so that a run of characters without
    one is never tried from each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.sign, self.first, self.end = text, -1, 0, -1
        self._next()

    def _next(self) -> None:
        """The next ``@`` with a domain behind it, and the first character of the run before it."""
        while (sign := self.text.find("@", self.sign + 1)) >= 0:
            low, floor, self.sign = sign, self.sign + 1, sign
            while low > floor and MAIL_CHAR.match(self.text, low - 1):
                low -= 1
            m = MAIL_END.match(self.text, sign) if low < sign else None
            if m:
                self.first, self.end = low, m.end()
                return
        self.sign = len(self.text)

    def start(self, at: int) -> int | None:
        """Where the first address at or after ``at`` starts."""
        while self.sign < len(self.text) and max(self.first, at) >= self.sign:
            self._next()
        return max(self.first, at) if self.sign < len(self.text) else None


#: Hexadecimal digits that are permuted as one number; a longer run is cut into such parts.
HEX_PART = 128

KINDS = [
    ("email", r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<![\w])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"),
    ("date", r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\w/-]|\.[0-9])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)"
              r"|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w)"
              r"|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])"),
    ("card", r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"),
]
ORDER = [name for name, _ in KINDS]
RULES = {name: re.compile(rx) for name, rx in KINDS}
WORD_END = re.compile(r"(?<=\w)(?!\w)")
DIGITS_START = re.compile(r"(?<!\w)(?=[0-9])")
#: Usual numbers of digits of cards by their first one, of phones behind their country code, of accounts by country.
CARD_LENGTHS = {"2": (16,), "3": (15, 14, 16), "4": (16, 13, 19), "5": (16,), "6": (16, 19)}
PHONE_LENGTHS = {"1": (10,), "7": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "41": (9,), "44": (9, 10), "45": (8,),
                 "47": (8,), "48": (9,), "55": (10, 11), "61": (9,), "81": (9, 10), "86": (10, 11), "91": (10,)}
# Characters of an account number by country, as the public registry has them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 28, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
    "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
MAIL_CHAR = re.compile(r"[\w.%+-]")
MAIL_END = re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
PATTERN = re.compile("|".join(f"(?P<{name}>{rx})" for name, rx in KINDS if name != "email").replace(r"\1", "(?P=sep1)").replace(r"\2", "(?P=sep2)")
                     .replace("[0-9]{4}([-/.])", "[0-9]{4}(?P<sep1>[-/.])").replace("[0-9]{1,2}([-/.])", "[0-9]{1,2}(?P<sep2>[-/.])"))

_HINT = np.zeros(256, dtype=bool)
_HINT[[*range(48, 58), 64]] = True


def pseudonymise(docs: DataFrame, key: str, text: str = "text", backwards: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced, ``n_pii`` (values replaced) and ``pii_kinds`` (kind:count, sorted)."""
    rest = [c for c in docs.columns if c not in ("n_pii", "pii_kinds") or c == text]
    d = docs.select(*rest)
    at = rest.index(text)
    schema = StructType([*d.schema.fields, StructField("n_pii", LongType()),
                         StructField("pii_kinds", ArrayType(StringType()))])

    def run(batches):
        maker = Pseudonyms(key, backwards)
        for batch in batches:
            col = batch.column(at)
            data, off = tk.text_buffers(col)
            # texts without a digit or an @ hold nothing to replace
            hits = np.concatenate(([0], np.cumsum(_HINT[data], dtype=np.int64)))
            rows = np.flatnonzero(hits[off[1:]] > hits[off[:-1]])
            changed, n, kinds = {}, np.zeros(len(col), np.int64), [[]] * len(col)
            for i in rows.tolist():
                old = col[i].as_py()
                new, found = maker.replace(old)
                if found:
                    changed[i] = new
                    n[i] = sum(found.values())
                    kinds[i] = [f"{k}:{v}" for k, v in sorted(found.items())]
            if changed:
                mask = np.zeros(len(col), dtype=bool)
                mask[list(changed)] = True
                col = pa.compute.replace_with_mask(col, pa.array(mask), pa.array(
                    [changed[i] for i in sorted(changed)], col.type))
            cols = [col if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(kinds, pa.list_(pa.string()))],
                                             names=schema.names)

    return d.mapInArrow(run, schema)
