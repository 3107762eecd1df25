"""PII: format-preserving Feistel pseudonyms.

Card numbers (Luhn), IBANs (mod 97), social security and phone numbers, IPv4
addresses, dates, e-mail addresses and secrets are found by pattern, validated,
and replaced by the value that a keyed Feistel permutation of their format's
domain gives: a card stays a valid card with its separators, a date a date. The
same value has the same pseudonym in every document, and the key's owner can
restore it (`restore`).

The permutation works on the integers below the domain's size: ROUNDS rounds of a
balanced Feistel network over the next even number of bits, keyed by BLAKE2,
repeated until the value is within the domain (cycle walking). Parts that must
stay (a card's first digit, a country code) are left out of the domain; check
digits are computed anew.

Card and IBAN patterns run over neighbouring groups. If the whole match isn't valid,
its shorter starts that end with a group are tried, longest first, then the search goes
on at its second group. A pseudonym that would make a number valid that was passed
over on the way is permuted again, so that `restore` meets the same values.

Nulls and edges: a null text stays null, an empty one empty. Values that fail
validation stay. Rows are treated one by one, so ties and repeats agree; further
columns pass through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

ROUNDS = 10
KEY_CONF = "spark.siftwright.pii.key"  # must be set where no key is given: there is no default
KINDS = ("secret", "access_key", "email", "iban", "card", "ssn", "phone", "ip", "date")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # to the end of 2099

PATTERN = re.compile(
    r"""(?P<secret>\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b["']?\s*[=:]\s*["']?(?P<value>[A-Za-z0-9_\-]{8,}))
    |(?P<access_key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)
    |(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})
    |(?P<iban>\b[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
    |(?P<date>(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/\-]|\.[0-9]))
    |(?P<ssn>(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-]))
    |(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))
    |(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z+])\([0-9]{3}\)\ ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+.\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-]))
    |(?P<card>(?<![0-9A-Za-z.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9]))""",
    re.VERBOSE | re.ASCII,
)


INSIDE = re.compile(r"(?P<card>[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9]))")  # a card from a later group on
HEX = re.compile("(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{8,}")  # digits and letters a to f


class Feistel:
    """A keyed permutation of the integers below a size, for each name of a format."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, name: str, r: int, half: int, width: int, mask: int) -> int:
        body = f"{name}:{r}:".encode() + half.to_bytes(width, "little")
        return int.from_bytes(hashlib.blake2b(body, key=self.key, digest_size=min(64, width)).digest(), "little") & mask

    def _walk(self, name: str, x: int, size: int, rounds) -> int:
        bits = max(1, -(-(size - 1).bit_length() // 2))
        mask, width = (1 << bits) - 1, -(-bits // 8)
        name = f"{name}:{size}"
        back = rounds[0] > rounds[-1]
        while True:
            a, b = x >> bits, x & mask
            for r in rounds:
                if back:
                    a, b = b ^ self._round(name, r, a, width, mask), a
                else:
                    a, b = b, a ^ self._round(name, r, b, width, mask)
            x = a << bits | b
            if x < size:
                return x

    def apply(self, name: str, x: int, size: int) -> int:
        return self._walk(name, x, size, range(ROUNDS))

    def undo(self, name: str, x: int, size: int) -> int:
        return self._walk(name, x, size, range(ROUNDS - 1, -1, -1))


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _fill(form: str, new: str, keep: str = "[A-Za-z0-9]") -> str:
    """form with its letters and digits replaced, in order."""
    it = iter(new)
    return re.sub(keep, lambda m: next(it), form)


def _classes(text: str, hexadecimal: bool) -> list[str]:
    digits, low, high = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return ["0123456789abcdef" if hexadecimal else digits if c in digits else low if c in low else high if c in high else c for c in text]


class Pseudonyms:
    """Validates and permutes one value of a kind; `back` undoes it."""

    def __init__(self, key: str, back: bool = False):
        self.step = Feistel(key).undo if back else Feistel(key).apply
        self.cached = lru_cache(100_000)(self.of)

    def number(self, name: str, digits: str, ok=lambda x: True) -> str:
        size = 10 ** len(digits)
        x = int(digits)
        while True:
            x = self.step(f"{name}{len(digits)}", x, size)
            new = str(x).zfill(len(digits))
            if ok(new):
                return new

    def mixed(self, name: str, text: str) -> str:
        """Each letter or digit becomes one of its class; all of up to 64 characters are permuted together."""
        out = []
        for at in range(0, len(text), 64):
            part = text[at : at + 64]
            hexadecimal = bool(HEX.fullmatch(part))
            alphabets = _classes(part, hexadecimal)
            x, size = 0, 1
            for c, a in zip(part, alphabets, strict=True):
                x, size = x * len(a) + a.index(c), size * len(a)
            new = part
            while size > 1:
                x = rest = self.step(name + "-".join(str(len(a)) for a in alphabets), x, size)
                new = ""
                for a in reversed(alphabets):
                    rest, d = divmod(rest, len(a))
                    new = a[d] + new
                if bool(HEX.fullmatch(new)) == hexadecimal:
                    break
            out.append(new)
        return "".join(out)

    def of(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None if the text isn't a valid value of the kind."""
        return getattr(self, kind)(text)

    def secret(self, text: str) -> str | None:
        return self.mixed("secret", text)

    def access_key(self, text: str) -> str | None:
        return text[:4] + self.mixed("access", text[4:])

    def email(self, text: str) -> str | None:
        local, host = text.rsplit("@", 1)
        labels = host.split(".")
        if local.startswith(".") or local.endswith(".") or ".." in local:
            return None
        part = local + "@" + ".".join(labels[:-2])
        return _fill(part, self.mixed("email", re.sub("[^A-Za-z0-9]", "", part))) + ("." if len(labels) > 2 else "") + ".".join(labels[-2:])

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        account = self.mixed("iban" + plain[:2], plain[4:])
        check = 98 - iban_rest(plain[:2] + "00" + account)
        return _fill(text, f"{plain[:2]}{check:02d}{account}")

    def card(self, text: str) -> str | None:
        digits = re.sub("[^0-9]", "", text)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        new = digits[0] + self.number("card", digits[1:-1], lambda x: len({digits[0], *x}) > 1)
        return _fill(text, new + next(c for c in "0123456789" if luhn(new + c)))

    def ssn(self, text: str) -> str | None:
        ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = text.replace("-", "")
        return _fill(text, self.number("ssn", digits, ok)) if ok(digits) else None

    def phone(self, text: str) -> str | None:
        code, rest = re.match(r"(\+[0-9]{1,3}(?=[ .\-(])|\+1|)(.*)", text, re.DOTALL).groups()
        digits = re.sub("[^0-9]", "", rest)
        if not 6 <= len(digits) <= 14:
            return None
        american = code in ("", "+1") and len(digits) == 10
        ok = (lambda d: d[0] in "23456789" and d[3] in "23456789") if american and digits[0] in "23456789" and digits[3] in "23456789" else (lambda d: True)
        return code + _fill(rest, self.number(f"phone{code}{american}", digits, ok))

    def ip(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        x = self.step("ip", int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        form = "%Y-%m-%d" if "-" in text else "%d.%m.%Y" if "." in text else "%m/%d/%Y"
        try:
            day = datetime.datetime.strptime(text, form).date()
        except ValueError:
            return None
        if not 0 <= (x := day.toordinal() - FIRST_DAY) < DAYS:
            return None
        day = datetime.date.fromordinal(FIRST_DAY + self.step("date", x, DAYS))
        return f"{day.year:04d}-{day.month:02d}-{day.day:02d}" if "-" in text else f"{day.day:02d}.{day.month:02d}.{day.year:04d}" if "." in text else f"{day.month:02d}/{day.day:02d}/{day.year:04d}"

    def text(self, text: str) -> tuple[str, Counter]:
        """The text with all valid values replaced, and how many of each kind there were."""
        found: Counter = Counter()
        out: list[str] = []
        failed: list[tuple[str, int, int]] = []  # spans that weren't valid and reach past `at`
        done: list[tuple[int, int, str]] = []  # values replaced within them
        at = copied = 0
        while m := (failed and text[at - 1] == "-" and INSIDE.match(text, at)) or PATTERN.search(text, at):
            kind = m.lastgroup if m.lastgroup != "value" else "secret"
            start, end = m.span("value" if kind == "secret" else kind)
            failed = [x for x in failed if x[2] > start]
            done = done if failed else []
            groups = [start + g.end() for g in re.finditer("[A-Za-z0-9]+", text[start:end])] if kind in ("card", "iban") else [end]
            for end in groups[::-1]:
                if kind == "card" and sum(c.isdigit() for c in text[start:end]) < 13:
                    continue
                new = self.cached(kind, text[start:end])
                if new is not None:
                    break
                failed.append((kind, start, end))
            if new is None:
                at = groups[0] + 1 if len(groups) > 1 else m.end()
                continue
            while any(self._made(text, [*done, (start, end, new)], *x) for x in failed):
                new = self.cached(kind, new)
            found[kind] += 1
            out += [text[copied:start], new]
            done.append((start, end, new))
            at = copied = end
        return "".join([*out, text[copied:]]), found

    def _made(self, text: str, done: list[tuple[int, int, str]], kind: str, start: int, end: int) -> bool:
        """Whether the replacements make the span valid."""
        now = text[start:end]
        for s, e, new in done:
            if s < end and e > start and len(new) == e - s:
                new = new[max(start - s, 0) : end - s]
                s = max(s - start, 0)
                now = now[:s] + new + now[s + len(new) :]
        return self.cached(kind, now) is not None


#: what every value has at least one of; texts without any are not searched
MAY = re.compile("[0-9@=:]|A(?:KIA|SIA)", re.ASCII)


def pseudonymise(docs: DataFrame, key: str | None = None, counts: str | None = "pii", back: bool = False) -> DataFrame:
    """docs with their texts' values replaced, and a map column (`counts`, replaced if there is one) of how many there were of each kind."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"a key is needed: give one, or set {KEY_CONF}")
    if counts:
        docs = docs.drop(counts)
    schema = StructType([*docs.schema.fields, *([StructField(counts, MapType(StringType(), LongType()))] if counts else [])])
    place = docs.columns.index("text")

    def run(batches):
        names = Pseudonyms(key, back)
        for b in batches:
            texts, found = b.column(place).to_pylist(), []
            for i, t in enumerate(texts):
                n = Counter()
                if t and MAY.search(t):
                    texts[i], n = names.text(t)
                found.append(sorted(n.items()))
            columns = list(b.columns)
            columns[place] = pa.array(texts, b.schema.field(place).type)
            if counts:
                columns.append(pa.array(found, pa.map_(pa.string(), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def restore(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The texts as they were before `pseudonymise` with that key."""
    return pseudonymise(docs, key, None, back=True)
