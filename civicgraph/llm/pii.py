"""Personal data as format-preserving pseudonyms, by a keyed Feistel permutation.

A pattern proposes a value and a validation accepts it: checksums of cards (Luhn)
and bank accounts (mod 97), digit counts of phones, the number plan of social security
numbers, octets of addresses, the calendar. The valid values of a format are numbered
0..N-1; a keyed Feistel network on the next even number of bits, walked until it
lands below N, permutes them, and the permuted number is written in the same
format: same separators and letter case, checksum recomputed, and the same length
except that the numbers of an address take the digits they need and days and
months take two. Equal
values get equal pseudonyms in every document and spelling, different ones stay
different. The permutation moves every value: it is the Feistel permutation
applied to a shift, P^-1(P(x) + s) with s > 0, which is a permutation without
fixed points wherever N > 1. Values of more than WIDE digits and letters take a
Feistel network over their places instead of one large number, so their cost
grows with their length and not with its square.

Kinds: e-mail addresses (the part before the @), telephone numbers, payment
cards, IBANs, US social security numbers, IPv4 addresses, dates, and two kinds of
credentials: cloud key ids and values written after token/secret/password.

Defined results: null stays null, empty stays empty, text without such values
stays as it is to the byte. Values that fail validation are left alone; where the
longest reading fails, shorter ones are tried. Values do not overlap; where two
kinds fit, the one listed first in ``_KINDS`` wins.
"""

import datetime
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import id_text, ids_of, lean

#: Stands in for a secret key in tests and examples; deployments pass their own.
EXAMPLE_KEY = b"example key, not a secret"
ROUNDS = 8
#: Values of more digits and letters are permuted place by place, not as one number.
WIDE = 256


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (for n > 1)."""

    def __init__(self, key, name, n):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(f"{name}:{n}".encode(), key=key[:64], digest_size=32).digest()
        self.shift = 1 + int.from_bytes(hashlib.blake2b(b"shift", key=self.key, digest_size=32).digest()) % (n - 1) \
            if n > 1 else 0

    def _round(self, k, x):
        data = k.to_bytes(1, "big") + x.to_bytes((self.half + 7) // 8, "big")
        size = min(64, (self.half + 7) // 8 + 8)
        out = hashlib.blake2b(data, key=self.key, digest_size=size).digest()
        while len(out) * 8 < self.half:
            out += hashlib.blake2b(out, key=self.key, digest_size=64).digest()
        return int.from_bytes(out, "big") & self.mask

    def _forward(self, x):
        while True:
            left, right = x >> self.half, x & self.mask
            for k in range(ROUNDS):
                left, right = right, left ^ self._round(k, right)
            x = left << self.half | right
            if x < self.n:
                return x

    def _backward(self, x):
        while True:
            left, right = x >> self.half, x & self.mask
            for k in reversed(range(ROUNDS)):
                left, right = right ^ self._round(k, left), left
            x = left << self.half | right
            if x < self.n:
                return x

    def __call__(self, x):
        return self._backward((self._forward(x) + self.shift) % self.n)

    def undo(self, x):
        return self._backward((self._forward(x) - self.shift) % self.n)


class WidePermutation:
    """A keyed permutation of long sequences of digits in given bases, without fixed points, in linear time.

    A Feistel network over the two halves: each round adds to one half, place
    by place, a stream drawn from the other. Like Permutation it is applied to
    a shift: its first place that has more than one digit moves on.
    """

    def __init__(self, key, name, bases):
        self.bases = bases
        self.cut = len(bases) // 2
        self.key = hashlib.blake2b(name.encode() + bases.tobytes(), key=key[:64], digest_size=32).digest()
        self.at = int(np.argmax(bases > 1))
        self.shift = 1 + self.key[0] % (int(bases[self.at]) - 1)

    def _stream(self, k, half, n):
        out = hashlib.shake_256(self.key + bytes([k]) + half.astype(np.uint8).tobytes()).digest(4 * n)
        return np.frombuffer(out, "<u4").astype(np.int64)

    def _network(self, digits, sign, rounds):
        left, right = digits[:self.cut], digits[self.cut:]
        one, two = self.bases[:self.cut], self.bases[self.cut:]
        for k in rounds:
            if k % 2:
                left = (left + sign * self._stream(k, right, len(left))) % one
            else:
                right = (right + sign * self._stream(k, left, len(right))) % two
        return np.concatenate([left, right])

    def _shifted(self, digits, by):
        moved = self._network(digits, 1, range(ROUNDS))
        moved[self.at] = (moved[self.at] + by) % self.bases[self.at]
        return self._network(moved, -1, reversed(range(ROUNDS)))

    def __call__(self, digits):
        return self._shifted(digits, self.shift)

    def undo(self, digits):
        return self._shifted(digits, -self.shift)


# ---- checks and numberings -------------------------------------------------

def luhn_ok(digits):
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
                for k, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def _luhn_digit(body):
    return next(c for c in "0123456789" if luhn_ok(body + c))


def iban_ok(text):
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _refill(text, new, of):
    """The text with its characters of a class replaced in order."""
    chars = iter(new)
    return "".join(next(chars) if of(c) else c for c in text)


def _is_digit(c):
    return "0" <= c <= "9"


class Pseudonyms:
    """Replaces the values of one key; permutations are made once per format."""

    def __init__(self, key=EXAMPLE_KEY):
        self.key, self.made = key, {}

    def permute(self, name, n, x):
        if (name, n) not in self.made:
            if len(self.made) > 10_000:
                self.made.clear()
            self.made[name, n] = Permutation(self.key, name, n)
        return self.made[name, n](x)

    def characters(self, name, text):
        """Letters and digits permuted as one number, each place keeping its class."""
        bases = [(10, "0") if _is_digit(c) else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else None
                 for c in text]
        if sum(base is not None for base in bases) > WIDE:
            return self._long(name, text, bases)
        n, x = 1, 0
        for c, base in zip(text, bases):
            if base:
                n, x = n * base[0], x * base[0] + ord(c) - ord(base[1])
        if n == 1:
            return text
        x = self.permute(name, n, x)
        out = []
        for c, base in zip(reversed(text), reversed(bases)):
            if base:
                x, k = divmod(x, base[0])
                c = chr(ord(base[1]) + k)
            out.append(c)
        return "".join(reversed(out))

    def _long(self, name, text, bases):
        """Like characters, for values of any length."""
        places = [k for k, base in enumerate(bases) if base]
        sizes = np.array([bases[k][0] for k in places], np.int64)
        digits = np.array([ord(text[k]) - ord(bases[k][1]) for k in places], np.int64)
        out = list(text)
        for k, d in zip(places, WidePermutation(self.key, name, sizes)(digits).tolist()):
            out[k] = chr(ord(bases[k][1]) + d)
        return "".join(out)

    # each takes a match and returns its replacement, or None to leave it alone

    def email(self, m):
        text = m.group()
        local, domain = text.rsplit("@", 1)
        return f"{self.characters('email', local)}@{domain}"

    def card(self, m):
        text = m.group()
        digits = "".join(filter(_is_digit, text))
        if not 13 <= len(digits) <= 19 or not luhn_ok(digits) or len(set(digits)) == 1:
            return None
        body = digits[1:-1]                 # the first digit names the network
        new = digits[0] + str(self.permute("card" + digits[0], 10 ** len(body), int(body))).zfill(len(body))
        return _refill(text, new + _luhn_digit(new), _is_digit)

    def iban(self, m):
        text = m.group()
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or not iban_ok(plain):
            return None
        account = self.characters("iban" + plain[:2], plain[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in account + plain[:2] + "00")) % 97
        return _refill(text, f"{plain[:2]}{check:02d}{account}", lambda c: c != " ")

    def ssn(self, m):
        area, group, serial = (int(g) for g in m.groups())
        if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
            return None
        place = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
        place, serial = divmod(self.permute("ssn", 898 * 99 * 9999, place), 9999)
        area, group = divmod(place, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, m):
        """North American numbers stay in their plan or outside it; others keep their country code."""
        text = m.group()
        digits = "".join(filter(_is_digit, text))
        if text[0] == "+" and digits[0] != "1":
            if not 8 <= len(digits) <= 15:
                return None
            keep = 2
            rest = digits[keep:]
            new = digits[:keep] + str(self.permute("phone", 10 ** len(rest), int(rest))).zfill(len(rest))
            return _refill(text, new, _is_digit)
        local = digits[-10:]
        if len(digits) != (11 if text[0] == "+" else 10):
            return None
        if local[0] in "01" or local[3] in "01":
            return _refill(text, digits[:-10] + self._outside_plan(local), _is_digit)
        n, rest = 8 * 100 * 8 * 100 * 10_000, int(local[6:])
        x = ((int(local[0]) - 2) * 100 + int(local[1:3])) * 800 + (int(local[3]) - 2) * 100 + int(local[4:6])
        x, rest = divmod(self.permute("nanp", n, x * 10_000 + rest), 10_000)
        area, exchange = divmod(x, 800)
        new = digits[:-10] + f"{area // 100 + 2}{area % 100:02d}{exchange // 100 + 2}{exchange % 100:02d}{rest:04d}"
        return _refill(text, new, _is_digit)

    def _outside_plan(self, local):
        """Ten digits whose area code or exchange starts with 0 or 1, permuted among themselves."""
        first, n = 2 * 10 ** 9, 8 * 100 * 2 * 10 ** 6
        x = int(local)
        if x >= first:                      # only the exchange is outside
            area, rest = divmod(x - first, 10 ** 7)
            x = first + area * 2 * 10 ** 6 + rest
        x = self.permute("outside nanp", first + n, x)
        if x >= first:
            area, rest = divmod(x - first, 2 * 10 ** 6)
            x = first + area * 10 ** 7 + rest
        return f"{x:010d}"

    def address(self, m):
        octets = [int(g) for g in m.group().split(".")]
        if max(octets) > 255:
            return None
        x = self.permute("ipv4", 1 << 32, int.from_bytes(bytes(octets), "big"))
        return ".".join(str(b) for b in x.to_bytes(4, "big"))

    def date(self, m):
        text = m.group()
        numbers = [int(n) for n in re.findall(r"\d+", text)]
        if len(text) - len(text.lstrip("0123456789")) == 4:
            order = (0, 1, 2)
        else:                               # day first unless only month first is a date
            order = (2, 1, 0) if numbers[1] <= 12 else (2, 0, 1)
        try:
            day = datetime.date(*(numbers[k] for k in order))
        except ValueError:
            return None
        first, last = (datetime.date(1900, 1, 1), datetime.date(2099, 12, 31))
        if not first <= day <= last:
            first, last = (datetime.date(1000, 1, 1), datetime.date(1899, 12, 31)) if day < first else \
                (datetime.date(2100, 1, 1), datetime.date(9999, 12, 31))
            if not first <= day <= last:
                return None
        n = (last - first).days + 1
        day = first + datetime.timedelta(self.permute("date" + str(first.year), n, (day - first).days))
        parts = {order[0]: f"{day.year:04d}", order[1]: f"{day.month:02d}", order[2]: f"{day.day:02d}"}
        mark = re.findall(r"\D", text)
        return f"{parts[0]}{mark[0]}{parts[1]}{mark[1]}{parts[2]}"

    def cloud_key(self, m):
        text = m.group()
        return text[:4] + self.characters("key", text[4:])

    def credential(self, m):
        lead, value = m.group(1), m.group(2)
        if re.fullmatch(r"[0-9a-f]+", value) and len(value) >= 16:
            if len(value) > WIDE:
                return lead + self._long("hex", value.translate(_HEX), [(16, "a")] * len(value)).translate(_UNHEX)
            n = 16 ** len(value)
            return lead + format(self.permute("hex", n, int(value, 16)), "x").zfill(len(value))
        return lead + self.characters("credential", value)

    def replace(self, text):
        """(text with pseudonyms, {kind: count})."""
        if not text or not (_MAYBE.search(text) or "AKIA" in text or "ASIA" in text):
            return text, {}
        counts, out, at = {}, [], 0
        while m := _ANY.search(text, at):
            start = m.start()
            out.append(text[at:start])
            kind, end, new = self._value_at(text, start)
            if kind is None:
                end, new = start + 1, text[start]
            else:
                counts[kind] = counts.get(kind, 0) + 1
            out.append(new)
            at = end
        return "".join(out) + text[at:], counts

    def _value_at(self, text, start):
        """(kind, end, replacement) of the first valid value at a place, the longest reading first."""
        for kind, pattern in _ONE.items():
            m = pattern.match(text, start)
            while m:
                new = getattr(self, kind)(m)
                if new is not None:
                    return kind, m.end(), new
                cut = max(m.group().rfind(c) for c in " -.")
                m = pattern.match(text, start, start + cut) if cut > 0 else None
        return None, None, None


_D = r"(?<![0-9A-Za-z])"
_E = r"(?![0-9A-Za-z])"
#: Pattern of each kind, in order of precedence.
_KINDS = {
    "credential": r"(?<![0-9A-Za-z])((?i:api[_-]?key|access[_-]?token|token|secret|passwd|password|pwd)\s*[=:]\s*[\"']?)([0-9A-Za-z_\-]{6,})",
    "cloud_key": _D + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _E,
    "email": r"(?<![0-9A-Za-z._%+\-])[0-9A-Za-z][0-9A-Za-z._%+\-]*@(?:[0-9A-Za-z](?:[0-9A-Za-z\-]*[0-9A-Za-z])?\.)+[A-Za-z]{2,}",
    "iban": _D + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _E,
    "ssn": r"(?<![0-9A-Za-z\-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z\-])",
    "date": r"(?<![0-9A-Za-z./\-])(?:[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}|[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4})(?![0-9A-Za-z/\-]|\.[0-9])",
    "address": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": _D + r"[0-9](?:[ \-]?[0-9]){12,18}" + _E,
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,4}(?:[ .\-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})" + _E,
}
_ONE = {kind: re.compile(pattern) for kind, pattern in _KINDS.items()}


def _named():
    """All patterns as one, each in a group of its kind; inner groups do not count."""
    return "|".join(f"(?P<{kind}>{re.sub(r'(?<!\\)\((?!\?)', '(?:', pattern)})" for kind, pattern in _KINDS.items())


_ANY = re.compile(_named())
#: Every kind but the cloud keys has one of these.
_MAYBE = re.compile(r"[0-9@=:]")

#: Hexadecimal digits as sixteen letters in a row, and back.
_HEX, _UNHEX = str.maketrans("0123456789abcdef", "abcdefghijklmnop"), str.maketrans("abcdefghijklmnop", "0123456789abcdef")

ROW = "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{kind} long" for kind in _KINDS)


def pseudonymise(docs: DataFrame, key=EXAMPLE_KEY, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text, n_replaced, a count per kind) of every row of ``docs``."""
    def run(batches):
        import pyarrow as pa
        names = [c.split()[0] for c in ROW.split(", ")]
        change = Pseudonyms(key)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            texts, counts = [], []
            for cell in column:
                text, found = change.replace(cell.as_py())
                texts.append(text)
                counts.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_of(batch, "doc_id"), pa.int64()), pa.array(texts, column.type),
                 pa.array([sum(c.values()) for c in counts], pa.int64()),
                 *(pa.array([c.get(kind, 0) for c in counts], pa.int64()) for kind in _KINDS)], names=names)
    return id_text(docs, id_col, text_col).mapInArrow(lean(run), ROW)


def replace_in(docs: DataFrame, key=EXAMPLE_KEY) -> DataFrame:
    """``docs`` with pseudonyms in its text; every other column stays as it is."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        change = Pseudonyms(key)
        for batch in batches:
            column = batch.column(at)
            texts = pa.array([change.replace(cell.as_py())[0] for cell in column], column.type)
            yield batch.set_column(at, batch.schema.field(at), texts)
    return docs.mapInArrow(lean(run), docs.schema)
