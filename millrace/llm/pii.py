"""Personal data by anchor expansion (operator 6).

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
URL schemes, plus signs before digits, digits, double colons and colons before
hexadecimal digits, words of street names and identifier cues.  At each anchor
a local parser fixes the boundaries and validates the finding.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import map_arrow

#: Kinds of the base rules in listed order, then the kinds that the method adds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "ipv6", "address")
_RANK = {k: i for i, k in enumerate(KINDS)}

_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn", "mailto:", "tel:")
#: Words of street names: after the house number and name, or before them.
_STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Boulevard", "Blvd", "Drive", "Dr", "Court", "Square")
_WAYS = ("rue", "avenue", "boulevard", "place", "calle", "avenida", "plaza", "paseo", "Rue", "Calle", "Avenida", "Plaza", "Paseo")
_GERMAN = ("straße", "strasse", "platz", "allee", "gasse")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_ACCOUNT = re.compile(r"[\s:#=.]{0,4}(?:no|nr|number|num)?[\s:#=.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}|[0-9](?:[ -]?[0-9]){5,19})", re.I | re.A)
_HEXRUN = frozenset("0123456789abcdefABCDEF:.")
#: The longest written form of an IPv6 address, and how far before its street word an address may begin.
_IPV6_CHARS, _ADDRESS_REACH = 45, 80
_NAME = r"[^\W\d_][\w.'’-]{0,30}"
_BEFORE_STREET = re.compile(rf"(?<![\w.,-])[0-9]{{1,5}}[A-Za-z]? (?:[A-Z]\. ?)?(?:{_NAME} ){{1,3}}$")
_AFTER_STREET = re.compile(rf"\.?(?:,? (?:Apt|Suite|Unit|No|#)\.? ?[0-9]{{1,5}}[A-Z]?)?(?:,? {_NAME}(?: {_NAME})?,? [A-Z]{{2}} [0-9]{{5}}(?:-[0-9]{{4}})?(?![0-9]))?")
_FRENCH_BEFORE = re.compile(r"(?<![\w.,-])[0-9]{1,5}(?: ?(?:bis|ter))?,? $")
_WAY_NAME = re.compile(rf" (?:(?:de|du|des|la|le|les|del|los|las) |de l['’]){{0,2}}[A-ZÀ-ÖØ-Þ][\w.'’-]{{0,30}}(?: (?:de |la )?[A-ZÀ-ÖØ-Þ][\w.'’-]{{0,30}}){{0,2}}")
_NUMBER_AFTER = re.compile(r",? (?:n[ºo°]\.? ?)?[0-9]{1,4}[a-z]?(?![\w.,]*[0-9])")
_TOWN = re.compile(r",? [0-9]{5} [A-ZÀ-ÖØ-Þ][\w-]{1,30}")
_GERMAN_BEFORE = re.compile(r"[A-ZÄÖÜ][\wß-]{2,30}$")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban(text: str) -> bool:
    """The mod-97 check of an international bank account number."""
    bare = text.replace(" ", "").upper()
    if not 15 <= len(bare) <= 34:
        return False
    moved = bare[4:] + bare[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", "@")
    found.add_word("://", "://")
    for d in "0123456789":
        found.add_word(d, "0")
        found.add_word("+" + d, "+")
    for cue in _CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, "cue")
    found.add_word("::", "::")
    for d in "0123456789abcdefABCDEF":
        found.add_word(":" + d, "::")
    for word in _STREETS:
        found.add_word(f" {word}", "street")
    for word in _WAYS:
        found.add_word(f"{word} ", "way")
    for word in _GERMAN:
        found.add_word(f"{word} ", "german")
    found.make_automaton()
    return found


class Finder:
    """Finds all spans of a text; spans of one kind never overlap, and a failed match is passed over whole."""

    def __init__(self) -> None:
        self.anchors = automaton()

    def find(self, text: str) -> list[Span]:
        spans: list[Span] = []
        after = dict.fromkeys(KINDS, 0)
        for end, kind in self.anchors.iter(text):
            at = end
            if kind == "@":
                self._email(text, at, after, spans)
            elif kind == "0":
                self._ip(text, at, after, spans)
                self._card(text, at, after, spans)
            elif kind == "+":
                self._phone(text, at - 1, after, spans)
            elif kind == "://":
                self._url(text, at + 1, after, spans)
            elif kind == "::":
                self._ipv6(text, at - 1, after, spans)
            elif kind == "cue":
                self._account(text, at + 1, after, spans)
            else:
                self._address(text, at, kind, after, spans)
        spans.sort(key=lambda s: (s[1], _RANK[s[0]]))
        return spans

    def _email(self, text: str, at: int, after: dict, spans: list[Span]) -> None:
        start = at
        while start > after["email"] and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append(("email", start, m.end()))
            after["email"] = m.end()

    def _ip(self, text: str, at: int, after: dict, spans: list[Span]) -> None:
        if at < after["ip"]:
            return
        m = _IP.match(text, at)
        if m:
            after["ip"] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                spans.append(("ip", at, m.end()))
        else:  # the rest of the digit run fails alike
            after["ip"] = _past_digits(text, at)

    def _card(self, text: str, at: int, after: dict, spans: list[Span]) -> None:
        if at < after["card"]:
            return
        m = _CARD.match(text, at)
        if not m:
            return
        after["card"] = m.end()
        digits = "".join(c for c in m[0] if "0" <= c <= "9")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", at, m.end()))

    def _phone(self, text: str, at: int, after: dict, spans: list[Span]) -> None:
        m = _PHONE.match(text, at) if at >= after["phone"] else None
        if m:
            after["phone"] = m.end()
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append(("phone", at, m.end()))

    def _url(self, text: str, at: int, after: dict, spans: list[Span]) -> None:
        """Credentials inside a URL: user, password and host after the scheme."""
        m = _USERINFO.match(text, at) if at >= after["url"] else None
        if m:
            spans.append(("url", at, m.end()))
            after["url"] = m.end()

    def _account(self, text: str, at: int, after: dict, spans: list[Span]) -> None:
        """A number that follows an identifier cue: a valid IBAN, or 6 to 20 digits."""
        m = _ACCOUNT.match(text, at)
        if not m or m.start(1) < after["account"] or m[0][:1].isalnum() and m.start(1) == at:
            return
        value = m[1]
        if value[0].isdigit() or _iban(value):
            spans.append(("account", m.start(1), m.end(1)))
            after["account"] = m.end(1)


    def _ipv6(self, text: str, at: int, after: dict, spans: list[Span]) -> None:
        """The run of hexadecimal digits, colons and dots around a colon, if it is an IPv6 address with a digit and a group of three characters."""
        if at < after["ipv6"]:
            return
        start = at
        while start > after["ipv6"] and text[start - 1] in _HEXRUN:
            start -= 1
        end = at
        while end < len(text) and text[end] in _HEXRUN:
            end += 1
        after["ipv6"] = end
        if start and (text[start - 1].isalnum() or text[start - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] == "_"):
            return
        run = text[start:end].rstrip(".")
        run = run[:-1] if run.endswith(":") and not run.endswith("::") else run
        # Names such as a::b are not addresses.
        if not 4 <= len(run) <= _IPV6_CHARS or run.count(":") < 2 or max(map(len, run.split(":"))) < 3 or not any("0" <= c <= "9" for c in run):
            return
        try:
            ipaddress.IPv6Address(run)
        except ValueError:
            return
        spans.append(("ipv6", start, start + len(run)))

    def _address(self, text: str, end: int, kind: str, after: dict, spans: list[Span]) -> None:
        """A postal address around a word of a street name: a house number, a capitalised name, and town and code if they follow."""
        floor = max(after["address"], end - _ADDRESS_REACH)
        if kind == "street":
            if end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] in "_-'’"):
                return
            word = text.rfind(" ", 0, end + 1) + 1
            before = _BEFORE_STREET.search(text[floor:word])
            if not before or not before[0].split()[1][0].isupper():
                return
            start, stop = floor + before.start(), _AFTER_STREET.match(text, end + 1).end()
        elif kind == "way":
            word = max((text.rfind(w + " ", floor, end + 1) for w in _WAYS if text.startswith(w + " ", end - len(w))), default=-1)
            name = _WAY_NAME.match(text, end) if word >= 0 and not (word and text[word - 1].isalnum()) else None
            if not name:
                return
            before, number = _FRENCH_BEFORE.search(text[floor:word]), _NUMBER_AFTER.match(text, name.end())
            if not before and not number:
                return
            start, stop = (floor + before.start(), name.end()) if before else (word, number.end())
        else:
            before, number = _GERMAN_BEFORE.search(text[floor:end]), _NUMBER_AFTER.match(text, end)
            if not before or not number:
                return
            start, stop = floor + before.start(), number.end()
        if kind != "street":
            town = _TOWN.match(text, stop)
            stop = town.end() if town else stop
        spans.append(("address", start, stop))
        after["address"] = stop


def _past_digits(text: str, at: int) -> int:
    while at < len(text) and "0" <= text[at] <= "9":
        at += 1
    return at


def listing(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256 and spans.  ``spans`` lists kind:start:end by start, then kind,
    in code points with exclusive ends; ``base_sha256`` digests the part of the
    four base kinds.  ``url`` (credentials in a URL), ``account`` (IBANs and
    numbers after an identifier cue), ``ipv6`` and ``address`` (a house number
    with a street name, in the languages at hand) are additions.  Null and empty texts have
    no spans.
    """

    def make():
        finder = Finder()

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:4]}
            digests, lists = [], []
            for text in batch.column(1).to_pylist():
                spans = finder.find(text) if text else []
                base = [s for s in spans if _RANK[s[0]] < 4]
                for k in counts:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(listing(base).encode()).hexdigest())
                lists.append(listing(spans))
            yield {"doc_id": batch.column(0), "base_sha256": digests, "spans": lists} | {f"n_{k}": v for k, v in counts.items()}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
