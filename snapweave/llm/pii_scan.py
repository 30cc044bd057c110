"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at-signs, digits, plus
signs, URL schemes and identifier cues. At each anchor a small deterministic parser expands to the
value's boundaries and validates it; nothing else of the text is looked at.

Base kinds, leftmost and non-overlapping per kind, failing values dropped and not retried:

* ``email``: at an at-sign, back over the local part (never into the match before), forward over
  two domain labels or more;
* ``ip``: at a digit, four dotted groups, each at most 255;
* ``card``: at a digit, digits with single blanks or hyphens between, 16 to 19 that pass Luhn;
* ``phone``: at a plus sign, to the last digit of the run of digits, blanks and ``().-``, 8 to 15.

Added kinds, most after a cue in any case, with white space, punctuation and words like ``number`` or ``is``
between, all bounded: ``iban`` (ISO 13616: the country's length and the check; for a country not listed the
longest run of words that passes the check), ``ssn`` (area, group and serial rules), ``account`` (6 to 17
digits), ``routing`` (nine digits with their check) and ``passport`` (letters and digits of the common
forms); ``login`` (``user:password@`` after ``://``); ``ipv6`` and ``mac`` around a colon; ``address``: a
street's name with its number, expanded from the word for a street (English, German, French, Spanish), and the
place with its postal code where that follows. An added span that a base span holds is left out.

Defined cases: null text counts as empty; repeated rows are scanned one by one; null ids pass
through; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table, text_or_empty

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "account", "login", "routing", "passport", "ipv6", "mac", "address"]
BASE = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What the automaton looks for: anchors by what their parser starts from, cues in lower case.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account",
        "routing": "routing", "passport": "passport", **dict.fromkeys(
            ("street", "avenue", "road", "lane", "drive", "boulevard", "stra\u00dfe", "strasse", "weg", "platz", "gasse", "rue", "calle",
             "avenida", "plaza"), "address")}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GAP = r"[\s:#=(,.\u2013\u2014-]{0,6}"
FILLER = rf"(?:{_GAP}(?:numbers?|nos?|nrs?|num|id|code)\b)?(?:{_GAP}is\b)?{_GAP}"
IBAN = re.compile(FILLER + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})", re.I | re.A)
IBAN_CHAR = re.compile(r"[A-Za-z0-9]")
#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
SSN = re.compile(FILLER + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
ACCOUNT = re.compile(FILLER + r"([0-9](?:[ -]?[0-9]){5,16})(?![0-9]|[ -][0-9])", re.I)
ROUTING = re.compile(FILLER + r"([0-9]{9})(?![0-9-])", re.I)
PASSPORT = re.compile(FILLER + r"([A-Z]{1,2}[0-9]{6,8}|[0-9]{8,9})(?![A-Za-z0-9])", re.I | re.A)
COLONS = frozenset("0123456789abcdefABCDEF:")
MAC = re.compile(r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}")
_NAME = r"[A-Z\u00c0-\u00de][\w'\u2019.-]{0,30}"
_PLACE = rf"(?:,?\s{{1,2}}{_NAME}(?:\s{_NAME}){{0,2}},?\s[A-Z]{{2}}\s[0-9]{{5}}(?:-[0-9]{{4}})?|,?\s{{1,2}}[0-9]{{5}}\s{_NAME})?"
#: Postal addresses by where the word for a street stands: after the name, or before it.
ADDRESSES = (
    re.compile(rf"(?<!\w)[0-9]{{1,5}}[A-Za-z]?\s(?:{_NAME}\s){{1,3}}(?:Street|Avenue|Road|Lane|Drive|Boulevard)\b{_PLACE}"),
    re.compile(rf"(?<!\w){_NAME}(?:stra\u00dfe|strasse|weg|platz|gasse)\s[0-9]{{1,4}}[a-z]?\b{_PLACE}"),
    re.compile(rf"(?<!\w)[0-9]{{1,4}},?\s(?:rue|avenue|boulevard)(?:\s(?:de|du|des|la|le|les)){{0,2}}\s{_NAME}(?:\s{_NAME}){{0,3}}{_PLACE}"),
    re.compile(rf"(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza)(?:\s(?:de|del|la|las|los|el)){{0,2}}\s{_NAME}(?:\s{_NAME}){{0,3}},?\s[0-9]{{1,4}}\b{_PLACE}"),
)
#: Characters before the word for a street that an address may begin with.
REACH = 130
LOGIN = re.compile(r"([^\s/@:?#]+:[^\s/@?#]+)@[A-Za-z0-9]")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    a.add_word(":", ("colon", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for cue, kind in CUES.items():
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid_iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the IBAN from ``start`` ends, at ``end`` at the latest; the words after it may look like more of it."""
    ends = [m.end() for m in IBAN_CHAR.finditer(text, start, end)]
    length = IBAN_LENGTHS.get(text[start:start + 2].upper())
    for e in (ends[length - 1:length] if length else reversed(ends[14:])):
        if not IBAN_CHAR.match(text, e) and valid_iban(text[start:e]):
            return e
    return None


def valid_ssn(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def valid_routing(s: str) -> bool:
    return s != "0" * 9 and sum(int(c) * w for c, w in zip(s, (3, 7, 1) * 3)) % 10 == 0


def colon_span(text: str, at: int) -> tuple[int, int]:
    """The run of base-16 digits and colons around a colon, longer than any address only if it is none."""
    a = b = at
    while a > 0 and text[a - 1] in COLONS and at - a < 40:
        a -= 1
    while b < len(text) and text[b] in COLONS and b - at < 40:
        b += 1
    return a, b


def valid_ipv6(s: str) -> bool:
    if s.count(":") < 2 or len(s) > 39 or not any(c.isdigit() for c in s):
        return False
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def address_at(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The postal address that holds the word for a street at ``at``."""
    for pattern in ADDRESSES:
        for m in pattern.finditer(text, max(0, at - REACH), min(len(text), after + REACH)):
            if m.start() <= at and m.end() >= after:
                return m.span()
            if m.start() > at:
                break
    return None


def spans_of(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind of ``KINDS`` in order of start."""
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    email = ip = card = phone = colon = street = 0  # where the next match of each kind may start
    # Bytes lower ASCII only, so that places stay.
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, (anchor, width) in automaton().iter(lower):
        at, after = last - width + 1, last + 1
        if anchor == "digit":
            if at >= card:
                m = CARD.match(text, at)
                card = m.end() if m else after
                if m:
                    d = only_digits(m[0])
                    if 16 <= len(d) <= 19 and luhn(d):
                        out[2].append((at, card))
            if at >= ip:
                m = IP.match(text, at)
                ip = m.end() if m else DIGITS.match(text, at).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out[1].append((at, ip))
        elif anchor == "at":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            m = start < at and DOMAIN.match(text, after)
            if m:
                email = m.end()
                out[0].append((start, email))
        elif anchor == "plus":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 8 <= len(only_digits(m[0])) <= 15:
                    out[3].append((at, phone))
        elif anchor == "iban":
            if (m := IBAN.match(text, after)) and (end := iban_end(text, *m.span(1))):
                out[4].append((m.start(1), end))
        elif anchor == "ssn":
            if (m := SSN.match(text, after)) and valid_ssn(m[1]):
                out[5].append(m.span(1))
        elif anchor == "account":
            if m := ACCOUNT.match(text, after):
                out[6].append(m.span(1))
        elif anchor == "scheme":
            if m := LOGIN.match(text, after):
                out[7].append(m.span(1))
        elif anchor == "routing":
            if (m := ROUTING.match(text, after)) and valid_routing(m[1]):
                out[8].append(m.span(1))
        elif anchor == "passport":
            if m := PASSPORT.match(text, after):
                out[9].append(m.span(1))
        elif anchor == "colon":
            if at >= colon:
                start, colon = colon_span(text, at)
                value, free = text[start:colon], not (start and text[start - 1].isalnum() or text[colon:colon + 1].isalnum())
                if free and MAC.fullmatch(value):
                    out[11].append((start, colon))
                elif free and valid_ipv6(value):
                    out[10].append((start, colon))
        elif at >= street and (found := address_at(text, at, after)):
            out[12].append(found)
            street = found[1]
    base = sorted(s for k in range(BASE) for s in out[k])
    for k in range(BASE, len(KINDS)):
        out[k] = sorted({s for s in out[k] if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)})
    return out


def scan_batch(batch) -> dict:
    cols: dict[str, list] = {"id": batch.column(0).to_pylist(), "counts": [], "base": [], "spans": []}
    for text in batch.column(1).to_pylist():
        found = spans_of(text)
        parts = [[f"{k}:{s}:{e}" for s, e in f] for k, f in zip(KINDS, found)]
        cols["counts"].append([len(f) for f in found])
        cols["base"].append(",".join(x for p in parts[:BASE] for x in p))
        cols["spans"].append(",".join(x for p in parts for x in p))
    return cols


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the number of spans of each of ``KINDS``, base spans and all spans as text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")), scan_batch,
                       f"id {kind}, counts array<bigint>, base string, spans string")


def query(spark, sf_dir):
    d = scan(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), *[F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)],
                    F.sha2("base", 256).alias("base_sha256"), "spans")
