"""Personal data: patterns propose, checksums confirm, context words adjust the score.

**Method.**  Regular expressions propose spans, validators confirm them (parts of an address at
most 255, Luhn for cards, digit counts for phones, mod 97 for IBANs, issued ranges for social security numbers),
and words near a confirmed span raise or lower its score.

Every pattern is tried only where its kind can start, so a long run of letters or digits costs linear time: an address is
found from its ``@``, a numeric one from the start of a run of digits, a phone from its ``+``.

Kinds, in order: ``email``, ``ip``, ``card``, ``phone`` (the base: reported whenever confirmed), then ``iban``
(reported when mod 97 confirms it) and ``ssn`` (no checksum, so reported only if a context word supports it).
Within a kind the matches are leftmost and do not overlap, and a match of a base kind that its validator rejects is
dropped without a second try inside it.  An IBAN has its country's length; for a country without a known length the longest cut
at the end of a group that mod 97 confirms is taken.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seasonlens.llm.common import map_texts, texts
from seasonlens.llm.spans import SPANS, ascii_lower, ordered

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# Fixed values.  The look-behinds keep a pattern from starting inside a run it could not match from its start.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_GROUP = re.compile(r"\x20?(?:[A-Z0-9]{4}|[A-Z0-9]{1,3}(?![A-Za-z0-9]))")
IBAN_END = re.compile(r"(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Score of a confirmed span, and words that support or weaken a kind within CONTEXT characters.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
SUPPORT = {
    "email": ("mail", "contact", "reach", "write"), "ip": ("address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "payment", "credit", "debit"), "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security"),
}
WEAKEN = {"email": ("example", "noreply"), "ip": ("version", "release"), "card": ("order", "isbn", "tracking"), "phone": ("555",),
          "iban": (), "ssn": ("order", "part", "invoice")}
CONTEXT = 40
# Lengths of IBANs by country, from the registry.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in countries.split()}
STEP = 0.1
SSN_LEAST = 0.4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 when its rearranged digits are divided by 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _parts_fit(address: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in address.split("."))


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)  # no match can reach across this sign
        at = text.find("@", max(at + 1, done))


def _ibans(text: str):
    m = IBAN_START.search(text)
    while m:
        start = m.start()
        length = IBAN_LENGTHS.get(text[start:start + 2])
        size, at, cuts = 4, m.end(), []
        while size < (length or 34) and (group := IBAN_GROUP.match(text, at)):
            size += len(group[0].lstrip(" "))
            at = group.end()
            if IBAN_END.match(text, at) and (size == length if length else 15 <= size <= 34):
                cuts.append(at)
            if len(group[0].lstrip(" ")) < 4:
                break
        end = next((e for e in reversed(cuts) if mod97(text[start:e].replace(" ", ""))), None)
        if end:
            yield start, end
        m = IBAN_START.search(text, end or m.end())


def _confirmed(text: str):
    for start, end in _emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if _parts_fit(m[0]):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", *m.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's score, raised and lowered by the words around a span; 0 to 1."""
    near = ascii_lower(text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT])
    up = sum(w in near for w in SUPPORT[kind])
    down = sum(w in near for w in WEAKEN[kind])
    return round(min(1.0, max(0.0, SCORES[kind] + STEP * (up - down))), 6)


def find_spans(text: str) -> list[dict]:
    """All personal data of one text, as rows of ``SPANS``."""
    found = [(kind, a, b, score(kind, text, a, b)) for kind, a, b in _confirmed(text)]
    return ordered([s for s in found if s[0] != "ssn" or s[3] >= SSN_LEAST], KINDS)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): the personal data of every whole text, with scores.

    A NULL or empty text has no spans; a NULL id stays; repeated rows give repeated rows; an empty table
    gives no rows; other columns are not read.  One narrow pass, no shuffle.
    """
    return map_texts(texts(docs, id_col, text_col), id_col, [T.StructField("spans", SPANS)],
                     lambda: lambda text: [(find_spans(text),)])
