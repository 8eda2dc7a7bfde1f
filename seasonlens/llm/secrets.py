"""Secret scan: keyword prefilter, anchored patterns near hits, checksum validation.

**Method.**  One Aho-Corasick pass over the lower-cased text finds the keywords that
every secret of a kind starts with.  A kind's regular expression is then matched only
at those places (``match`` at the hit, never a search of the text), and what carries an embedded
checksum or structure is validated: GitHub and npm tokens end in the base-62 CRC-32 of their body, a JSON
web token's header is base64url JSON, a private key block (PEM, with or without headers, or PGP) holds base64.  A bare run of hex digits has no keyword; its
prefilter is one linear scan for a run that is long enough.

Kinds, in order: ``assign``, ``access`` and ``hex`` (the base; unvalidated, as their patterns state), then
``github``, ``npm``, ``jwt`` and ``private_key``, which are reported only if they validate.

Within a kind the matches are leftmost and do not overlap; a match that fails a kind's length or
checksum test still takes its place.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlens.llm.common import map_texts, texts
from seasonlens.llm.spans import SPANS, ascii_lower, mask, ordered

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "private_key")

# Keyword -> kind (keywords in lower case).
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "private_key",
}
# The pattern of a kind, matched where a keyword starts.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    # a few header lines (Proc-Type, DEK-Info, Version) may precede the body, line feeds may be written out as \n, and the END line may be missing
    "private_key": re.compile(
        r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[rn])*+[A-Za-z][A-Za-z0-9-]{0,60}+:(?:(?!-----)[^\r\n\\]){0,500}+){0,16}+"
        r"(?:(?P<closed>(?:[A-Za-z0-9+/=\s]++|\\[rn])++)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
        r"|(?P<open>(?:(?:\s|\\[rn])++[A-Za-z0-9+/]{32,}+={0,2})+(?:(?:[\r\n]|\\[rn])++[A-Za-z0-9+/]{2,}+={1,2})?))"),
}
HEX = re.compile(r"[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _checksummed(token: str) -> bool:
    body = token.partition("_")[2]
    return base62_crc32(body[:-6]) == body[-6:]


def _json_header(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def _key_body(m: re.Match) -> bool:
    """Whether a key block holds base64; an armour checksum (=xxxx) may end it, and an open block may stop within a group of four."""
    body = re.sub(r"\s|\\[rn]", "", m["closed"] or m["open"])
    body = re.sub(r"(?<=.)=[A-Za-z0-9+/]{4}$", "", body)
    if m["open"]:
        body = body.rstrip("=")
        body = body[:len(body) // 4 * 4]
    try:
        return len(base64.b64decode(body, validate=True)) >= 16
    except binascii.Error:
        return False


ACCEPT = {
    "assign": lambda m: len(m[2]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: _checksummed(m[0]),
    "npm": lambda m: _checksummed(m[0]),
    "jwt": lambda m: _json_header(m[0]),
    "private_key": _key_body,
}
# Confidence of a span: validated kinds are certain.
SCORES = {"assign": 0.8, "access": 0.8, "hex": 0.5, "github": 1.0, "npm": 1.0, "jwt": 1.0, "private_key": 1.0}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def find_spans(text: str) -> list[dict]:
    """All secrets of one text, as rows of ``SPANS``."""
    found: list[tuple[str, int, int, float]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _automaton().iter(ascii_lower(text)):
        start = last - size + 1
        if start >= done[kind] and (m := PATTERNS[kind].match(text, start)):
            done[kind] = m.end()
            if ACCEPT[kind](m):
                found.append((kind, start, m.end(), SCORES[kind]))
    found += [("hex", m.start(), m.end(), SCORES["hex"]) for m in HEX.finditer(text)]
    return ordered(found, KINDS)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): the secrets of every whole text.

    A NULL or empty text has no spans; a very long text is scanned whole, in linear time; a NULL id stays; repeated rows give repeated rows; an empty table
    gives no rows; other columns are not read.  One narrow pass, no shuffle.
    """
    return map_texts(texts(docs, id_col, text_col), id_col, [T.StructField("spans", SPANS)],
                     lambda: lambda text: [(find_spans(text),)])


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; all rows and columns stay.

    ``length_col``, if the table has it, follows the new text where that changed.  A NULL text stays NULL.
    """
    @F.pandas_udf("string")
    def masked(text):
        return text.map(lambda t: None if t is None else mask(t, find_spans(t), mark))

    new = masked(F.col(f"`{text_col}`"))
    out = docs.withColumn(text_col, new)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        changed = F.col(f"`{text_col}`").isNotNull() & F.col(f"`{text_col}`").contains(mark)
        out = out.withColumn(length_col, F.when(changed, F.length(f"`{text_col}`").cast(kind)).otherwise(F.col(f"`{length_col}`")))
    return out
