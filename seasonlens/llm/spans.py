"""Spans in texts: the result type and the digest columns that secret and PII scans share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# (kind, start, end, score): code points, end exclusive; sorted by start, then by the kind's place in the scan's list.
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def ordered(found: list[tuple[str, int, int, float]], kinds: tuple[str, ...]) -> list[dict]:
    """Spans as rows of ``SPANS``."""
    found.sort(key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    return [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in found]


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def mask(text: str, spans: list[dict], mark: str) -> str:
    """``text`` with every stretch that spans cover replaced by ``mark``."""
    out: list[str] = []
    at = 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def ascii_lower(text: str) -> str:
    """``text`` with A-Z in lower case and every other character as it is."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
