"""Text helpers as column expressions: tokens, JSON array recovery, URL parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace class used as the token separator (same in Java and RE2 syntax).
TOKEN_SEPARATOR = "[ \\t\\r\\n]+"


def tokens(text: str | Column) -> Column:
    """Whitespace tokens of a text, empty strings removed."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, TOKEN_SEPARATOR), lambda w: w != F.lit(""))


def extract_json_array(text: str | Column, element: T.DataType) -> Column:
    """parse a JSON array out of free text.

    The whole text is tried first; otherwise the span from the first ``[``
    to the last ``]`` (dot matches newlines).  A text that is a JSON object is no array.  Returns
    ``struct<value: array<element>, status: string>`` where status is
    ``whole``, ``extracted``, ``no_array`` (no bracket span: the "not found"
    error) or ``bad_array`` (a span that does not parse, or an array with an element that is NULL or not of the wanted
    type); the value is NULL in the last two.
    """
    t = F.col(text) if isinstance(text, str) else text
    schema = T.ArrayType(element)
    def sound(array: Column) -> Column:
        return F.when(~F.exists(array, lambda x: x.isNull()), array)

    whole = sound(F.when(F.ltrim(t).startswith("["), F.from_json(t, schema)))
    span = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    inner = sound(F.from_json(span, schema))
    status = (
        F.when(whole.isNotNull(), F.lit("whole"))
        .when(span == F.lit(""), F.lit("no_array"))
        .when(inner.isNotNull(), F.lit("extracted"))
        .otherwise(F.lit("bad_array"))
    )
    return F.struct(F.coalesce(whole, inner).alias("value"), status.alias("status"))


def percent_encode(c: str | Column) -> Column:
    """Percent-encoding with the rules of Python's ``urllib.parse.quote``.

    ``url_encode`` (form encoding) differs in four places, fixed here: a space
    becomes ``%20`` instead of ``+`` (a literal ``+`` is already ``%2B``),
    ``~`` and ``/`` stay literal, ``*`` is encoded.
    """
    e = F.url_encode(F.col(c) if isinstance(c, str) else c)
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    e = F.replace(e, F.lit("%2F"), F.lit("/"))
    return F.replace(e, F.lit("*"), F.lit("%2A"))
