"""Packing by power-of-two decomposition.

Every document's ids are cut into full sequences of ``max_tokens`` and then
into pieces whose lengths are the binary digits of what is left, largest
first.  Each piece is a sequence of its own: its length is a power of two, so
it needs no padding, and no sequence crosses two documents.  Sequences of equal length form a bucket, from which
a trainer draws batches of one shape; ``write_buckets`` lays them out that
way.

The cut depends on one document only, so the whole operator is one narrow
pass over the input: no shuffle, no hot key, and a lost task is simply run
again.  ``sequence_id`` is Spark's partition-wise increasing id, which is
unique however many sequences there are and needs no global count.

Ids come from the ``tiktoken`` library over the tokens of the given vocabulary file;
the tests hold them against the ``tokenizers`` library (same ids, about three times the speed).  That library gives up on a run of about a million
white-space characters (its pattern's stack ends); such a text is encoded by this package's own encoder instead, to the same ids.
Texts of any length are packed whole; a task holds one text's ids at a time.
"""

from __future__ import annotations

from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlens.llm.bpe import PATTERN, Encoder, default_vocabulary, token_bytes
from seasonlens.llm.common import map_texts, texts

MAX_TOKENS = 1024


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    ranks, special = token_bytes(path)
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _second(path: str) -> Encoder:
    return Encoder(path)


def ids_of(text: str, path: str) -> bytes:
    """A text's little-endian unsigned 32-bit ids."""
    try:
        return tokenizer(path).encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
    except ValueError:  # the pattern's backtracking stack is too small for a very long run of white space
        return _second(path).encode(text)


def piece_lengths(n: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of ``n`` ids; ``max_tokens`` is a power of two."""
    full, rest = divmod(n, max_tokens)
    return [max_tokens] * full + [1 << k for k in reversed(range(max_tokens.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
         end_id: int = 0, vocabulary_path: str | None = None) -> DataFrame:
    """Sequences: (id, start, length, ids, doc_tokens, bucket, sequence_id, offset).

    ``ids`` holds the piece's little-endian unsigned 32-bit ids, ``start`` the ids of its
    document before it, ``bucket`` the length's power of two, ``doc_tokens`` the document's ids
    with the end id.  A NULL or empty text is the end id alone (one piece of length 1); a NULL id
    stays; a repeated row gives its own sequences; an empty table gives no rows; other columns are not read.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    path = vocabulary_path or default_vocabulary()
    end = int(end_id).to_bytes(4, "little")

    def make():
        def each(text: str):
            ids = ids_of(text, path) + end
            n = len(ids) // 4
            start = 0
            for size in piece_lengths(n, max_tokens):
                yield start, size, ids[4 * start:4 * (start + size)], n, size.bit_length() - 1
                start += size

        return each

    long, binary = T.LongType(), T.BinaryType()
    fields = [T.StructField("start", long), T.StructField("length", long), T.StructField("ids", binary),
              T.StructField("doc_tokens", long), T.StructField("bucket", T.IntegerType())]
    pieces = map_texts(texts(docs, id_col, text_col), id_col, fields, make)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Parquet files of equal-length sequences, one folder a bucket."""
    sequences.write.mode("overwrite").partitionBy("bucket").parquet(path)
