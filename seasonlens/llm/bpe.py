"""Byte-level BPE: backtracking encoder and offset-table decoder.

**Method.**  An Aho-Corasick automaton over all vocabulary tokens finds the
longest token at every byte of a pre-token.  The encoder walks left to right,
tries the longest token and accepts it only if the pair (previous token, this
token) is *compatible*: re-encoding the two side by side would leave them as
they are.  If it is not, it tries the token's next shorter prefix token, and
if none is left it takes back the previous token.  A bit for every position
stops a position from being tried twice, so the time is linear and the result
is exactly the merge-by-merge result.  Compatibility is decided by undoing the
later of the two tokens' merges step by step against the merge table.

Pre-tokens are cut by the byte-level pattern.  Words repeat, so the ids of a
space-separated word (a single space between two other characters is always
a cut) are kept in a bounded per-task memo; a miss runs the encoder.

Decoding concatenates token bytes by an offset table: one byte blob, one start
and one length per id, gathered with numpy for a whole document at once.

The vocabulary file is a parameter (a ``tokenizers`` JSON file with a
byte-level BPE model); its special tokens in a text become their own ids,
as the ``tokenizers`` library does by default.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlens.llm.common import map_texts, texts

# Entries of one generation of a task's memos (words, pre-tokens, token pairs).
MEMO_SIZE = 100_000
# Longer words are encoded without being kept.
MEMO_CHARS = 48

# The byte-level pre-token pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 stands for itself,
    every other byte, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes of every ordinary token -> id, special token -> id) of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special


class Vocabulary:
    """Tables of one vocabulary file.  Tokens are numbered by merge rank inside: the 256
    bytes, then one number a merge; ``ids`` has the file's id
    of each rank as four bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]

        def raw(token: str) -> str:
            return "".join(chr(alphabet[c]) for c in token)  # one character a byte

        by_char = {b: c for c, b in alphabet.items()}
        names = [by_char[b] for b in range(256)]
        self.rank: dict[str, int] = {chr(b): b for b in range(256)}
        split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = self.rank[raw(left)], self.rank[raw(right)]
            whole = raw(left + right)
            if whole in self.rank:  # a second way to a known token changes nothing
                self.pairs.setdefault((a, b), self.rank[whole])
                continue
            self.rank[whole] = self.pairs[a, b] = len(split)
            split.append((a, b))
            names.append(left + right)
        self.split = split
        self.words = list(self.rank)
        self.lengths = [len(w) for w in self.words]
        self.ids = [vocab[n].to_bytes(4, "little") for n in names]
        self.shorter = [self._longest_prefix(w) for w in self.words]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.automaton = ahocorasick.Automaton()
        for word, r in self.rank.items():
            self.automaton.add_word(word, (r, len(word)))
        self.automaton.make_automaton()
        self.joint: dict[int, bool] = {}

    def _longest_prefix(self, word: str) -> int:
        for n in range(len(word) - 1, 0, -1):
            if (r := self.rank.get(word[:n])) is not None:
                return r
        return -1

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` stays that way under the merges.

        Undo merges on the two sides of the seam, the later one first; if at any
        time the two inner tokens have a merge that comes before those undone so
        far, the real encoder would have merged across the seam.
        """
        pairs, split, bound = self.pairs, self.split, len(self.split) + 1
        while True:
            merged = pairs.get((a, b))
            if merged is not None and merged < bound:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                bound, a = a, split[a][1]
            else:
                bound, b = b + 1, split[b][0]

    def encode_pretoken(self, data: str) -> bytes:
        """Little-endian ids of one pre-token; ``data`` has one character a byte."""
        n = len(data)
        longest = [0] * n
        for end, (r, size) in self.automaton.iter(data):
            longest[end - size + 1] = r  # a later end is a longer token
        lengths, shorter, joint = self.lengths, self.shorter, self.joint
        if len(joint) > MEMO_SIZE:
            joint.clear()
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, last, token = 0, -1, longest[0] if n else -1
        while pos < n:
            end = pos + lengths[token]
            if open_at[end]:
                fits = True
                if last >= 0:
                    key = last << 32 | token
                    fits = joint.get(key)
                    if fits is None:
                        fits = joint[key] = self.compatible(last, token)
                if fits:
                    out.append(token)
                    last, pos = token, end
                    if pos < n:
                        token = longest[pos]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:  # no token fits here: take the previous one back and go on with its shorter prefix
                open_at[pos] = 0
                token = out.pop()
                pos -= lengths[token]
                last = out[-1] if out else -1
        ids = self.ids
        return b"".join([ids[r] for r in out])


class Memo:
    """A bounded memo of two generations: what is used stays, what is not falls out."""

    def __init__(self, size: int = MEMO_SIZE):
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Offsets:
    """Offset table of the decoder, blob[start[id] : start[id] + length[id]]; a decoding task holds none of the encoder's tables."""

    def __init__(self, path: str):
        ordinary, special = token_bytes(path)
        parts = [b""] * (max([*ordinary.values(), *special.values()]) + 1)
        for data, i in ordinary.items():
            parts[i] = data
        for text, i in special.items():
            parts[i] = text.encode()
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.length = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])


@lru_cache(maxsize=2)
def offsets(path: str) -> Offsets:
    return Offsets(path)


class Encoder:
    """Encodes texts to little-endian 32-bit ids, with a bounded memo of words."""

    _pattern = regex.compile(PATTERN)
    _odd_space = re.compile(r"\s | \s|^\s|\s$")
    _cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.words = Memo()
        self.parts = Memo()
        special = sorted(self.vocab.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(self, text: str) -> bytes:
        if self.special is None or not any(s in text for s in self.vocab.special):
            return self._plain(text)
        ids = self.vocab.special
        return b"".join(
            int(ids[part]).to_bytes(4, "little") if part in ids else self._plain(part)
            for part in self.special.split(text) if part)

    def _plain(self, text: str) -> bytes:
        words = self._cut.split(text) if self._odd_space.search(text) else text.split(" ")
        out = [self._pretokens(words[0])]
        memo = self.words
        for word in words[1:]:
            ids = memo.new.get(word)
            if ids is None:
                ids = memo.old.get(word)
                if ids is None:
                    ids = self._pretokens(" " + word)
                if len(word) <= MEMO_CHARS:
                    memo.put(word, ids)
            out.append(ids)
        return b"".join(out)

    def _pretokens(self, text: str) -> bytes:
        out: list[bytes] = []
        memo = self.parts
        for part in self._pattern.findall(text):
            ids = memo.new.get(part)
            if ids is None:
                ids = memo.old.get(part)
                if ids is None:
                    ids = self.vocab.encode_pretoken(part if part.isascii() else part.encode("utf-8").decode("latin-1"))
                if len(part) <= MEMO_CHARS:
                    memo.put(part, ids)
            out.append(ids)
        return b"".join(out)


class Decoder:
    """Texts of little-endian 32-bit ids, by the offset table."""

    def __init__(self, path: str):
        self.table = offsets(path)

    def decode(self, data: bytes) -> str:
        v = self.table
        ids = np.frombuffer(data, dtype="<u4")
        if not len(ids):
            return ""
        size = v.length[ids]
        ends = np.cumsum(size)
        shift = np.repeat(v.start[ids] - (ends - size), size)
        return v.blob[np.arange(ends[-1]) + shift].tobytes().decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               vocabulary_path: str | None = None) -> DataFrame:
    """(id, ids, n_tokens): the whole text of every row as token ids.

    ``ids`` holds little-endian unsigned 32-bit ids.  A NULL or empty text has no ids; a NULL
    id stays; repeated rows give repeated rows; other columns are not read.  A very long text
    or word costs linear time.  No shuffle: one pass over the rows.
    """
    path = vocabulary_path or default_vocabulary()

    def make():
        encoder = Encoder(path)

        def each(text: str):
            ids = encoder.encode(text)
            yield ids, len(ids) // 4

        return each

    return map_texts(texts(docs, id_col, text_col), id_col,
                     [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], make)


def bpe_decode(ids: Column, vocabulary_path: str | None = None) -> Column:
    """The text of a column of little-endian 32-bit ids (NULL stays NULL); bytes that are not UTF-8 become U+FFFD."""
    path = vocabulary_path or default_vocabulary()

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        decoder = Decoder(path)
        return pa.array([decoder.decode(x.as_py()) if x.is_valid else None for x in column], pa.string())

    return decode(ids)
