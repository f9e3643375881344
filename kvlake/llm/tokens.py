"""Operator 3, token counts, and the token ids operator 1 packs. Free style: Arrow batches through the tokenizer libraries.

A text is cut at boundaries that no token crosses (so the pieces' tokens are the text's tokens) and each distinct
piece is encoded once and remembered. Invented or natural, words repeat; the memory is bounded (CACHE pieces of at most
LONGEST characters or bytes, two generations) and never changes a result.

- word_bpe_49k drops white space before merging: ASCII white space is a safe boundary.
- byte_bpe_50k joins one space to the word after it: the place before a single space between two characters that
  aren't white space is safe, and so are both sides of a single line feed between such characters. Texts with other
  white space are cut at the safe places only, whatever the pieces' lengths.

Plain pieces (Latin letters, digits, ASCII punctuation) go through tiktoken's merge loop on the same vocabulary,
which is several times faster; anything else, special strings included, goes through the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

CACHE = 400_000
#: Longer pieces (unspaced scripts, addresses, encoded data) seldom repeat and are not remembered.
LONGEST = 64

#: Pieces of these characters lower, normalise and split alike in both libraries.
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-įĲ-ňŊ-ſ]*")
ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]|(?:^|[ \n])[ \n]|[ \n]$")
SAFE = re.compile(r"(?<=\S) (?=\S)")


class Memo(dict):
    """Remembers make(key); holds at most two generations of size entries, and no text longer than LONGEST."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if isinstance(key, str | bytes) and len(key) > LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranked(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _bytes_of() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of a lower-casing BPE with word ends; a piece's ids are kept as little-endian 32-bit numbers."""

    END = b"\xff"  # no UTF-8 text holds it

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model = json.load(open(path))
        suffix, chars = model["model"]["end_of_word_suffix"], _bytes_of()
        special = {t["content"] for t in model["added_tokens"]}
        # rank 0..255: a byte and the word's end, which start as one symbol; then bytes and the end alone; then merges
        self.ids, ranks = {}, {}
        vocab = sorted(((i, t) for t, i in model["model"]["vocab"].items() if t not in special))
        as_bytes = lambda t: bytes(chars[c] for c in (t[: -len(suffix)] if t.endswith(suffix) else t)) + self.END * t.endswith(suffix)
        known = [(i, as_bytes(t)) for i, t in vocab]
        ends = [x for x in known if len(x[1]) == 2 and x[1].endswith(self.END)]
        plain = [x for x in known if not (len(x[1]) == 2 and x[1].endswith(self.END))]
        for i, b in [*ends, *plain]:
            self.ids[len(ranks)] = i
            ranks[b] = len(ranks)
        ranks.setdefault(self.END, len(ranks))
        self.end_rank = ranks[self.END]
        self.core = _ranked(ranks)._core_bpe
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.pack = lambda ids: np.array(ids, "<u4").tobytes()
        self.pieces = Memo(self.piece)

    def piece(self, raw: bytes) -> bytes:
        text = raw.decode()
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        low, out = text.lower(), []
        for word in (low,) if low.isalpha() else self.split(low):
            out += self.core.encode_single_piece(word.encode() + self.END)
        if self.end_rank in out:
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        return self.pack([self.ids[x] for x in out])

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each."""
        return b"".join(map(self.pieces.__getitem__, (text or "").encode().split()))


class ByteTokenizer:
    """Numbers of tokens under a byte-level BPE."""

    def __init__(self, path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = Memo(lambda w: self.piece(w))
        self.later = Memo(lambda w: self.piece(b" " + w))

    def piece(self, raw: bytes) -> int:
        text = raw.decode()
        if "<|" in text or not PLAIN.fullmatch(text, raw[:1] == b" "):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        return len(self.plain._core_bpe.encode_ordinary(text))

    def count(self, text: str | None) -> int:
        """The number of tokens of a whole text."""
        if not text:
            return 0
        if ODD_SPACE.search(text):
            return sum(len(self.whole.encode(x, add_special_tokens=False).ids) for x in safe_slices(text))
        lines = text.encode().split(b"\n")
        n = len(lines) - 1
        for line in lines:
            head, *rest = line.split(b" ")
            n += self.first[head] + sum(map(self.later.__getitem__, rest))
        return n


def safe_slices(text: str, size: int = 1 << 14) -> Iterator[str]:
    """Slices of about size characters, cut before single spaces between two characters that aren't white space."""
    start = 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.cache
def byte_tokenizer(path: str, ranks_path: str) -> ByteTokenizer:
    return ByteTokenizer(path, ranks_path)


def token_counts(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): one row for each row of docs, lengths only.

    Null text counts as empty: no bytes, no tokens. Repeated rows give repeated rows, null ids are kept, other columns are
    ignored whatever their names. An empty table gives no rows. Nothing is shuffled: scans are cut by
    bytes, so are the slices of an Arrow batch, and long texts are encoded piece by piece.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    ranks_path = ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = byte_tokenizer(path, ranks_path)
        for b in by_bytes(batches, 2):
            n = pa.array([t.count(x) for x in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["id", "n_bytes", "n_tokens"])

    one = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = one.mapInArrow(count, f"id {one.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
