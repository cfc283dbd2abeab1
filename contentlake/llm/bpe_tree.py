"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are short. Parts are encoded, and neighbours are joined on the way up: the join
re-encodes a window around the seam that grows on either side until it reaches a place where the split pattern
must begin a new match whatever stands around it. Tokens outside such a window can't change, because matches are
encoded one by one. Joining is associative, and the tree of any shape gives the tokens of the whole text.

Where must a match begin? Between a letter and a white-space character that a letter or digit follows: a match
that holds the letter is a run of letters (or a contraction, which ends with its letters), so it ends there.

Decoding concatenates the bytes of halves up the same kind of tree.

Defined cases: null and empty texts have no tokens; a text without a safe place is re-encoded whole at each join;
repeated rows are each encoded; tables without rows give none; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = re.compile(r"(?<=[^\W\d_])(?=[ \t\n][^\W_])")
LEAF = 16_384


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tree:
    def __init__(self, coder, leaf: int = LEAF):
        self.coder, self.leaf = coder, leaf
        self.flat = coder.encode_ordinary
        self.bytes_of = [b""] * (coder.max_token_value + 1)
        for token in coder.token_byte_values():
            self.bytes_of[coder.encode_single_token(token)] = token
        self.digits = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, text: str) -> list[int]:
        return self.part(text, 0, len(text))

    def part(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.flat(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self.part(text, start, middle), self.part(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[start:end] from those of its halves."""
        a, b = self.safe_before(text, start, middle), self.safe_after(text, middle, end)
        inner = self.flat(text[a:b])
        return left[: len(left) - self.covering(reversed(left), len(text[a:middle].encode()))] + inner + right[self.covering(right, len(text[middle:b].encode())) :]

    def safe_before(self, text: str, start: int, middle: int) -> int:
        """The last safe place of the left half, looking back ever further; else its start.

        The two characters after a place lie in the half, so that the half's own tokens break there too.
        """
        reach = 64
        while True:
            low = max(start, middle - reach)
            places = [m.end() for m in SAFE.finditer(text, low, middle) if m.end() > low]
            if places:
                return places[-1]
            if low == start:
                return start
            reach *= 4

    def safe_after(self, text: str, middle: int, end: int) -> int:
        """The first safe place of the right half, looking ever further; else its end."""
        reach = 64
        while True:
            high = min(end, middle + reach)
            found = next((m.end() for m in SAFE.finditer(text, middle + 1, high) if m.end() - 1 >= middle), None)
            if found is not None:
                return found
            if high == end:
                return end
            reach *= 4

    def covering(self, tokens, size: int) -> int:
        """How many tokens make up so many bytes."""
        count = 0
        tokens = iter(tokens)
        while size > 0:
            size -= len(self.bytes_of[next(tokens)])
            count += 1
        assert size == 0, "a token crosses a safe place"
        return count

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.coder.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def tree(path: str, pattern: str, leaf: int = LEAF) -> Tree:
    return Tree(encoding(path, pattern), leaf)


def encode_column(path: str, pattern: str, text: str = "text", leaf: int = LEAF) -> Column:
    """Token ids of a text column."""

    @F.pandas_udf("array<int>")
    def bpe_encode(texts: pd.Series) -> pd.Series:
        t = tree(path, pattern, leaf)
        return pd.Series([t.encode(x or "") for x in texts], dtype=object)

    return bpe_encode(F.col(text))


def decode_column(path: str, pattern: str, ids: str = "ids", leaf: int = LEAF) -> Column:
    """Bytes of a column of token ids (null: none)."""

    @F.pandas_udf("binary")
    def bpe_decode(lists: pd.Series) -> pd.Series:
        t = tree(path, pattern, leaf)
        return pd.Series([b"" if x is None else t.decode(list(x)) for x in lists], dtype=object)

    return bpe_decode(F.col(ids))


def digest_column(path: str, pattern: str, text: str = "text", leaf: int = LEAF) -> Column:
    """Encode, decode and digest in one pass, so that ids needn't travel between Spark and Python."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def bpe_digest(texts: pd.Series) -> pd.DataFrame:
        t = tree(path, pattern, leaf)
        rows = []
        for x in texts:
            ids = t.encode(x or "")
            listed = ",".join(map(t.digits.__getitem__, ids)).encode()
            rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return bpe_digest(F.col(text))
