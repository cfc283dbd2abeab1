"""Quality rules by compression bands.

zstandard's ratio of compressed to plain size is taken over the whole document and over each fixed chunk of it. A
band of document lengths has its own limits: a whole document below the lower limit repeats itself, above the
upper one it is not text; a chunk below the chunk limit is a repetitive stretch, of which a document may have only
a share. Base rules on words stand beside it. Everything is one pass over a row's text: a map without a shuffle.

Defined cases: null and empty texts have no words and fail the base rule; texts of any length are read whole;
repeated rows are each judged; tables without rows give none; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from contentlake.llm.common import WHITE

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits for documents of at least ``least`` bytes."""

    least: int
    low: float
    high: float


#: Compressed size as a share of the plain size. Short texts compress worse, so their limits lie higher. Upper limits
#: lie between clean labelled text (at most 0.72, 0.68, 0.58, 0.52 and 0.45 from 256 bytes on, by band; 0.53 in chunks)
#: and random base64, printable or CJK text cut into words (at least 0.80, 0.76, 0.74, 0.73 and 0.72; 0.73). Random
#: hexadecimal digits, and letters below 2048 bytes, compress like clean text, so no ratio tells them.
BANDS = (Band(0, 0.40, 0.86), Band(256, 0.40, 0.76), Band(512, 0.30, 0.72), Band(1024, 0.26, 0.66), Band(2048, 0.24, 0.58), Band(8192, 0.20, 0.54))
CHUNK, BAD_SHARE = 2048, 0.34
#: Limits of chunks by their length: a last chunk takes in the rest of its text, and the longer it is, the better it compresses.
CHUNKS = (Band(0, 0.22, 0.59), Band(3072, 0.20, 0.57))
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks double, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    w = np.fromiter((index.setdefault(x, len(index)) for x in words), np.int64, n)
    size = len(index)
    if size < 2_000_000:
        triple = (w[:-2] * size + w[1:-1]) * size + w[2:]
    else:  # number the pairs first, so that products stay small
        pairs = np.unique(w[:-1] * size + w[1:], return_inverse=True)[1]
        triple = pairs[:-1] * size + w[2:]
    _, place, count = np.unique(triple, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def ratios(data: bytes, coder: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """Of the whole, and of each full chunk (a rest joins the last one) with its length; 1 and none for no data."""
    if not data:
        return 1.0, []
    whole = len(coder.compress(data)) / len(data)
    count = len(data) // CHUNK
    cuts = [k * CHUNK for k in range(count)] + [len(data)]
    return whole, [(b - a, len(coder.compress(data[a:b])) / (b - a)) for a, b in zip(cuts, cuts[1:], strict=False)] if count else []


def band_of(length: int, bands: tuple[Band, ...]) -> Band:
    return max((b for b in bands if length >= b.least), key=lambda b: b.least)


def in_band(data: bytes, whole: float, chunks: list[tuple[int, float]], bands: tuple[Band, ...] = BANDS) -> tuple[bool, float]:
    """The method's verdict, and the share of chunks out of the limits of their length."""
    band = band_of(len(data), bands)
    limits = [(band_of(n, CHUNKS), ratio) for n, ratio in chunks]
    bad = sum(not b.low <= ratio <= b.high for b, ratio in limits) / len(limits) if limits else 0.0
    return bool(band.low <= whole <= band.high and bad <= BAD_SHARE), bad


def judge(text: str | None, coder: zstandard.ZstdCompressor, bands: tuple[Band, ...] = BANDS) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = repeated_words(words)
    failed = n < 50 or 100 * repeat > 50 * n
    whole, chunks = ratios(data, coder)
    fine, bad = in_band(data, whole, chunks, bands)
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeat, failed, whole, bad, not failed and fine


def judge_column(text: str = "text", bands: tuple[Band, ...] = BANDS, level: int = 3) -> Column:
    """Struct of counts, ratios and verdict for a text column."""

    @F.pandas_udf(FIELDS)
    def compression_bands(texts: pd.Series) -> pd.DataFrame:
        coder = zstandard.ZstdCompressor(level=level, write_content_size=False)
        return pd.DataFrame([judge(t, coder, bands) for t in texts], columns=[f.split()[0] for f in FIELDS.split(", ")])

    return compression_bands(F.col(text))
