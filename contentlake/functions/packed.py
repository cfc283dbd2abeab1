"""Bodies as zstandard frames, as an archive keeps them."""

from __future__ import annotations

from functools import partial

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

LEVEL = 10


def compressed(text: Column, level: int = LEVEL) -> Column:
    """The frame of a text's UTF-8 bytes; null for null."""

    @F.pandas_udf(BinaryType())
    def pack(texts: pd.Series) -> pd.Series:
        coder = zstandard.ZstdCompressor(level=level)
        return texts.map(lambda t: None if t is None else coder.compress(t.encode()))

    return pack(text)


def decompressed(frame: Column) -> Column:
    """The text of a frame; null for null and for what is no frame."""

    def one(coder: zstandard.ZstdDecompressor, data: bytes | None) -> str | None:
        try:
            return None if data is None else coder.decompress(data).decode()
        except (zstandard.ZstdError, UnicodeDecodeError):
            return None

    @F.pandas_udf(StringType())
    def unpack(frames: pd.Series) -> pd.Series:
        return frames.map(partial(one, zstandard.ZstdDecompressor()))

    return unpack(frame)
