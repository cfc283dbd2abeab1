"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Its tokens' byte spans follow from the byte length of each token; they are
mapped to characters and interval-joined with the character spans of the document's fields or sections: both
lists are sorted, so the join is a binary search of section starts. A token that crosses a boundary goes, by an
explicit rule, to the section that holds most of its characters, to the earlier one at a tie; a token inside one
character (byte-level tokens can be) goes to that character's section.

Sections are given as a list of their first characters' places; a section ends where the next begins. Here they
are a document's lines, each with its line end.

Defined cases: null texts have no section; empty texts have one empty section without tokens; texts of any length
are encoded whole; repeated rows are each counted; tables without rows give none; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contentlake.llm.bpe_tree import tree
from contentlake.llm.common import small_batches


def line_starts(text: str) -> np.ndarray:
    """Where the lines of a text begin; a last line without characters doesn't count."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    return np.concatenate([[0], ends[ends < len(points)]])


def attribute(text: str, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each section, from the sections' first characters and the tokens' byte lengths."""
    data = np.frombuffer(text.encode(), np.uint8)
    char_at = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
    ends = np.cumsum(lengths)
    first = char_at[ends - lengths]
    last = char_at[ends - 1]  # inclusive
    low = np.searchsorted(starts, first, "right") - 1
    high = np.searchsorted(starts, last, "right") - 1
    edges = np.append(starts, len(text))
    for k in np.flatnonzero(low != high):  # the few that cross a boundary
        inside = np.arange(low[k], high[k] + 1)
        share = np.minimum(edges[inside + 1], last[k] + 1) - np.maximum(edges[inside], first[k])
        low[k] = inside[share.argmax()]
    return np.bincount(low, minlength=len(starts))


def section_tokens(docs: DataFrame, path: str, pattern: str, sections: Callable[[str], np.ndarray] = line_starts) -> DataFrame:
    """One row per document and section: doc_id, section (from 0), start, n_chars, n_tokens."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree(path, pattern)
        size_of = np.array([len(b) for b in coder.bytes_of], np.int64)
        for batch in batches:
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                starts = sections(text)
                ids = np.array(coder.encode(text), np.int64)
                counts = attribute(text, starts, size_of[ids]) if len(ids) else np.zeros(len(starts), np.int64)
                parts.append((doc, starts, np.diff(np.append(starts, len(text))), counts))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, s, _, _ in parts for _ in range(len(s))], pa.int64()),
                        pa.array(np.concatenate([np.arange(len(s)) for _, s, _, _ in parts]), pa.int32()),
                        *(pa.array(np.concatenate([p[k] for p in parts]), pa.int64()) for k in (1, 2, 3)),
                    ],
                    ["doc_id", "section", "start", "n_chars", "n_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, section int, start long, n_chars long, n_tokens long")
