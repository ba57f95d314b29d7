"""Words of a text: maximal runs of bytes other than space and tab to carriage return."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def split_words(body: bytes | None) -> list[bytes]:
    """``bytes.split()`` cuts at exactly the six bytes of the definition."""
    return body.split() if body else []


def spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, with the start and end byte of each word."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def word_array(text: Column) -> Column:
    """Words as an array column; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")
