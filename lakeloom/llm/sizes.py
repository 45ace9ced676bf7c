"""Sizes of texts in tokens of the byte-level tokenizer of ByT5, without its end token: their UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_tokens(text: Column) -> Column:
    """A null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def char_start(data: bytes | memoryview, at: int) -> int:
    """The greatest position up to ``at`` where a character of the UTF-8 text begins or the text ends."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def char_end(data: bytes | memoryview, at: int) -> int:
    """The least position from ``at`` on where a character begins or the text ends."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at
