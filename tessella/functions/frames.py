"""Spans of a signal as column expressions: the clip that is taken of it, and its frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, LONGEST, FRAMES = 0.10, 180.0, 96


def clip_start(length: Column, start: float = START) -> Column:
    """Where a clip begins, in the unit of the length: behind its first part."""
    return length.cast("double") * start


def clip_length(length: Column, start: float = START, longest: float = LONGEST) -> Column:
    """How long a clip is: what is left behind its start, at most `longest`."""
    return F.least(length.cast("double") - clip_start(length, start), F.lit(longest))


def tiles(length: Column, size: int = FRAMES) -> Column:
    """The first places of the whole frames of `size` in a signal of this length, none for a shorter one."""
    n = F.floor(length / size).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: i * size)).otherwise(F.array().cast("array<long>"))
