"""Redundancy strategies by level: how fragments are encoded, and how missing ones come back.  `register` adds one.

Both are functions of DataFrames, so a strategy of one's own joins the same plans as the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recovery, rings


@dataclass(frozen=True)
class Strategy:
    """encode: fragments (object_id, frag_idx, n, data) to what is stored; recover: (stored, expected) to expected with
    data, null where it is lost."""

    encode: Callable[[DataFrame], DataFrame]
    recover: Callable[[DataFrame, DataFrame], DataFrame]


_KNOWN: dict[str, Strategy] = {}


def register(level: str, strategy: Strategy) -> None:
    """Adds a strategy, or replaces one of that level."""
    _KNOWN[level.upper()] = strategy


def known() -> list[str]:
    return sorted(_KNOWN)


def of(level: str) -> Strategy:
    if level.upper() not in _KNOWN:
        raise ValueError(f"no strategy {level}; known are {', '.join(known())}")
    return _KNOWN[level.upper()]


def _ring(fragments: DataFrame) -> DataFrame:
    return rings.ring_encoded(fragments).select("object_id", "frag_idx", "n", "own", "next")


def _frames(fragments: DataFrame) -> DataFrame:
    return rings.cross_encoded(fragments).select("object_id", "frag_idx", "n", recovery.framed(F.col("data"), F.col("one"), F.col("two")).alias("frame"))


def _sealed_recovered(stored: DataFrame, expected: DataFrame) -> DataFrame:
    whole = stored.where(F.sha2(F.concat("own", "next"), 256) == F.col("seal"))
    return rings.ring_recovered(whole, expected)


register("FSS1", Strategy(_ring, rings.ring_recovered))
register("FSS2", Strategy(lambda f: rings.ring_sealed(_ring(f)), _sealed_recovered))
register("FSS5", Strategy(_frames, recovery.frames_recovered))
