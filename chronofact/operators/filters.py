"""Predicates that every operator shares, as column builders: absent filters add nothing to the plan."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = ("preferred", "normal", "deprecated")


def _time(at: str | datetime.datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def as_of(valid_at: str | datetime.datetime | None = None, system_at: str | datetime.datetime | None = None) -> Column:
    """Half-open on both axes. Without system_at: rows that are current; without valid_at: rows of any validity."""
    if system_at is None:
        out = F.col("system_to").isNull()
    else:
        d = _time(system_at)
        out = (F.col("system_from") <= d) & (F.col("system_to").isNull() | (F.col("system_to") > d))
    if valid_at is not None:
        d = _time(valid_at)
        out = out & (F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") > d))
    return out


def of_rank(rank: str | None = None) -> Column:
    """A named rank replaces the rule that deprecated rows are hidden."""
    if rank is None:
        return F.col("rank") != "deprecated"
    if rank not in RANKS:
        raise ValueError(f"unknown rank {rank!r}; known: {', '.join(RANKS)}")
    return F.col("rank") == rank


def trusted(least: float | None = None) -> Column:
    if least is None:
        return F.lit(True)
    if not 0 <= least <= 1:
        raise ValueError(f"min_confidence must lie between 0 and 1, not {least}")
    return F.col("confidence") >= float(least)


def visible(valid_at=None, system_at=None, rank: str | None = None, min_confidence: float | None = None) -> Column:
    return as_of(valid_at, system_at) & of_rank(rank) & trusted(min_confidence)


def rank_order() -> Column:
    return F.when(F.col("rank") == "preferred", 0).when(F.col("rank") == "normal", 1).otherwise(2)


def canonical_order() -> list[Column]:
    """Preferred before normal before deprecated, then confidence down, then the older, then id: a total order."""
    return [rank_order(), F.desc("confidence"), F.asc("system_from"), F.asc("id")]


def suggest(word: str, known: list[str], most: int = 3) -> list[str]:
    """Known words that contain the word or lie in it, whatever their case: equal ones first, then the shortest."""
    low = word.lower()
    near = [k for k in known if low in k.lower() or k.lower() in low]
    return sorted(near, key=lambda k: (k.lower() != low, len(k), k))[:most]


def known(word: str, words: list[str], what: str) -> str:
    if word not in words:
        near = suggest(word, words)
        raise ValueError(f"unknown {what} {word!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return word
