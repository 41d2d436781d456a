"""Text columns that several operators share. All are built-in expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: All of ASCII but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are. Texts of ASCII alone take the faster path."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, between: str) -> Column:
    """The words between matches of a pattern; no words for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(x) with x computed once for each row, also where body reads it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def named(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; where a table has several of one name (apart from case), the first."""
    first: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        first.setdefault(c.lower(), i)
    fresh = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return fresh.select(*[F.col(f"_{first[n]}").alias(n) for n in names])


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the named columns as they are and all others under names that no operator uses, and what puts the columns
    back. So columns that docs happens to have can't clash with those of an operator."""
    lower = [c.lower() for c in docs.columns]
    at = {lower.index(n.lower()): n for n in names}
    fresh = [at.get(i, f"_column_{i}") for i in range(len(docs.columns))]
    return docs.toDF(*fresh), lambda df: df.select(*fresh).toDF(*docs.columns)
