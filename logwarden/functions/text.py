"""Text and null handling on columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\r\x0b\x0c"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str) -> Column:
    """NULL as empty text."""
    return F.coalesce(col(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every ASCII white-space character, not only blanks."""
    return F.trim(col(c), F.lit(ASCII_SPACE))


def first_filled(*cols: Column | str, default: str | None = "") -> Column:
    """First value that is not blank after trimming."""
    options = [F.nullif(strip(c), F.lit("")) for c in cols]
    if default is not None:
        options.append(F.lit(default))
    return F.coalesce(*options)


def first_present(*cols: Column | str) -> Column:
    """First value that is neither NULL nor empty, untrimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def field(df: DataFrame, name: str) -> Column:
    """``df[name]`` as non-null text, or empty text when the column is absent."""
    return nz(name) if name in df.columns else F.lit("")


def has(c: Column, *needles: str) -> Column:
    """Any of the substrings occurs."""
    return any_true([c.contains(n) for n in needles])


def ends(c: Column, *suffixes: str) -> Column:
    return any_true([c.endswith(s) for s in suffixes])


def starts(c: Column, *prefixes: str) -> Column:
    return any_true([c.startswith(p) for p in prefixes])


def any_true(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False)) if not conditions else reduce(or_, conditions)


def pick(values: Sequence[str], index: Column) -> Column:
    """``values[index]`` with 1-based ``index``; the list folds to one literal."""
    separator = "\x1f"
    return F.element_at(F.split(F.lit(separator.join(values)), separator), index)


def computed_once(df: DataFrame, name: str) -> DataFrame:
    """Keep an expensive column from being copied into later filters.

    Spark pushes a filter below a projection by substituting the expression,
    so a filter on a long CASE would evaluate it twice and blow up planning.
    A generator is a boundary that filters do not cross.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(F.col(name))).alias(name))


def named_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it; inside lambdas too.

    Spark shares repeated expressions neither inside the function of a
    higher-order function nor between the branches of a CASE.
    """
    return F.transform(F.array(value), use)[0]


def cut_text(c: Column, limit: int, keep: int, tail: str = "...") -> Column:
    """Text longer than ``limit`` becomes its first ``keep`` characters and ``tail``."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit(tail))).otherwise(c)


def to_long(c: Column | str) -> Column:
    """Base-10 integer text as a number, anything else 0.

    ``try_cast`` alone would also accept surrounding blanks and fractions.
    """
    c = col(c)
    return F.when(c.rlike(r"^[+-]?\d+$"), F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))).otherwise(
        F.lit(0).cast("bigint")
    )
