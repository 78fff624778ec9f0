"""Order columns packed into one number of fixed width, so that first and last per key aggregate by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HALF = 62  # bits of a long that are used; two longs make a decimal of 38 digits
_TYPE_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "date": 32}


def _number(df: DataFrame, column: str) -> Column:
    return F.unix_date(column) if dict(df.dtypes)[column] == "date" else F.col(column).cast("long")


def order_widths(df: DataFrame, columns: Iterable[str] | Mapping[str, int]) -> dict[str, int] | None:
    """Bits of each order column: as stated, or by its type. None if a type has no small width, such as a bigint or a text."""
    if isinstance(columns, Mapping):
        return dict(columns)
    types = dict(df.dtypes)
    widths = {c: _TYPE_BITS.get(types[c]) for c in columns}
    return None if None in widths.values() else widths


def packed_order(df: DataFrame, columns: Iterable[str] | Mapping[str, int], last: Column, bits: int) -> tuple[Column, Callable[[Column], Column]] | None:
    """One number that sorts as ``columns`` and then ``last`` do, and the function that gets ``last`` back from it.

    ``columns`` may state how many bits each column's whole numbers from 0 need; a value that needs more is an error at run time.
    Otherwise whole-number types and dates tell it themselves. ``last`` is a whole number of ``bits`` bits, from 0. NULL sorts first.
    Up to 62 bits make a long, up to twice as many a decimal; None if the columns need more or have other types.
    """
    widths = order_widths(df, columns)
    if widths is None:
        return None
    stated = isinstance(columns, Mapping)
    parts: list[tuple[Column, int]] = []
    for name, width in widths.items():
        value = _number(df, name)
        if stated:
            fits = (value >= 0) & (value < 2**width - 1)
            value = F.when(fits, value + 1).when(value.isNotNull(), F.raise_error(F.lit(f"{name} needs more than the stated {width} bits")).cast("long"))
        else:
            value, width = value + F.lit(2 ** (width - 1) + 1), width + 1
        parts.append((F.coalesce(value, F.lit(0).cast("long")), width))
    parts.append((F.coalesce(last.cast("long"), F.lit(0).cast("long")), bits))

    halves: list[tuple[Column | None, int]] = []
    number, used = None, 0
    for value, width in reversed(parts):
        if used + width > _HALF:
            halves.append((number, used))
            number, used = None, 0
        shifted = F.shiftleft(value, used) if used else value
        number, used = (shifted if number is None else number.bitwiseOR(shifted)), used + width
    halves.append((number, used))
    mask = 2**bits - 1
    if len(halves) == 1:
        return halves[0][0], lambda key: key.bitwiseAND(F.lit(mask).cast("long")).cast("int")
    if len(halves) > 2 or any(used > _HALF for _, used in halves):
        return None
    (low, below), (high, _) = halves
    wide = "decimal(38,0)"
    key = (high.cast(wide) * F.lit(2**below).cast("decimal(19,0)")).cast(wide) + low.cast(wide)
    return key.cast(wide), lambda key: (key % F.lit(mask + 1).cast(wide)).cast("int")
