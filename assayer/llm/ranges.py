"""Ranges of a number that hold about as many rows each, found by counting: the same for the same rows, however they are partitioned.

Rows are counted by the leading bits of the number; where too many share these,
by a few bits more, and so on. The driver gets counts of at most 4,096 parts
and then, in each round, 16 for each part that is too large (of which there are
at most `SPARE` times as many as ranges). A number that very many rows share is
one range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_BITS, MORE_BITS, SPARE = 12, 4, 4


def borders(numbers: DataFrame, column: str, n: int) -> list[int]:
    """Ascending first numbers of all ranges but the first, n - 1 at most. Nulls aren't counted."""
    low, high, total = numbers.agg(F.min(column), F.max(column), F.count(column)).first()
    if not total or n < 2:
        return []
    shift = max(0, (high - low).bit_length() - FIRST_BITS)

    def counted(rows: DataFrame, shift: int) -> dict[int, int]:
        return {p << shift: k for p, k in rows.where(F.col(column).isNotNull()).groupBy(F.shiftright(column, shift).alias("p")).agg(F.count("*").alias("k")).collect()}

    parts = counted(numbers, shift)
    most = total / (SPARE * n)
    while shift:
        large = sorted(p for p, k in parts.items() if k > most)
        if not large:
            break
        finer = max(0, shift - MORE_BITS)
        those = F.broadcast(numbers.sparkSession.createDataFrame([(p >> shift,) for p in large], "_part long"))
        inside = numbers.join(those, F.shiftright(column, shift) == F.col("_part"), "left_semi")
        found = counted(inside, finer)
        parts = {p: k for p, k in parts.items() if k <= most} | found
        most, shift = most if finer else float("inf"), finer
    out, held = [], 0
    for p in sorted(parts):
        if held >= total * (len(out) + 1) / n:
            out.append(p)
        held += parts[p]
    return out


def range_of(column: Column, cuts: list[int]) -> Column:
    """Number of the range that the value is in; null is in the first. By halves of an array: an expression of one size, however many cuts."""
    if not cuts:
        return F.lit(0)
    array = F.lit(np.array(cuts, np.int64))

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["a"] + s["b"], 1)
        under = column < F.element_at(array, F.least(middle + 1, F.lit(len(cuts))))
        return F.when(s["a"] >= s["b"], s).otherwise(F.struct(F.when(under, s["a"]).otherwise(middle + 1).alias("a"), F.when(under, middle).otherwise(s["b"]).alias("b")))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b")), halved, lambda s: s["a"])
    return F.when(column.isNull(), F.lit(0)).otherwise(found)
