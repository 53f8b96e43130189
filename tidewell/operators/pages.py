"""Deep pages of an order: the page's place is found by counting ranges, so nothing before it is sorted or moved.

A sample of the first key's values cuts its range into cells, each value of the sample being a cell of its own; one aggregate counts the rows
of all cells. The cell that holds the page's first row is looked into in the same way, by the next key where all its rows share this one's
value, until it has at most MOST rows. What of the page lies in later cells is their first few rows. A page of any depth so costs a few
counting passes, whose range conditions on plain columns reach the scan, and sorts of bounded size.

Defined cases: nulls come first in an ascending order and last in a descending one, as Spark has them; rows that tie in all keys come in an
arbitrary order, so give a total one; a page behind the last row is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted for a page without being counted further.
MOST = 100_000
#: Rows of a sample, and bounds that are taken from it.
SAMPLE, BOUNDS = 1024, 48


def _bounds(rows: DataFrame, key: str, descending: bool, keys: list[str]) -> list:
    """Distinct values of a key in their order, from a sample by hash."""
    sample = rows.where(F.col(key).isNotNull()).select(key, F.xxhash64(*keys).alias("_h")).orderBy("_h").limit(SAMPLE).select(key).distinct()
    values = [r[0] for r in sample.orderBy(F.desc(key) if descending else F.asc(key)).collect()]
    return values if len(values) <= BOUNDS else [values[k * len(values) // BOUNDS] for k in range(BOUNDS)]


def _cell(value: Column, bounds: list[Column], descending: bool) -> Column:
    """0 before all bounds, 1 at the first, 2 behind it, and so on; nulls at the end where they are sorted to."""
    steps = [(value <= b, value < b) if descending else (value >= b, value > b) for b in bounds]
    one = lambda test: F.when(test, 1).otherwise(0)
    total = reduce(lambda a, b: a + b, (one(x) for pair in steps for x in pair), F.lit(0))
    return F.when(value.isNull(), 2 * len(bounds) + 1 if descending else -1).otherwise(total)


def _inside(value: Column, bounds: list[Column], cell: int, descending: bool) -> Column:
    """Rows of one cell, as plain comparisons."""
    if cell in (-1, 2 * len(bounds) + 1):
        return value.isNull()
    if cell % 2:
        return value == bounds[cell // 2]
    after = lambda b: value < b if descending else value > b
    before = lambda b: value > b if descending else value < b
    parts = [after(bounds[cell // 2 - 1])] if cell else []
    parts += [before(bounds[cell // 2])] if cell // 2 < len(bounds) else []
    return reduce(lambda a, b: a & b, parts, value.isNotNull())


def page(rows: DataFrame, keys: list[tuple[str, bool]], offset: int, size: int, most: int = MOST) -> DataFrame:
    """Rows offset to offset + size of rows in the order of keys, (column, descending) each."""
    names = [k for k, _ in keys]
    order = [F.desc(k) if down else F.asc(k) for k, down in keys]
    pieces, subset, n, level = [], rows, rows.count(), 0
    while n > most and level < len(keys) and offset < n:
        key, down = keys[level]
        kind = rows.schema[key].dataType
        bounds = [F.lit(v).cast(kind) for v in _bounds(subset, key, down, names)]
        cell = _cell(F.col(key), bounds, down)
        counts = sorted(map(tuple, subset.groupBy(cell.alias("cell")).count().collect()))  # twice the bounds, and two
        before = 0
        for at, count in counts:
            if before + count > offset:
                break
            before += count
        taken = min(size, before + count - offset)
        if taken < size:  # the page goes on behind the cell: there it is a top-k of its size
            pieces.append(subset.where(cell > at).orderBy(*order).limit(size - taken))
        subset, offset, size, n = subset.where(_inside(F.col(key), bounds, at, down)), offset - before, taken, count
        level += at % 2 != 0  # one value, or null: the next key decides
    pieces.append(subset.orderBy(*order).limit(offset + size).offset(offset))
    return reduce(DataFrame.union, pieces).orderBy(*order)
