"""Running values within a key that may hold most of the rows.

A window over such a key sorts it in one task. Only keys of more than `bucket_rows` rows are cut: a hot key's order column is divided into cells of equal width, and cells that still hold much more are divided again between their own least and greatest value, so that the division follows the data. A row finds its cell by arithmetic, whatever the number of cells. Values run within (key, cell), and what earlier cells bring in comes from one small row for each. Keys that aren't hot take the plain window. Order columns are numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 2_000_000
#: A cell is divided again from so many times bucket_rows.
CROWDED = 4
#: Divisions of one cell; a step that finds nothing crowded is the last.
MOST_LEVELS = 12
#: Hot keys or crowded cells up to which their bounds are broadcast; more are joined.
BROADCAST_CELLS = 100_000
CELL = "__bucket"


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`"))
    return out


def _divided(df: DataFrame, keys: list[str], order: str, bucket_rows: int) -> tuple[DataFrame, bool]:
    """with_buckets(), and whether any key is hot."""
    out = df.withColumn(CELL, F.array().cast("array<long>"))
    for level in range(MOST_LEVELS):
        by = [*keys, CELL]
        found = out.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__low"), F.max(order).alias("__high"))
        cells = found.where((F.col("__n") > bucket_rows * (CROWDED if level else 1)) & (F.col("__high") > F.col("__low"))).select(*by, "__low", ((F.col("__high") - F.col("__low")) / F.ceil(F.col("__n") / bucket_rows)).cast("double").alias("__width"))
        held = cells.limit(BROADCAST_CELLS + 1).collect()
        if not held:
            return out, level > 0
        if len(held) <= BROADCAST_CELLS:
            cells = F.broadcast(df.sparkSession.createDataFrame(held, cells.schema))
        cell = F.floor((F.col(f"l.{order}") - F.col("r.__low")) / F.col("r.__width")).cast("long")
        divided = F.when(F.col("r.__width").isNull(), F.col(f"l.{CELL}")).otherwise(F.concat(F.col(f"l.{CELL}"), F.array(cell)))
        out = out.alias("l").join(cells.alias("r"), _same("l", "r", by), "left").select(*[F.col(f"l.`{c}`") for c in df.columns], divided.alias(CELL))
    return out, True


def with_buckets(df: DataFrame, keys: list[str], order: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with __bucket, an array whose order follows the order column within a key; empty for all rows of a key of at most bucket_rows.

    One aggregation finds the hot keys, their counts and bounds; if there are none, that is all. Each further one looks at the cells so far. Cells are found from the rows' own values, so that they are the same whenever they are computed again. Running values of such rows keep the column.
    """
    return _divided(df, keys, order, bucket_rows)[0]


def _running(df: DataFrame, keys: list[str], order: str, out: str, local: Callable[[Window], Column], summary: Column, carry: Callable[[Window], Column], combine: Callable[[Column, Column], Column], bucket_rows: int, descending: bool = False) -> DataFrame:
    """df with the running value; rows that have a cell already keep it, so that several values can be had for one division."""
    given = CELL in df.columns
    cut, hot = (df, True) if given else _divided(df, keys, order, bucket_rows)
    by = F.col(order).desc() if descending else F.col(order)
    first = F.col(CELL).desc() if descending else F.col(CELL)
    if not hot:
        return df.withColumn(out, local(Window.partitionBy(*keys).orderBy(by)))
    inner = cut.withColumn("__local", local(Window.partitionBy(*keys, CELL).orderBy(by)))
    rest = [c for c in cut.columns if c != out and (given or c != CELL)]
    base = cut.where(F.size(CELL) > 0).groupBy(*keys, CELL).agg(summary.alias("__sum"))
    base = base.select(*keys, CELL, carry(Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    joined = inner.alias("l").join(base.alias("r"), _same("l", "r", [*keys, CELL]), "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in rest], combine(F.col("l.__local"), F.col("r.__carry")).alias(out))


def numbered(df: DataFrame, keys: list[str], order: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Dense numbers from 1 within each key, by a unique order column."""
    return _running(df, keys, order, out, lambda w: F.row_number().over(w).cast("long"), F.count(F.lit(1)), lambda w: F.sum("__sum").over(w), lambda x, c: x + F.coalesce(c, F.lit(0)), bucket_rows)


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sum of value up to and with each row."""
    return _running(df, keys, order, out, lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value), lambda w: F.sum("__sum").over(w), lambda x, c: x + F.coalesce(c, F.lit(0)), bucket_rows)


def running_max(df: DataFrame, keys: list[str], order: str, value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Largest value before each row; null before any."""
    return _running(df, keys, order, out, lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.max(value), lambda w: F.max("__sum").over(w), lambda x, c: F.greatest(x, c), bucket_rows)


def following_min(df: DataFrame, keys: list[str], order: str, value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Least value after each row; null after all."""
    return _running(df, keys, order, out, lambda w: F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.min(value), lambda w: F.min("__sum").over(w), lambda x, c: F.least(x, c), bucket_rows, descending=True)


def previous(df: DataFrame, keys: list[str], order: str, value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Value of the row before, which must not be null itself; null for a key's first row."""
    return _running(df, keys, order, out, lambda w: F.lag(value).over(w), F.max_by(value, order), lambda w: F.last("__sum", ignorenulls=True).over(w), lambda x, c: F.coalesce(x, c), bucket_rows)
