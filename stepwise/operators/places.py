"""Places of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in a range, about, and ranges at most; rows that are drawn for each bound, as some may be equal.
RANGE_ROWS, RANGES, DRAWN = 50_000, 1000, 4


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 1 in ``order`` (ascending, nulls first), by ranges that are counted.

    A range lies between two of the rows' values in all columns of ``order``:
    those of the smallest hashes, more of them the more rows there are.  Each
    range is numbered by itself; only rows that agree in all columns can't be
    told apart, and stay together.
    """
    n = rows.count()
    wanted = min(RANGES, n // RANGE_ROWS)
    key = F.struct(*[F.col(c) for c in order])
    kind = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in order])
    rows = rows.withColumn("_key", key)
    part = F.lit(0)
    if wanted:
        near = F.xxhash64(*order)
        drawn = rows.select("_key", near.alias("h")).orderBy("h").limit(DRAWN * wanted).select("_key").distinct().limit(wanted).collect()
        # At most RANGES rows, in a column of one row.
        bounds = rows.sparkSession.createDataFrame([([r["_key"] for r in drawn],)], T.StructType([T.StructField("_bounds", T.ArrayType(kind))]))
        rows = rows.join(F.broadcast(bounds.select(F.array_sort("_bounds").alias("_bounds"))))
        part = F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))
    rows = rows.withColumn("_range", part).drop("_bounds", "_key")
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row a range.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return rows.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_before")
