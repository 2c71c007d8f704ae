"""A table's order as numbers, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.sources.versions import kept

#: Rows of a task are counted from its number times this.
STRIDE = 1 << 33


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the place (from 1) of each row in the ascending order of these columns, which together tell rows apart.

    Rows are dealt by range, as many ranges as a shuffle has partitions, sorted in each and written, so that ranges are the same whenever
    they are read; what comes before a range is added to a row's place in it. The driver gets one count a range. Nulls come
    first. An empty table is fine.
    """
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__range": F.shiftright(at, 33).cast("int"), name: at.bitwiseAND(F.lit(STRIDE - 1)) + 1})
    found = kept(rows, "ranges")
    sizes = {r["__range"]: r["n"] for r in found.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0]
    for i in range(max(sizes, default=-1)):
        before.append(before[-1] + sizes.get(i, 0))
    return found.withColumn(name, F.col(name) + F.get(F.array(*map(F.lit, before)), F.col("__range"))).drop("__range")
