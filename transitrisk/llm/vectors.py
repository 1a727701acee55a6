"""Shared helpers of the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.llm.common import stored

#: Parts into which a class of equal rows is dealt before its smallest ids meet.
SALTS = 16


def finite(vector: Column) -> Column:
    """Whether a vector has only finite components; false for a null vector."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def smallest_members(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of every class of equal rows, by ``order`` (nulls last).
    Salted parts are cut first, so a class with a third of all rows weighs little."""
    by = [F.col(c).asc_nulls_last() for c in order]
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    first = rows.withColumn("__salt", salt).withColumn("__place", place(*key, "__salt")).where(F.col("__place") <= most)
    return (first.drop("__salt", "__place").withColumn("__place", place(*key)).where(F.col("__place") <= most).drop("__place"))


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    n = len(column)
    values = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n and len(values) else np.zeros((n, 0), values.dtype)


def dense_numbers(rows: DataFrame, name: str) -> DataFrame:
    """Numbers rows from 0 without gaps: the place within a written partition plus the
    sizes of the partitions before it (one row a partition)."""
    placed = stored(rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__first"))
    return (placed.withColumn("__part", part).join(starts, "__part")
            .withColumn(name, F.col("__first") + place).drop("__part", "__first", "__at"))
