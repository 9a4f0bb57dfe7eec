"""Neighbouring scan lines side by side, with one shuffle and without a window over a whole sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_BLOCK = 256


def with_line_neighbours(
    px: DataFrame, cols: list[str], seq: list[str], before: bool = True, after: bool = False, block: int = LINE_BLOCK,
) -> DataFrame:
    """Add ``prev`` / ``next``: structs of ``cols`` of the same sample one line earlier / later, NULL where missing.

    Lines are cut into blocks and the border lines copied to the neighbouring block (1/block extra rows), so a window
    group holds at most block + 2 rows however long the sequence is.
    """
    here = F.floor(F.col("line") / block)
    copies = [here]
    if before:
        copies.append(F.when(F.col("line") % block == block - 1, here + 1))
    if after:
        copies.append(F.when((F.col("line") % block == 0) & (here > 0), here - 1))
    spread = px.select("*", F.explode(F.array_compact(F.array(*copies))).alias("_block"))
    w = Window.partitionBy(*seq, "sample", "_block").orderBy("line")
    item = F.struct("line", *cols)
    out = spread
    for wanted, name, step, delta in ((before, "prev", F.lag, -1), (after, "next", F.lead, 1)):
        if wanted:
            out = out.withColumn(name, step(item).over(w))
            out = out.withColumn(name, F.when(F.col(f"{name}.line") == F.col("line") + delta, F.col(name)))
    return out.where(F.col("_block") == here).drop("_block")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Line table spread over all shuffle partitions before it grows by the sensor width.

    Scan partitions are sized by the bytes of the narrow line table, a thousand times less than what comes out of it; the
    explicit number also keeps adaptive execution from merging them again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sum_over(values: Column) -> Column:
    """Sum of a numeric array, as double."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
