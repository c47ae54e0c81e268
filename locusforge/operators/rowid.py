"""Row numbers and positions in order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

VALUE_BLOCK = 65_536


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id", first: int = 0, copies: str | None = None) -> DataFrame:
    """Consecutive numbers in the order given, by ranges; with `copies` also a column of that name, 1 for the first of equal rows.

    Rows are dealt by range and sorted within; that order is written once, since ranges come from a sample and may differ
    when computed again. A second pass adds the rows of the ranges before, of which there is one number a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if copies:  # equal rows lie in one range, so that this moves none
        ranged = ranged.withColumn(copies, F.row_number().over(Window.partitionBy(*order).orderBy(*order)))
    return numbered(scratch.materialize(placed(ranged), "ordered"), name, first)


def placed(ranged: DataFrame) -> DataFrame:
    """Adds to rows that are dealt by range and sorted within what `numbered` needs, once they are written: the range and the place in it."""
    return ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def numbered(stored: DataFrame, name: str = "row_id", first: int = 0) -> DataFrame:
    """Numbers of rows that were written with their places."""
    sizes = sorted((r["_range"], r["n"]) for r in stored.groupBy("_range").agg(F.count("*").alias("n")).collect())  # one row a range
    before, starts = first, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    if not starts:
        return stored.withColumn(name, F.lit(None).cast("long")).drop("_range", "_at")
    place = F.create_map(*(F.lit(x) for s in starts for x in s)) if len(starts) <= 64 else None
    if place is not None:
        out = stored.withColumn(name, F.element_at(place, F.col("_range")).cast("long") + F.col("_at"))
    else:
        base = stored.sparkSession.createDataFrame(starts, "_range int, _base long")
        out = stored.join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_at")).drop("_base")
    return out.drop("_range", "_at")


def with_blocks(df: DataFrame, row_id: str = "row_id", size: int = VALUE_BLOCK) -> DataFrame:
    return df.withColumn("block_id", F.floor(F.col(row_id) / size).cast("int"))


def position_gaps(df: DataFrame, position: str = "global_position", row_id: str = "row_id", block: int = 131_072, within: tuple[str, ...] = ()) -> DataFrame:
    """The step from the row before in a block of rows, and in the columns of `within`; 0 at its start. Positions that fall raise."""
    w = Window.partitionBy(*within, F.floor(F.col(row_id) / block)).orderBy(row_id)
    step = F.col(position) - F.lag(position).over(w)
    return df.withColumn("gap", F.when(step < 0, F.raise_error(F.lit("positions have to ascend"))).otherwise(F.coalesce(step, F.lit(0))).cast("long"))


def positions_from_gaps(df: DataFrame, first: str = "first_position", row_id: str = "row_id", block: int = 131_072, within: tuple[str, ...] = ()) -> DataFrame:
    """Positions again, from the gaps and the first position of each block."""
    w = Window.partitionBy(*within, F.floor(F.col(row_id) / block)).orderBy(row_id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("restored_position", F.col(first) + F.sum("gap").over(w))


def falling_positions(df: DataFrame, position: str = "global_position", row_id: str = "row_id", block: int = 131_072) -> DataFrame:
    """Rows whose position is less than that of the row before, blocks' edges included.

    A window a block finds those within; the first row of a block is held against the last of the one before, one row a block.
    """
    number = F.floor(F.col(row_id) / block).alias("_block")
    rows = df.select(F.col(row_id).alias("row_id"), F.col(position).alias("at"), number)
    before = F.lag("at").over(Window.partitionBy("_block").orderBy("row_id"))
    inside = rows.withColumn("_before", before).where(F.col("at") < F.col("_before")).select("row_id", "at")
    ends = rows.groupBy("_block").agg(F.min("row_id").alias("row_id"), F.min_by("at", "row_id").alias("first"), F.max_by("at", "row_id").alias("last"))
    edge = ends.select("_block", "row_id", "first").join(ends.select((F.col("_block") + 1).alias("_block"), "last"), "_block").where(F.col("first") < F.col("last"))
    return inside.union(edge.select("row_id", "first"))
