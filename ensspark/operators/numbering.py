"""Dense row numbers that never pull a whole group into one task, however far apart the keys lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensspark.session import land

# Bits of an integer per level: a window sees at most 2^16 counts, whatever the integers are.
LEVEL_BITS = 16
LEVELS = 3
BEFORE = (Window.unboundedPreceding, -1)


def _starts(counts: DataFrame, keys: list[str], bits: int, levels: int) -> DataFrame:
    """Rows of earlier ranges of the same key, per range: ``(*keys, _range, _start)``.

    Ranges are summed up inside their parent, parents inside theirs; only the topmost window has no
    parent, and its ranges are the 2^16 values of an integer's highest bits.
    """
    if levels == 1:
        inside = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*BEFORE)
        return counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(inside), F.lit(0)).alias("_start"))
    placed = counts.withColumn("_parent", F.shiftright("_range", bits))
    parents = placed.groupBy(*keys, F.col("_parent").alias("_range")).agg(F.sum("_rows").alias("_rows"))
    above = _starts(parents, keys, bits, levels - 1).withColumnsRenamed({"_range": "_parent", "_start": "_above"})
    inside = Window.partitionBy(*keys, "_parent").orderBy("_range").rowsBetween(*BEFORE)
    earlier = F.coalesce(F.sum("_rows").over(inside), F.lit(0))
    return placed.withColumn("_earlier", earlier).join(above, [*keys, "_parent"]).select(
        *keys, "_range", (F.col("_earlier") + F.col("_above")).alias("_start")
    )


def number_rows(
    df: DataFrame, name: str, keys: list[str], place: str, bits: int = LEVEL_BITS, levels: int = LEVELS
) -> DataFrame:
    """Number rows 1..n inside each key, in the order of an integer; rows without a key or place are left out.

    Rows are ranked inside ranges of ``2^bits`` integers and shifted by the rows of earlier ranges. A key
    that owns a third of all rows is spread over its ranges, also if its integers are sparse: the ranges'
    counts are summed up level by level. Equal integers of a key meet in one task.
    """
    cut = df.filter(F.col(place).isNotNull()).withColumn("_range", F.shiftright(F.col(place).cast("long"), bits))
    counts = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    inside = Window.partitionBy(*keys, "_range").orderBy(place)
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(_starts(counts, keys, bits, levels), [*keys, "_range"])
        .withColumn(name, (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_range", "_rank", "_start")
    )


def number_all(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Number all rows 1..n in the given order, nulls first.

    The rows are dealt by sampled ranges of ``order`` and sorted, so neither sparse nor crowded values
    make a task large unless rows are equal in all of ``order``. They are landed with their place in their
    partition; what is summed up and broadcast is one count per partition.
    """
    at = F.monotonically_increasing_id()  # partition << 33 | place in the partition
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    rows = land(dealt, f"numbered-{name.strip('_')}")
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))
    starts = sizes.select("_part", earlier.alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + place + 1)
        .drop("_part", "_at", "_start")
    )


def last_id_of(existing: DataFrame, last_id: int | None = None) -> Column:
    """The highest id given so far: the one the caller keeps, or else the highest that is stored."""
    if last_id is not None:
        return F.lit(last_id)
    return existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()


def next_ids(df: DataFrame, existing: DataFrame, order: str, last_id: int | None = None) -> DataFrame:
    """Give new rows ids that continue those of ``existing``, in the order of a unique column.

    ``last_id`` overrides the highest stored id, for stores that never reuse a deleted one.
    """
    start = last_id_of(existing, last_id)
    return number_all(df, "_n", [order]).withColumn("id", F.col("_n") + start).drop("_n")
