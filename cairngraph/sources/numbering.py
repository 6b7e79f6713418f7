"""Numbers in an order, without any task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that groups are dealt into, and groups drawn to find their bounds: what the driver holds.
RANGES, DRAWN = 256, 4096


def bounds_of(groups: DataFrame, group: str, ranges: int) -> list[str]:
    """Names that part the groups into ranges of about one size. They come from the DRAWN groups of the least hash, so they are the
    same whenever they are asked for, lost tasks included."""
    few = groups.select(group, F.xxhash64(group).alias("h")).distinct().orderBy("h", group).limit(DRAWN).collect()
    each = max(1, min(DRAWN, len(few)) // ranges)
    return sorted(r[group] for r in few)[each::each]


def range_in(bounds: list[str], name: str) -> Column:
    """The number of the range that a name lies in."""
    known = F.array(*(F.lit(x) for x in bounds)).cast("array<string>")
    return F.size(F.filter(known, lambda x: x <= F.col(name)))


def _range_of(groups: DataFrame, group: str) -> Column:
    return range_in(bounds_of(groups, group, RANGES), group)


def firsts(sizes: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """(group, first) of sizes(group, n), a row a group: how many rows stand before each, by the groups' names."""
    sizes = sizes.select(group, "n").withColumn("range", _range_of(groups, group))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("begin", F.coalesce(F.sum("n").over(within), F.lit(0))).join(ranges, "range").select(group, (F.col("base") + F.col("begin")).alias("first"))


def numbered_by(rows: DataFrame, group: str, *order: str, groups: DataFrame | None = None) -> DataFrame:
    """rows with `ordinal` (long, from 0): by group (a text), then by order; groups: where the groups' names are told more cheaply.

    Numbers within a group come from its rows; where a group begins is told by the groups' sizes (a row a group), which are
    dealt by ranges of names and summed in two steps: before a range, over a row a range, and within it. So no task holds
    all rows or all groups."""
    first = firsts(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group, rows if groups is None else groups)
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    return own.join(first, group).withColumn("ordinal", (F.col("first") + F.col("k")).cast("long")).select(*rows.columns, "ordinal")
