"""Running sums and dense numbers over a whole table, without a single task that sees all rows.

The table is dealt into ranges of the order, each range's own sums are taken, and what all ranges before it sum to, a row a range, is added: two levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.plans.materialize import written


def running(df: DataFrame, order: list[str], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """df with, for each column of sums, the sum of all rows up to and with each, as the column it names. Rows that are equal in order take any order among themselves."""
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    dealt = written(dealt.withColumn("range", F.spark_partition_id()), "prefix-ranges")
    return _summed(dealt, order, sums)


def _summed(dealt: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    totals = dealt.groupBy("range").agg(*(F.sum(c).alias(f"of_{n}") for c, n in sums.items()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = totals.select("range", *(F.coalesce(F.sum(f"of_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in sums.values()))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.join(F.broadcast(totals), "range")  # as many rows as there are ranges
    found = found.withColumns({n: (F.sum(c).over(within) + F.col(f"before_{n}")).cast("long") for c, n in sums.items()})
    return found.drop("range", *(f"before_{n}" for n in sums.values()))


def numbered(df: DataFrame, order: list[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """df with the number of each row in the order, from 1, without a gap. Where order leaves rows equal, all columns that can be ordered decide, so that reruns agree."""
    rest = [c for c, t in df.dtypes if c not in order and not t.startswith("map")]
    return running(df.withColumn("one", F.lit(1)), [*order, *rest], {"one": name}, partitions).drop("one")
