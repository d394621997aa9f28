"""Scans over ordered groups: positions, running sums and the nearest value ahead, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut


#: Inputs of up to so many rows are scanned by plain windows: any group of theirs fits a task.
SMALL = 200_000


class OrderedGroups:
    """Rows of groups `by` in ascending `order` (nulls first; rows equal in it follow each other in any order).

    Rows are dealt by ranges of (by, order) and checkpointed, so that a part is a
    stretch of the whole order and a large group lies in several parts. Every scan
    runs within the parts; what a part passes on is one row for each group that
    more than one part holds. Those groups begin or end a part, so there are fewer
    of them than parts, and the passed rows, two for a part at most, are broadcast.
    Without a given number of parts, SMALL rows or less are one part, which nothing
    is passed to; the results are the same.
    """

    def __init__(self, rows: DataFrame, by: list[str], order: list[str], parts: int | None = None):
        group = F.struct(*by) if by else F.struct(F.lit(0))
        self.order, self.columns, self.shared = order, rows.columns, None
        if parts is None and rows.limit(SMALL + 1).count() <= SMALL:
            self.rows = rows.withColumn("__part", F.lit(0)).withColumn("__g", group)
            return
        parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(parts, *by, *order)
        self.rows = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__g", group))
        ends = self.rows.groupBy("__part").agg(F.min("__g").alias("a"), F.max("__g").alias("b"))
        self.shared = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("__g")).groupBy("__g").agg(F.count("*").alias("n")).where("n > 1").select("__g")

    def _by_part(self, **totals: Column) -> DataFrame:
        """A row for each part of a shared group."""
        rows = self.rows.join(F.broadcast(self.shared), "__g", "left_semi")
        return rows.groupBy("__g", "__part").agg(*[c.alias(n) for n, c in totals.items()])

    def _carry(self, out: DataFrame, passed: DataFrame) -> DataFrame:
        return out.join(F.broadcast(passed), ["__g", "__part"], "left")

    def running(self, **values: Column) -> DataFrame:
        """The rows with, for each name, the sum of the value over the group's rows up to this one."""
        upto = Window.partitionBy("__part", "__g").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        summed = self.rows.select("*", *[F.sum(c).over(upto).alias(n) for n, c in values.items()])
        if self.shared is None:
            return summed.select(*self.columns, *values)
        before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        passed = self._by_part(**{f"__{n}": F.sum(c) for n, c in values.items()})
        passed = passed.select("__g", "__part", *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in values])
        out = self._carry(summed, passed)
        # a sum without a value yet is null, as of any other rows
        total = lambda n: F.when(F.col(n).isNull(), F.col(f"__{n}")).otherwise(F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0)))
        return out.select(*self.columns, *[total(n).alias(n) for n in values])

    def positions(self, name: str = "position") -> DataFrame:
        """The rows with their place in the group, from 0."""
        return self.running(**{name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))

    def following(self, **values: Column) -> DataFrame:
        """The rows with, for each name, the first value that is not null at this row or after it."""
        back = [F.col(c).desc() for c in self.order]
        onward = Window.partitionBy("__part", "__g").orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
        met = self.rows.select("*", *[F.last(c, ignorenulls=True).over(onward).alias(n) for n, c in values.items()])
        if self.shared is None:
            return met.select(*self.columns, *values)
        later = Window.partitionBy("__g").orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
        first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.struct(*self.order)))
        passed = self._by_part(**{f"__{n}": first(c) for n, c in values.items()})
        passed = passed.select("__g", "__part", *[F.last(f"__{n}", ignorenulls=True).over(later).alias(f"__{n}") for n in values])
        out = self._carry(met, passed)
        return out.select(*self.columns, *[F.coalesce(n, f"__{n}").alias(n) for n in values])
