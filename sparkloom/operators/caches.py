"""Caches of vectors by node id, kept as tables, and their tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.operators.features import lru, tiered

SCHEMA = "node_id long, h array<double>"


class TableCache:
    """(node_id, h), one row an id. Every change is written, so a lost executor loses no entry."""

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None):
        self.spark = spark
        self.rows = spark.createDataFrame([], SCHEMA)
        if rows is not None:
            self.set_many(rows)

    def get(self, node_id: int) -> list[float] | None:
        found = self.rows.where(F.col("node_id") == node_id).select("h").first()
        return None if found is None else found["h"]

    def set(self, node_id: int, h: list[float]) -> None:
        self.set_many(self.spark.createDataFrame([(node_id, h)], SCHEMA))

    def delete(self, node_id: int) -> None:
        self.rows = cut(self.rows.where(F.col("node_id") != node_id))

    def clear(self) -> None:
        self.rows = self.spark.createDataFrame([], SCHEMA)

    def get_many(self, ids: DataFrame) -> DataFrame:
        """(node_id, h) of each distinct id asked for; null where the cache has none."""
        return ids.select("node_id").distinct().join(self.rows, "node_id", "left")

    def set_many(self, rows: DataFrame) -> None:
        """Rows with a null id are left out; of repeated ids the greatest vector stays."""
        fresh = rows.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.max("h").alias("h"))
        self.rows = cut(self.rows.join(fresh, "node_id", "left_anti").unionByName(fresh))


class FixedCache(TableCache):
    """Written once: frozen by freeze(), or from the start when built with rows."""

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None):
        self.frozen = False
        super().__init__(spark, rows)
        self.frozen = rows is not None and not self.rows.isEmpty()

    def freeze(self) -> None:
        self.frozen = True

    def _open(self) -> None:
        if self.frozen:
            raise ValueError("the cache is frozen")

    def set_many(self, rows: DataFrame) -> None:
        self._open()
        super().set_many(rows)

    def delete(self, node_id: int) -> None:
        self._open()
        super().delete(node_id)

    def clear(self) -> None:
        self._open()
        super().clear()


class NoCache(TableCache):
    """Holds nothing: every request misses."""

    def set_many(self, rows: DataFrame) -> None:
        pass


class TieredCache:
    """Tiers from nearest to farthest. get() copies what a farther tier holds into the nearer ones that aren't frozen; get_many() copies nothing."""

    def __init__(self, *tiers: TableCache):
        self.tiers = tiers

    def get(self, node_id: int) -> list[float] | None:
        for i, tier in enumerate(self.tiers):
            h = tier.get(node_id)
            if h is not None:
                for nearer in self.tiers[:i]:
                    if not getattr(nearer, "frozen", False):
                        nearer.set(node_id, h)
                return h
        return None

    def get_many(self, ids: DataFrame) -> DataFrame:
        """(node_id, h, tier): from the first tier that holds the id; nulls if none does."""
        out = ids.select("node_id").distinct()
        for i, tier in enumerate(self.tiers):
            out = out.join(tier.rows.select("node_id", F.col("h").alias(f"__h{i}"), F.lit(i).alias(f"__t{i}")), "node_id", "left")
        every = range(len(self.tiers))
        return out.select("node_id", F.coalesce(*[f"__h{i}" for i in every]).alias("h"), F.coalesce(*[f"__t{i}" for i in every]).alias("tier"))


def two_level(requests: DataFrame, hot: DataFrame, capacity: int, cache: str = "cache_id", order: str = "pos") -> DataFrame:
    """(cache_id, pos, node_id, tier): 0 from the fixed hot set, 1 from the LRU cache behind it, null for a miss.

    Only requests that the hot set doesn't answer reach the LRU cache.
    """
    flagged = tiered(requests.select(F.struct(cache, order).alias("pos"), "node_id"), hot).select(F.col(f"pos.{cache}").alias(cache), F.col(f"pos.{order}").alias(order), "node_id", "tier")
    behind = lru(flagged.where(F.col("tier").isNull()), capacity, cache, order)
    rest = behind.select(cache, order, "node_id", F.when(F.col("hit"), F.lit(1)).alias("tier"))
    return flagged.where(F.col("tier").isNotNull()).unionByName(rest)
