"""The graph operators as SQL: table functions over the views of a graph, and a sampler that takes any table.

`register` gives a session, for a graph named g,

    g_nodes, g_edges                     views
    g_fetch()                            node_id, features, target: absent vectors are zeros, absent labels -1
    g_degree()                           node_id, degree
    g_mean()                             node_id, h: mean over in-neighbours, a node's own vector without any
    g_gcn_norm()                         node_id, h: symmetrically normalised sum
    sample_neighbours(TABLE(...), k, seed, hop [, slices])
                                         dst, src: k neighbours of each centre of a table (dst, src)
    check_batches(TABLE(...), size)      batch, rows, complete: what each batch of a table (batch, ...) holds

The functions of a graph are SQL, which Catalyst inlines: a condition on node_id, also
IN (SELECT ...), reaches the scans. The sampler is told by its `analyze` step how its
table is to be dealt: by centre, and for hubs by `slices` of a centre's neighbours,
of which the k drawn from each are drawn from again. It holds k rows at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from sparkloom.graph import PropertyGraph


def _table(rows: AnalyzeArgument, *columns: str) -> None:
    if not rows.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    missing = [c for c in columns if c not in rows.dataType.fieldNames()]
    if missing:
        raise ValueError(f"the table has no column {missing}")


def _positive(value: AnalyzeArgument, name: str) -> int:
    if not value.isConstantExpression or not isinstance(value.value, int) or value.value < 1:
        raise ValueError(f"{name} is a constant of at least 1")
    return value.value


class SampleNeighbours:
    """k neighbours of each centre, by least tape, so that the draw is the same however rows are dealt."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument, seed: AnalyzeArgument, hop: AnalyzeArgument, slices: AnalyzeArgument | None = None) -> AnalyzeResult:
        _table(rows, "dst", "src")
        _positive(k, "k")
        parts = 1 if slices is None else _positive(slices, "slices")
        dealt = [PartitioningColumn("dst")] + ([PartitioningColumn(f"pmod(xxhash64(src), {parts})")] if parts > 1 else [])
        return AnalyzeResult(StructType().add("dst", LongType()).add("src", LongType()), partitionBy=dealt, select=[SelectedColumn("dst"), SelectedColumn("src")])

    def __init__(self) -> None:
        self.held: list[tuple[int, int, int]] = []

    def eval(self, rows, k: int, seed: int, hop: int, slices: int = 1) -> None:
        dst, src = rows["dst"], rows["src"]
        tape = hashlib.md5(f"{seed}:{hop}:{'null' if dst is None else dst}:{'null' if src is None else src}".encode()).hexdigest()
        entry = (-int(tape, 16), dst, src)
        if len(self.held) < k:
            heapq.heappush(self.held, entry)
        elif entry[0] > self.held[0][0]:
            heapq.heapreplace(self.held, entry)

    def terminate(self) -> Iterator[tuple[int, int]]:
        for _, dst, src in self.held:
            yield dst, src


class CheckBatches:
    """(batch, rows, complete): whether each batch holds `size` rows."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        _table(rows, "batch")
        _positive(size, "size")
        return AnalyzeResult(StructType().add("batch", LongType()).add("rows", LongType()).add("complete", BooleanType()), partitionBy=[PartitioningColumn("batch")], select=[SelectedColumn("batch")])

    def __init__(self) -> None:
        self.batch, self.rows, self.size = None, 0, 0

    def eval(self, rows, size: int) -> None:
        self.batch, self.rows, self.size = rows["batch"], self.rows + 1, size

    def terminate(self) -> Iterator[tuple[int, int, bool]]:
        yield self.batch, self.rows, self.rows == self.size


def _each(how: str, width: int) -> str:
    return "array(" + ", ".join(how.format(i=i) for i in range(width)) + ")"


def register(spark: SparkSession, graph: PropertyGraph, name: str, width: int, features: str = "features", target: str = "target") -> None:
    """The views and functions of the graph, whose feature vectors have `width` numbers."""
    if not name.isidentifier():
        raise ValueError(f"{name} is no name")
    graph.nodes.createOrReplaceTempView(f"{name}_nodes")
    graph.edges.createOrReplaceTempView(f"{name}_edges")
    own = f"SELECT node_id, CAST({features} AS ARRAY<DOUBLE>) AS h FROM {name}_nodes WHERE {features} IS NOT NULL"
    sent = f"SELECT e.dst, x.h FROM {name}_edges e JOIN ({own}) x ON x.node_id = e.src"
    bodies = {
        "fetch": ("node_id BIGINT, features ARRAY<DOUBLE>, target BIGINT", f"SELECT node_id, coalesce(CAST({features} AS ARRAY<DOUBLE>), array_repeat(0.0D, {width})), coalesce(CAST({target} AS BIGINT), -1) FROM {name}_nodes"),
        "degree": ("node_id BIGINT, degree BIGINT", f"SELECT n.node_id, count(e.src) FROM {name}_nodes n LEFT JOIN {name}_edges e ON e.dst = n.node_id GROUP BY n.node_id"),
        "mean": (
            "node_id BIGINT, h ARRAY<DOUBLE>",
            f"SELECT n.node_id, coalesce(m.h, x.h) FROM {name}_nodes n LEFT JOIN ({own}) x ON x.node_id = n.node_id LEFT JOIN (SELECT dst, {_each('avg(h[{i}])', width)} AS h FROM ({sent}) GROUP BY dst) m ON m.dst = n.node_id",
        ),
        "gcn_norm": (
            "node_id BIGINT, h ARRAY<DOUBLE>",
            f"""WITH d AS (SELECT n.node_id, 1 / sqrt(count(e.src) + 1.0D) AS r FROM {name}_nodes n LEFT JOIN {name}_edges e ON e.dst = n.node_id GROUP BY n.node_id),
            scaled AS (SELECT x.node_id, transform(x.h, v -> v * d.r) AS h, d.r FROM ({own}) x JOIN d ON d.node_id = x.node_id),
            sums AS (SELECT e.dst, {_each('sum(s.h[{i}])', width)} AS h FROM {name}_edges e JOIN scaled s ON s.node_id = e.src GROUP BY e.dst)
            SELECT s.node_id, zip_with(s.h, coalesce(m.h, array()), (a, b) -> s.r * (a + coalesce(b, 0.0D))) FROM scaled s LEFT JOIN sums m ON m.dst = s.node_id""",
        ),
    }
    for function, (columns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{function}() RETURNS TABLE({columns}) RETURN {body}")
    spark.udtf.register("sample_neighbours", udtf(SampleNeighbours))
    spark.udtf.register("check_batches", udtf(CheckBatches))
