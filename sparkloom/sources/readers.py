"""Readers of the graph file formats that Spark has no reader for, and of the text ones with their columns named."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.functions.vectors import unpack_floats


def read_content(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Tab-separated nodes: id, `dim` features, label; gz files and members `.content` of tgz archives too. -> (node_id, features, target)."""
    if path.endswith((".tgz", ".tar.gz")):
        cells = F.split("line", "\t")
        values = F.transform(F.slice(cells, 2, dim), lambda x: x.cast("float"))
        return archive_lines(spark, path, ".content").select(cells[0].cast("long").alias("node_id"), values.alias("features"), cells[dim + 1].alias("target"))
    schema = ", ".join(["node_id BIGINT", *[f"f{i} FLOAT" for i in range(dim)], "target STRING"])
    rows = spark.read.csv(path, sep="\t", schema=schema)
    return rows.select("node_id", F.array(*[f"f{i}" for i in range(dim)]).alias("features"), "target")


def archive_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(line) of the members whose names end so in tgz archives. An archive, below 2 GB as Spark reads it, is one task; its lines stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(raw.as_py()), mode="r:gz") as archive:
                    for member in archive:
                        if not (member.isfile() and member.name.endswith(suffix)):
                            continue
                        stream = archive.extractfile(member)
                        while lines := stream.readlines(1 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array([x.decode().rstrip("\r\n") for x in lines])], names=["line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string").where("line <> ''")


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of `schema` from chunks kept as Arrow files or streams, one task or more for the files of a folder."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                chunk = raw.as_buffer()
                if chunk[:6].to_pybytes() == b"ARROW1":
                    file = pa.ipc.open_file(chunk)
                    parts = (file.get_batch(i) for i in range(file.num_record_batches))
                else:
                    parts = pa.ipc.open_stream(chunk)
                for part in parts:
                    yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in want], schema=want)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated edges "cited citing", or members `.cites` of tgz archives -> (src citing, dst cited)."""
    if path.endswith((".tgz", ".tar.gz")):
        cells = F.split("line", "\t")
        return archive_lines(spark, path, ".cites").select(cells[1].cast("long").alias("src"), cells[0].cast("long").alias("dst"))
    return spark.read.csv(path, sep="\t", schema="dst BIGINT, src BIGINT").select("src", "dst")


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A list of ids, one a line, gz or not -> (node_id, split)."""
    return spark.read.csv(path, schema="node_id BIGINT").select("node_id", F.lit(name).alias("split"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Measurement CSV with header Event, Time, Value; rows without a number for the time are dropped."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("Event").alias("event"), F.expr("try_cast(Time AS double)").alias("time"), F.expr("try_cast(Value AS double)").alias("value")).where(F.col("time").isNotNull())


def write_metrics(rows: DataFrame, path: str) -> None:
    """The same CSV, a folder of part files."""
    rows.select(F.col("event").alias("Event"), F.col("time").alias("Time"), F.col("value").alias("Value")).write.mode("append").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    """A summary, a configuration or counts of visits: one JSON object a row, a folder of part files."""
    rows.write.mode("overwrite").json(path)


def write_sorted(rows: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Parquet files dealt and sorted by ranges of `key`, so that a lookup by key reads only the row groups of its range."""
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def array_header(raw: io.BufferedIOBase) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, bytes of header) of a .npy stream, versions 1 and 2, by rows only."""
    version = np.lib.format.read_magic(raw)
    if version not in ((1, 0), (2, 0)):
        raise ValueError("not an array file of version 1 or 2")
    shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
    if by_columns:
        raise ValueError("arrays by columns aren't read")
    return shape, kind, raw.tell()


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ArraySource(DataSource):
    """Rows of an array inside an .npz archive, in chunks, never the whole array.

    Options: path (seen by all executors), name (member, without .npy), kind
    (`features`: (row, values), or `edges`: (src, dst) from a 2 x E or E x 2
    array, told apart by its shape), chunk (rows a partition).
    """

    @classmethod
    def name(cls) -> str:
        return "npz_rows"

    def schema(self) -> str:
        return "src bigint, dst bigint" if self.options.get("kind") == "edges" else "row bigint, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _ArrayReader(self.options)


class _ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.member = options["path"], options.get("name", "arr_0") + ".npy"
        self.kind, self.chunk = options.get("kind", "features"), int(options.get("chunk", 100_000))

    def _open(self):
        stream = zipfile.ZipFile(self.path).open(self.member)
        shape, kind, head = array_header(stream)
        return stream, shape, kind, head

    def partitions(self):
        shape = self._open()[1]
        n = edge_count(shape) if self.kind == "edges" else shape[0]
        return [_Rows(i, min(i + self.chunk, n)) for i in range(0, n, self.chunk)] or [_Rows(0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        n = part.last - part.first
        if self.kind == "edges":
            _, shape, _, _ = self._open()
            if shape[0] == 2:
                flat = [self._slice(part.first, n), self._slice(shape[1] + part.first, n)]
            else:
                both = self._slice(2 * part.first, 2 * n).reshape(-1, 2)
                flat = [both[:, 0], both[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in flat], names=["src", "dst"])
            return
        width = int(np.prod(self._open()[1][1:], dtype=np.int64))
        values = self._slice(part.first * width, n * width).astype(np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.last)), lists], names=["row", "values"])

    def _slice(self, first: int, n: int) -> np.ndarray:
        stream, _, kind, head = self._open()
        stream.seek(head + first * kind.itemsize)
        return np.frombuffer(stream.read(n * kind.itemsize), dtype=kind)


def edge_count(shape: tuple[int, ...]) -> int:
    """Edges of a 2 x E or E x 2 array; 2 x 2 counts as 2 x E."""
    if len(shape) != 2 or 2 not in shape:
        raise ValueError(f"not an edge array: {shape}")
    return shape[1] if shape[0] == 2 else shape[0]


def assign_splits(nodes: DataFrame, splits: list[DataFrame]) -> DataFrame:
    """nodes with a split from tables of (node_id, split), `unknown` elsewhere."""
    every = splits[0]
    for s in splits[1:]:
        every = every.unionByName(s)
    return nodes.join(every, "node_id", "left").withColumn("split", F.coalesce("split", F.lit("unknown")))


def missing_features(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes whose features a resumed load still has to write."""
    return nodes.join(done.select("node_id"), "node_id", "left_anti")


def materialise(nodes: DataFrame, done: DataFrame, column: str = "features") -> DataFrame:
    """(node_id, features): done(node_id, features) and, for the nodes it lacks, their packed bytes as doubles; null bytes give null."""
    fresh = missing_features(nodes, done).select("node_id", unpack_floats(column).cast("array<double>").alias("features"))
    return done.select("node_id", F.col("features").cast("array<double>").alias("features")).unionByName(fresh)
