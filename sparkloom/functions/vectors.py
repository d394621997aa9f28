"""Vectors: packed codecs, wide and long layouts, list helpers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bytes(packed: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets from 0, and the bytes of all values."""
    wide = pa.types.is_large_binary(packed.type)
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) if len(packed) else np.zeros(1, np.int64)
    return at - at[0], (data.to_pybytes() if data is not None else b"")[at[0] : at[-1]]


def _binary(sizes: np.ndarray, data: bytes, valid: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return pc.if_else(valid, out, pa.scalar(None, pa.binary()))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack_floats(packed: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to an array; null stays null. A batch is one buffer."""
    at, data = _bytes(packed)
    return pa.ListArray.from_arrays(pa.array((at // 4).astype(np.int32)), pa.array(np.frombuffer(data, "<f4")), mask=packed.is_null())


@F.arrow_udf(T.BinaryType())
def pack_floats(values: pa.Array) -> pa.Array:
    """An array to little-endian float32 bytes; null stays null."""
    sizes = pc.list_value_length(values).fill_null(0).to_numpy() * 4
    return _binary(sizes, values.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes(), values.is_valid())


@F.arrow_udf(T.BinaryType())
def pack_label(label: pa.Array) -> pa.Array:
    """A label to 8 little-endian bytes."""
    return _binary(np.full(len(label), 8), label.fill_null(0).to_numpy().astype("<i8").tobytes(), label.is_valid())


@F.arrow_udf(T.LongType())
def unpack_label(packed: pa.Array) -> pa.Array:
    valid = packed.is_valid().to_numpy(zero_copy_only=False)
    at, data = _bytes(packed)
    out = np.zeros(len(packed), np.int64)
    out[valid] = np.frombuffer(data, "<i8")[at[:-1][valid] // 8]
    return pa.array(out, mask=~valid)


def total(vector: Column) -> Column:
    """Sum of a vector."""
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def wide(vector: Column, dim: int, prefix: str = "f") -> list[Column]:
    """One double column for each dimension: sums and means then run in generated code, without an explode."""
    return [vector[i].cast("double").alias(f"{prefix}{i}") for i in range(dim)]


def long_form(df: DataFrame, vector: str, value: str = "h", digits: int | None = 6) -> DataFrame:
    """(other columns, dim, value), rounded for comparison across engines."""
    out = df.select(*[c for c in df.columns if c != vector], F.posexplode(vector).alias("dim", value)).withColumn("dim", F.col("dim").cast("long"))
    if digits is None:
        return out
    rounded = F.round(value, digits)
    return out.withColumn(value, F.when(rounded == 0, F.lit(0.0)).otherwise(rounded))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def linear(vector: Column, weight: list[list[float]], bias: list[float] | None = None) -> Column:
    """W h + b with W row-major [out][in], both literals.

    The rows are walked by higher-order functions: written out as one sum a row,
    larger matrices exceed what the JVM compiles, and stacked layers would copy
    each other's expressions. Whole models run their layers in numpy instead.
    """
    rows = F.array(*[F.struct(F.array(*[F.lit(float(w)) for w in row]).alias("w"), F.lit(float(bias[i]) if bias is not None else 0.0).alias("b")) for i, row in enumerate(weight)])
    return let(vector, lambda h: F.transform(rows, lambda r: F.aggregate(F.zip_with(r["w"], h, lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x) + r["b"]))


def relu(x: Column) -> Column:
    """Negative to 0; NaN passes."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(slope) * x)


def each(vector: Column, f) -> Column:
    return F.transform(vector, f)


def argmax(vector: Column) -> Column:
    """Index of the first largest value; null values are passed over; null for no value."""
    best = F.array_max(vector)
    return F.when(best.isNotNull(), F.array_position(vector, best) - 1)


def map_merge(a: Column, b: Column) -> Column:
    """Both maps in one; a key in both has the second one's value."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
