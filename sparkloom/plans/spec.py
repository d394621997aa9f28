"""Model specifications: a checked list of layer operations, and their tensors."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from typing import Any

OPS = ("aggregate", "linear", "relu", "tanh", "elu", "softmax")
METHODS = ("gcn_norm", "mean", "sum", "max", "min", "gin", "attention")


@dataclass(frozen=True)
class Layer:
    """An operation. The weight of an attention is a tensor of two rows, for the target's and the neighbour's vector; eps is GIN's."""

    op: str
    method: str | None = None
    weight: str | None = None
    bias: str | None = None
    eps: float = 0.0


@dataclass
class ModelSpec:
    """num_hops aggregations, one fan-out each."""

    num_hops: int
    fanouts: list[int]
    layers: list[Layer]
    tensors: dict[str, Any] = field(default_factory=dict)

    def check(self) -> ModelSpec:
        steps = [x for x in self.layers if x.op == "aggregate"]
        if len(steps) != self.num_hops or len(self.fanouts) != self.num_hops:
            raise ValueError(f"{len(steps)} aggregations and {len(self.fanouts)} fan-outs for {self.num_hops} hops")
        for x in self.layers:
            if x.op not in OPS:
                raise ValueError(f"no such operation: {x.op}")
            if x.op == "aggregate" and x.method not in METHODS:
                raise ValueError(f"no such aggregation: {x.method}")
            for name in (x.weight, x.bias):
                if name is not None and name not in self.tensors:
                    raise ValueError(f"no such tensor: {name}")
            if x.method == "attention" and (x.weight is None or len(self.tensors[x.weight]) != 2):
                raise ValueError("an attention needs a tensor of two rows")
        return self

    def width(self) -> int | None:
        """Length of the input vectors, from the first linear layer; None without one."""
        first = next((x for x in self.layers if x.op == "linear"), None)
        return len(self.tensors[first.weight][0]) if first else None

    @classmethod
    def parse(cls, text: str, tensors: dict[str, Any]) -> ModelSpec:
        """From JSON. Fan-outs: a list, a number for every hop, or 10 a hop if absent."""
        raw = json.loads(text)
        hops, given = int(raw["num_hops"]), raw.get("max_neighbors")
        fanouts = [int(x) for x in given] if isinstance(given, list) else [int(given if given is not None else 10)] * hops
        layers = [Layer(x["op"], x.get("method"), x.get("weight"), x.get("bias"), float(x.get("eps", 0.0))) for x in raw["layers"]]
        return cls(hops, fanouts, layers, tensors).check()


def compile_layers(layers: list[tuple]) -> list[Layer]:
    """Layer definitions to operations: ("conv", name, relu?) is aggregate, linear and maybe relu; ("gat", name) is linear and attention, ("gin", name, eps) is aggregate, linear, relu and linear; ("linear", name), ("relu",), ("tanh",), ("elu",), ("softmax",), ("gelu",) as relu; a list is spliced in."""
    out: list[Layer] = []
    for x in layers:
        if isinstance(x, list):
            out += compile_layers(x)
        elif x[0] == "conv":
            out += [Layer("aggregate", "gcn_norm"), Layer("linear", weight=f"{x[1]}.weight", bias=f"{x[1]}.bias")]
            out += [Layer("relu")] if len(x) > 2 and x[2] else []
        elif x[0] == "linear":
            out.append(Layer("linear", weight=f"{x[1]}.weight", bias=f"{x[1]}.bias"))
        elif x[0] in ("relu", "gelu"):
            out.append(Layer("relu"))
        elif x[0] == "gat":
            out += [Layer("linear", weight=f"{x[1]}.weight", bias=f"{x[1]}.bias"), Layer("aggregate", "attention", weight=f"{x[1]}.attention")]
        elif x[0] == "gin":
            out += [Layer("aggregate", "gin", eps=float(x[2]) if len(x) > 2 else 0.0), *compile_layers([("linear", f"{x[1]}.0"), ("relu",), ("linear", f"{x[1]}.1")])]
        elif x[0] in ("tanh", "elu", "softmax"):
            out.append(Layer(x[0]))
        else:
            raise ValueError(f"no rule for layer {x[0]}")
    return out


def write_tensors(tensors: dict[str, Any]) -> bytes:
    """Little-endian: count, then for each tensor key length, key, rank, sizes and float32 values by rows, all integers of 32 bits."""
    out = [struct.pack("<i", len(tensors))]
    for key, value in tensors.items():
        name = key.encode()
        rows = value if value and isinstance(value[0], list) else None
        sizes = [len(value), len(value[0])] if rows is not None else [len(value)]
        flat = [x for r in value for x in r] if rows is not None else list(value)
        out.append(struct.pack(f"<i{len(name)}si{len(sizes)}i{len(flat)}f", len(name), name, len(sizes), *sizes, *flat))
    return b"".join(out)


def read_tensors(raw: bytes) -> dict[str, Any]:
    (count,), at, out = struct.unpack_from("<i", raw), 4, {}
    for _ in range(count):
        (n,) = struct.unpack_from("<i", raw, at)
        key = raw[at + 4 : at + 4 + n].decode()
        at += 4 + n
        (rank,) = struct.unpack_from("<i", raw, at)
        sizes = struct.unpack_from(f"<{rank}i", raw, at + 4)
        at += 4 + 4 * rank
        total = 1
        for s in sizes:
            total *= s
        flat = list(struct.unpack_from(f"<{total}f", raw, at))
        at += 4 * total
        out[key] = flat if rank == 1 else [flat[i * sizes[1] : (i + 1) * sizes[1]] for i in range(sizes[0])]
    return out
