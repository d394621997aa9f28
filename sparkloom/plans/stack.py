"""Models as stacks of layers, checked for where they are to run, and layers whose first aggregation is done beforehand."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from sparkloom.plans.spec import Layer, ModelSpec


@dataclass(frozen=True)
class Kind:
    """A layer kind: the aggregation it stands for, whether the whole model can run as a plan with it, and, where its messages don't depend on the target, what is left of the layer once its aggregation is there."""

    method: str
    inferable: bool = True
    adapter: Callable[[list[Layer]], list[Layer]] | None = None


def _without_aggregation(layers: list[Layer]) -> list[Layer]:
    """W (A X) + b from A X: the aggregation goes, the linear layer stays."""
    return [x for x in layers if x.op != "aggregate"]


#: Kinds by name. Attention weighs each neighbour by the target, so that it can't be aggregated beforehand.
KINDS: dict[str, Kind] = {
    "gcn": Kind("gcn_norm", adapter=_without_aggregation),
    "mean": Kind("mean", adapter=_without_aggregation),
    "sum": Kind("sum", inferable=False, adapter=_without_aggregation),
    "attention": Kind("attention", inferable=False),
}


def register_kind(name: str, kind: Kind) -> None:
    if name in KINDS:
        raise ValueError(f"{name} is a kind already")
    KINDS[name] = kind


@dataclass(frozen=True)
class StackLayer:
    """A message-passing layer with `width` outputs and an activation (relu, tanh or none)."""

    kind: str
    width: int
    activation: str | None = "relu"


@dataclass(frozen=True)
class Stack:
    """Layers and a linear classifier.

    use: `aggregate` if the first layer's aggregation is computed beforehand, `infer`
    if the whole model runs as a plan, `both` if either. Checked when it is made.
    """

    layers: tuple[StackLayer, ...]
    classes: int
    use: str = "infer"
    fanouts: int | tuple[int, ...] = 10

    def __post_init__(self) -> None:
        if not self.layers:
            raise ValueError("a stack has a layer at least")
        if self.use not in ("aggregate", "infer", "both"):
            raise ValueError(f"no such use: {self.use}")
        if self.classes < 1 or any(x.width < 1 for x in self.layers):
            raise ValueError("widths are positive")
        if not isinstance(self.fanouts, int) and len(self.fanouts) != len(self.layers):
            raise ValueError(f"{len(self.fanouts)} fan-outs for {len(self.layers)} layers")
        for i, x in enumerate(self.layers):
            if x.kind not in KINDS:
                raise ValueError(f"layer {i}: no such kind: {x.kind}")
            if x.activation not in (None, "relu", "tanh"):
                raise ValueError(f"layer {i}: no such activation: {x.activation}")
            kind, first = KINDS[x.kind], i == 0
            if self.use in ("infer", "both") and not kind.inferable:
                raise ValueError(f"layer {i}: {x.kind} doesn't run in a plan; {sorted(n for n, k in KINDS.items() if k.inferable)} do")
            if (self.use == "both" or self.use == "aggregate" and first) and kind.adapter is None:
                raise ValueError(f"layer {i}: {x.kind} can't be aggregated beforehand; {sorted(n for n, k in KINDS.items() if k.adapter)} can")

    def shapes(self, inputs: int) -> dict[str, tuple[int, ...]]:
        """Shapes of the tensors: conv_0.weight, conv_0.bias, ..., classifier.bias."""
        out, width = {}, inputs
        for name, n in (*((f"conv_{i}", x.width) for i, x in enumerate(self.layers)), ("classifier", self.classes)):
            out |= {f"{name}.weight": (n, width), f"{name}.bias": (n,)}
            width = n
        return out

    def spec(self, tensors: dict[str, Any]) -> ModelSpec:
        """The model with these tensors, whose shapes are checked."""
        inputs = len(tensors["conv_0.weight"][0])
        for name, shape in self.shapes(inputs).items():
            found = tensors.get(name)
            if found is None or (len(found), *([len(found[0])] if len(shape) == 2 else [])) != shape:
                raise ValueError(f"{name} must have the shape {shape}")
        layers = []
        for i, x in enumerate(self.layers):
            layers += [Layer("aggregate", KINDS[x.kind].method), Layer("linear", weight=f"conv_{i}.weight", bias=f"conv_{i}.bias")]
            layers += [Layer(x.activation)] if x.activation else []
        layers.append(Layer("linear", weight="classifier.weight", bias="classifier.bias"))
        fanouts = [self.fanouts] * len(self.layers) if isinstance(self.fanouts, int) else list(self.fanouts)
        return ModelSpec(len(self.layers), fanouts, layers, tensors).check()

    def preaggregated(self, tensors: dict[str, Any]) -> ModelSpec:
        """The model for nodes whose features are the first layer's aggregation already."""
        adapter = KINDS[self.layers[0].kind].adapter
        if adapter is None:
            raise ValueError(f"{self.layers[0].kind} can't be aggregated beforehand")
        spec = self.spec(tensors)
        end = next((i for i, x in enumerate(spec.layers) if i and x.op == "aggregate"), len(spec.layers))
        rest = adapter(spec.layers[:end]) + spec.layers[end:]
        return replace(spec, num_hops=spec.num_hops - 1, fanouts=spec.fanouts[1:], layers=rest).check()
