"""Models in Python workers: loaded once a worker, fed in batches of bounded cost, checked for their dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np

Encode = Callable[[Sequence[Any]], Sequence[Sequence[float]]]
#: Loaded models of this worker, by name.
_LOADED: dict[str, Encode] = {}


@dataclass(frozen=True)
class Encoder:
    """A model by the function that loads it.

    ``load()`` runs once in every Python worker that needs the model, whatever the number of tasks and batches; ``name``
    tells models apart, so a new version needs a new name.  ``most`` items go to the model at once, and no more than
    ``cost`` in all, where a batch costs its longest item's length times its size, as padded batches do.  Vectors are kept
    in single precision, or in ``double`` where a model's last digits count.
    """

    name: str
    load: Callable[[], Encode]
    dimension: int
    most: int = 256
    cost: int = 100_000
    length: Callable[[Any], int] = lambda x: len(x) if x is not None else 0
    double: bool = False

    def model(self) -> Encode:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]

    def batches(self, items: Sequence[Any]) -> Iterator[list[int]]:
        """Places of items that are encoded together: in order of length, so that little is padded."""
        sizes = [max(1, self.length(x)) for x in items]
        held: list[int] = []
        for i in sorted(range(len(items)), key=lambda i: (sizes[i], i)):
            if held and (len(held) >= self.most or sizes[i] * (len(held) + 1) > self.cost):
                yield held
                held = []
            held.append(i)
        if held:
            yield held

    def encode(self, items: Sequence[Any]) -> list[np.ndarray]:
        """A vector for each item, in their order; a missing vector, a wrong dimension or a number that is not finite is an error."""
        out: list[np.ndarray | None] = [None] * len(items)
        for places in self.batches(items):
            vectors = self.model()([items[i] for i in places])
            if len(vectors) != len(places):
                raise ValueError(f"{self.name} gave {len(vectors)} vectors for {len(places)} items")
            for i, v in zip(places, vectors, strict=True):
                v = np.asarray(v, np.float64 if self.double else np.float32)
                if v.shape != (self.dimension,) or not np.isfinite(v).all():
                    raise ValueError(f"{self.name} gave no vector of {self.dimension} finite numbers")
                out[i] = v
        return out
