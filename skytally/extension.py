"""Seams for users' own steps: named functions, and ordered pipelines of DataFrame transformations that remember what they did."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import greedy, overlap, sampling

Step = Callable[[DataFrame], DataFrame]


class Registry:
    """Functions by name; a name is given once."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            if name in self._known:
                raise ValueError(f"{self.kind} {name} is registered already")
            self._known[name] = f
            return f

        return add

    def __getitem__(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self._known))}")
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._known))


@dataclass
class Pipeline:
    """Steps that run in order; history has what each run did, by name and columns."""

    steps: list[tuple[str, Step]] = field(default_factory=list)
    history: list[list[tuple[str, list[str]]]] = field(default_factory=list)

    def add(self, name: str, step: Step, before: str | None = None) -> Pipeline:
        if name in (n for n, _ in self.steps):
            raise ValueError(f"there is a step {name} already")
        at = len(self.steps) if before is None else [n for n, _ in self.steps].index(before)
        self.steps.insert(at, (name, step))
        return self

    def remove(self, name: str) -> Pipeline:
        self.steps.pop([n for n, _ in self.steps].index(name))
        return self

    def __call__(self, rows: DataFrame) -> DataFrame:
        done = []
        for name, step in self.steps:
            rows = rows.transform(step)
            done.append((name, rows.columns))
        self.history.append(done)
        return rows


#: strategy(rows, n): a sample of n rows.
samplers = Registry("sampling strategy")
#: strategy(footprints, threshold): edges.
overlaps = Registry("overlap strategy")
#: strategy(detections, threshold): those that stay.
removals = Registry("duplicate removal")
#: converter(spark, path): tables.
converters = Registry("converter")


def by_order(order: Column | str) -> Callable[[DataFrame, int], DataFrame]:
    return lambda rows, n: rows.orderBy(order).limit(n)


samplers.register("first")(by_order("image_id"))
samplers.register("random")(lambda rows, n: rows.orderBy(sampling.shuffle_key("image_id"), F.col("image_id")).limit(n))
overlaps.register("complete_iou")(overlap.edges)
removals.register("nms")(greedy.nms)
removals.register("first_of_equal")(lambda rows, threshold=None: rows.dropDuplicates(["image_id", *greedy.BOX]))
