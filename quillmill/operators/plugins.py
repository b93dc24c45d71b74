"""Where models and tools are plugged in: encoders, scorers and deciders run in batches on the executors, tools in a registry.

No model is shipped. A factory is called once in each worker and gives a function over lists; its results become columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_made: dict = {}


def _once(key: str, factory: Callable):
    if key not in _made:
        _made[key] = factory()
    return _made[key]


def mapped(rows: DataFrame, column: str, out: str, kind: str, key: str, factory: Callable[[], Callable[[list], list]], batch: int = 64) -> DataFrame:
    """rows with `out` (of type `kind`): what the model makes of `column`, `batch` values at a time. key names the model in a worker."""
    names = rows.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _once(key, factory)
        for b in batches:
            values = b.column(at).to_pylist()
            got = [y for k in range(0, len(values), batch) for y in model(values[k : k + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out)
    return rows.mapInArrow(run, f"{schema}, `{out}` {kind}")


def encoded(rows: DataFrame, column: str, key: str, factory: Callable[[], Callable[[list], list]], batch: int = 64) -> DataFrame:
    """rows with vec, the vector of each text or image."""
    return mapped(rows, column, "vec", "array<double>", key, factory, batch)


def scored(rows: DataFrame, column: str, key: str, factory: Callable[[], Callable[[list], list]], batch: int = 64) -> DataFrame:
    """rows with score, what a judge or verifier gives each value."""
    return mapped(rows, column, "score", "double", key, factory, batch)


def only_missing(rows: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results from the cache, and computed ones for keys that it lacks."""
    return cache.join(rows.select(key).distinct(), key, "left_semi").unionByName(compute(rows.join(cache.select(key), key, "left_anti")).select(*cache.columns))


class Registry:
    """Tools by name."""

    def __init__(self) -> None:
        self._tools: dict[str, Callable] = {}

    def add(self, name: str, tool: Callable) -> Callable:
        if name in self._tools:
            raise ValueError(f"a tool named {name} is there already")
        self._tools[name] = tool
        return tool

    def names(self) -> list[str]:
        return sorted(self._tools)

    def call(self, name: str, *args, **options) -> tuple[bool, object]:
        """(whether it worked, its result or what went wrong): an unknown tool or a failing one never raises."""
        if name not in self._tools:
            return False, f"unknown tool {name!r}; use one of {self.names()}"
        try:
            return True, self._tools[name](*args, **options)
        except Exception as e:
            return False, f"tool execution error: {e}"
