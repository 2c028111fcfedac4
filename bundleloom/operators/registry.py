"""Optimizers by extension: a column builder, or an Arrow function for what columns can't express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from bundleloom.options import Options


@dataclass(frozen=True)
class Optimizer:
    """``columns(rel, data, options)`` gives (data, note) columns, or ``media(bytes, options)`` a tuple for one file."""

    name: str
    columns: Callable[[Column, Column, Options], tuple[Column, Column]] | None = None
    media: Callable[[bytes, Options], tuple[bytes, int, bool, str]] | None = None


_registry: dict[str, Optimizer] = {}


def register(optimizer: Optimizer, *extensions: str) -> None:
    """Bind extensions, folded to lower case with a leading dot; the last registration wins."""
    for e in extensions:
        _registry["." + e.lower().lstrip(".")] = optimizer


def _load() -> None:
    """The built-in optimizers register themselves when their module is first needed."""
    import bundleloom.operators.optimize  # noqa: F401


def lookup(extension: str) -> Optimizer | None:
    _load()
    return _registry.get(extension.lower())


def extensions() -> list[str]:
    """Registered extensions, ascending."""
    _load()
    return sorted(_registry)


def by_optimizer() -> dict[Optimizer, list[str]]:
    out: dict[Optimizer, list[str]] = {}
    for e in extensions():
        out.setdefault(_registry[e], []).append(e)
    return out


def table(spark: SparkSession) -> DataFrame:
    """``(ext, optimizer)``: one row for each registered extension, small enough to broadcast."""
    return spark.createDataFrame([(e, _registry[e].name) for e in extensions()], "ext string, optimizer string")
