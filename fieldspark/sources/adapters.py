"""Named adapters: functions that return a model's fields for a box and a time window in a canonical schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from fieldspark.schemas import SCHEMAS, checked

Adapter = Callable[[SparkSession, Sequence[float] | None, tuple[str, str]], DataFrame]
_ADAPTERS: dict[str, tuple[str, Adapter]] = {}


def register_adapter(name: str, schema: str = "place_value") -> Callable[[Adapter], Adapter]:
    """Register the decorated `fn(spark, box, (start, end))` under `name`; what it returns is checked against the
    canonical schema. A name can be taken once."""
    if schema not in SCHEMAS:
        raise KeyError(f"no schema {schema!r}")

    def add(fn: Adapter) -> Adapter:
        if name in _ADAPTERS:
            raise ValueError(f"adapter {name!r} is registered twice")
        _ADAPTERS[name] = (schema, fn)
        return fn

    return add


def drop_adapter(name: str) -> None:
    _ADAPTERS.pop(name, None)


def adapters() -> list[str]:
    return sorted(_ADAPTERS)


def read_adapter(spark: SparkSession, name: str, box: Sequence[float] | None, window: tuple[str, str]) -> DataFrame:
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name!r}; adapters: {adapters()}")
    schema, fn = _ADAPTERS[name]
    return checked(fn(spark, box, window), schema)
