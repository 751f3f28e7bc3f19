"""Registry of the queries: a Spark callable and, where SQL can say it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gatelight.session import ship_package


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    """A named SQL building block; ``needs`` are the blocks it reads."""
    _VIEWS[name] = (needs, body)


def _ordered(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _ordered(_VIEWS[name][0], seen)
            if name not in seen:
                seen.append(name)
    return seen


def oracle(body: str, *needs: str) -> str:
    names = _ordered(needs, [])
    if not names:
        return body
    blocks = ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in names)
    return f"WITH RECURSIVE {blocks}\n{body}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Registers ``fn(inputs) -> DataFrame`` under ``name``."""
    from gatelight.catalog.inputs import Inputs

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Inputs(spark, sf_dir))

        QUERIES[name] = Query(run, oracle(sql, *needs) if sql else None)
        return fn

    return register
