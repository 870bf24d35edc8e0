"""A layout pipeline as a list of stages, observed in the one pass that runs it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Rows of results that are handed on together.
HANDED_ON = 4096


class Step(NamedTuple):
    """A stage of a pipeline: a name, what it makes of a table, and figures of its rows (SQL aggregates) beside their number."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    figures: tuple[str, ...] = ()


def batched(df: DataFrame, forward: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = 16) -> DataFrame:
    """Rows of ``forward`` on batches of ``size`` rows at most: a model, or what stands in for one, is the caller's.

    What comes of some hundred batches goes on together, as each table that is handed to Spark has a cost of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            held, rows = [], 0
            for k in range(0, len(frame), size):
                held.append(forward(frame.iloc[k : k + size]))
                rows += len(held[-1])
                if rows >= HANDED_ON:
                    yield pd.concat(held, ignore_index=True)
                    held, rows = [], 0
            if held:
                yield pd.concat(held, ignore_index=True)

    return df.mapInPandas(run, schema)


def batched_column(df: DataFrame, column: str, forward: Callable[[list], list], name: str, kind: str = "string", size: int = 16) -> DataFrame:
    """Add ``name``: what ``forward`` makes of the values of ``column``, ``size`` of them at most. Other columns go by as they are, so a small batch costs little beside the model."""
    schema = StructType([*df.schema, *StructType.fromDDL(f"`{name}` {kind}")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column).to_pylist()
            made = [v for k in range(0, len(values), size) for v in forward(values[k : k + size])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow.field(name).type)], names=schema.names)

    return df.mapInArrow(run, schema)


class Pipeline:
    """Stages one after another, in a single plan. What a stage puts out is counted as it goes by: no stage runs for its figures alone.

    Figures are those of the one action on the plan; a task that runs twice counts once in them, as Spark takes
    them from the results that counted.
    """

    def __init__(self, steps: list[Step]) -> None:
        if len({s.name for s in steps}) < len(steps):
            raise ValueError("stages need names of their own")
        self.steps = steps

    def plan(self, df: DataFrame, seen: dict[str, Observation] | None = None) -> DataFrame:
        """The table that the stages make; ``seen`` gets an observation for each."""
        for step in self.steps:
            df = step.apply(df)
            if seen is not None:
                seen[step.name] = Observation(f"{step.name}")
                df = df.observe(seen[step.name], F.count(F.lit(1)).alias("rows"), *map(F.expr, step.figures))
        return df

    def run(self, df: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, dict[str, object]]:
        """Have ``write`` store what the stages make, and return each stage's figures."""
        seen: dict[str, Observation] = {}
        write(self.plan(df, seen))
        return {name: dict(o.get) for name, o in seen.items()}
