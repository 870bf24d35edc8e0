"""Seams for model stages: a stage is a function of Arrow-backed pandas batches with a schema, loaded once in a worker."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame

_loaded: dict[tuple, object] = {}


class Stage(ABC):
    """A model in the pipeline: :meth:`load` runs once in each Python worker, :meth:`infer` on each batch.

    A worker keeps what it has loaded for its next tasks, or, with ``keep`` false,
    unloads it when a task has seen all its rows.
    """

    schema: ClassVar[str]

    def __init__(self, keep: bool = True) -> None:
        self.keep = keep

    def key(self) -> tuple:
        return (type(self).__module__, type(self).__qualname__)

    @abstractmethod
    def load(self) -> object:
        """What inference needs: weights, a client."""

    def unload(self, model: object) -> None:
        """What is to be done with a model before it goes, such as closing a client."""

    def reload(self) -> object:
        """A fresh model in place of the one held."""
        self.drop()
        _loaded[self.key()] = model = self.load()
        return model

    def drop(self) -> None:
        if self.key() in _loaded:
            self.unload(_loaded.pop(self.key()))

    @abstractmethod
    def infer(self, model: object, batch: pd.DataFrame) -> pd.DataFrame:
        """The stage's rows for a batch."""

    def apply(self, df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if self.key() not in _loaded:
                _loaded[self.key()] = self.load()
            for batch in batches:
                yield self.infer(_loaded[self.key()], batch)
            if not self.keep:
                self.drop()

        return df.mapInPandas(run, self.schema)


REGISTRY: dict[str, Callable[[bool], Stage]] = {}


def register(name: str) -> Callable[[type[Stage]], type[Stage]]:
    def add(kind: type[Stage]) -> type[Stage]:
        REGISTRY[name] = kind
        return kind

    return add


def prepare(name: str, keep: bool = True) -> Stage:
    """The stage registered under ``name``; workers load it with their first batch."""
    if name not in REGISTRY:
        raise ValueError(f"no stage {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](keep)


def dispatch(name: str, df: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of the stage registered under ``name`` for ``df``."""
    return prepare(name, keep).apply(df)


@register("identity translator")
class IdentityTranslator(Stage):
    """Gives each text back, as diagnostics do."""

    schema = "page_id long, line_id long, translation string"

    def load(self) -> object:
        return str

    def infer(self, model: object, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": batch["page_id"], "line_id": batch["line_id"], "translation": batch["text"].map(model)})
