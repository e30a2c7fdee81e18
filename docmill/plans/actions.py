"""Workflows: named steps over a context of DataFrames, with optional conditions and checkpoints as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Context = dict[str, DataFrame]


class Workflow:
    def __init__(self):
        self.steps: list[tuple[str, Callable[[Context], DataFrame], Callable[[Context], bool] | None]] = []

    def step(self, name: str, action: Callable[[Context], DataFrame], when: Callable[[Context], bool] | None = None) -> Workflow:
        self.steps.append((name, action, when))
        return self

    def run(self, context: Context, folder: str | None = None) -> Context:
        """Runs the steps in order; with a folder each result is written, and found there when the run is repeated."""
        context = dict(context)
        for name, action, when in self.steps:
            if when is not None and not when(context):
                continue
            df = action(context)
            if folder is not None:
                df.write.mode("ignore").parquet(f"{folder}/{name}")
                df = df.sparkSession.read.parquet(f"{folder}/{name}")
            context[name] = df
        return context
