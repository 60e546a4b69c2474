"""Named tools: functions from frames to frames, called by name, with a log of the calls."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracequarry.operators.corpus import snapshot_changes
from tracequarry.plans.shared import materialise
from tracequarry.sources.files import snapshot

HISTORY = "call_no long, tool string, arguments map<string, string>, status string, error string"


class Tools:
    """A registry. The log holds one row a call, so its size is that of what a caller did, not of the data."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.known: dict[str, Callable] = {}
        self._log: list[tuple] = []

    def register(self, tool: Callable, name: str | None = None) -> None:
        """Parameters must have annotations, as callers see them by name and type; a later tool of a name replaces the former."""
        name = name or tool.__name__
        missing = [p.name for p in inspect.signature(tool).parameters.values() if p.annotation is inspect.Parameter.empty]
        if missing:
            raise TypeError(f"{name}: no annotation for {', '.join(missing)}")
        self.known[name] = tool

    def register_all(self, owner: object, private: bool = False) -> None:
        """Every method of an object, those with a leading underscore only on request."""
        for name, tool in inspect.getmembers(owner, callable):
            if not name.startswith("__") and (private or not name.startswith("_")) and not inspect.isclass(tool):
                self.register(tool, name)

    def execute(self, name: str, **arguments):
        """The tool's result; a failure is logged and raised again."""
        seen = {k: type(v).__name__ if isinstance(v, DataFrame) else str(v) for k, v in arguments.items()}
        try:
            if name not in self.known:
                raise KeyError(f"no tool {name}")
            out = self.known[name](**arguments)
        except Exception as e:
            self._log.append((len(self._log), name, seen, "error", str(e)))
            raise
        self._log.append((len(self._log), name, seen, "success", None))
        return out

    def history(self) -> DataFrame:
        return self.spark.createDataFrame(self._log, HISTORY)


def monitored(spark: SparkSession, root: str, action: Callable[[], object]) -> tuple[object, DataFrame]:
    """What an action returns, and the files below root that it made, changed or deleted (path, change)."""
    before = materialise(snapshot(spark, root), "before")
    out = action()
    return out, snapshot_changes(before, materialise(snapshot(spark, root), "after"))
