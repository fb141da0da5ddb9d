"""Progress: what went through each stage of a job or of a stream, counted while it runs.

``Stages`` counts rows of a batch job with observed metrics: no second pass, no count job. ``Progress`` is a listener that
gathers the observed metrics of every micro-batch of a stream, and hands each to a callback (a log, a bar, a socket).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Stages:
    """``df = stages.watch("chunks", df)`` for each stage; after the job, ``stages.counts()``."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df``, with its rows counted as ``n`` and any other aggregates by name, when it runs."""
        if name in self._seen:
            raise ValueError(f"stage {name!r} is watched already")
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in metrics.items()])

    def counts(self) -> dict[str, dict[str, object]]:
        """Waits until each stage has run."""
        return {name: dict(o.get) for name, o in self._seen.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, n)."""
        return spark.createDataFrame([(name, found["n"]) for name, found in self.counts().items()], "stage string, n long")


class Progress(StreamingQueryListener):
    """Observed metrics by query, batch and stage, in the order of their batches."""

    def __init__(self, callback: Callable[[dict], None] | None = None):
        self.events: list[dict] = []
        self.callback = callback

    def onQueryStarted(self, event) -> None:
        self._tell({"kind": "started", "query": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell({"kind": "progress", "query": str(p.id), "batch": p.batchId, "rows_read": p.numInputRows, "stages": {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell({"kind": "ended", "query": str(event.id), "error": event.exception})

    def _tell(self, event: dict) -> None:
        self.events.append(event)
        if self.callback is not None:
            self.callback(event)

    def total(self, stage: str, metric: str = "n") -> int:
        """The sum of a metric over all batches so far."""
        return sum(e["stages"][stage][metric] or 0 for e in self.events if e["kind"] == "progress" and stage in e["stages"])
