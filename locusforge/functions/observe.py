"""Phases of a run: their times and rows, as events for a callback or a file of JSON lines, and as a table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LEVELS = ["off", "summary", "events"]


@dataclass
class Observer:
    """`summary` keeps phases alone; `events` also tells of each start and end. A callback or file that fails is counted and never ends the run."""

    level: str = "summary"
    callback: Callable[[dict], None] | None = None
    jsonl: str | None = None
    phases: list[dict] = field(default_factory=list)
    failures: int = 0

    def __post_init__(self):
        if self.level not in LEVELS:
            raise ValueError(f"the level has to be one of {', '.join(LEVELS)}")
        if self.level == "summary" and (self.callback or self.jsonl):
            self.level = "events"

    def _tell(self, event: dict) -> None:
        if self.level != "events":
            return
        try:
            if self.callback:
                self.callback(event)
            if self.jsonl:
                Path(self.jsonl).parent.mkdir(parents=True, exist_ok=True)
                with open(self.jsonl, "a", encoding="utf-8") as f:
                    f.write(json.dumps(event) + "\n")
        except Exception:  # what watches a run must not end it
            self.failures += 1

    @contextmanager
    def phase(self, name: str) -> Iterator[dict]:
        """The block gets a record that it may add `rows` to."""
        found = {"phase": name, "status": "running", "rows": None}
        if self.level == "off":
            yield found
            return
        began = time.time()
        self._tell({"event": "start", "phase": name, "at": began})
        try:
            yield found
            found["status"] = "done"
        except BaseException:
            found["status"] = "failed"
            raise
        finally:
            found["seconds"] = round(time.time() - began, 3)
            self.phases.append(found)
            self._tell({"event": "end", "at": time.time(), **found})

    def summary(self) -> dict[str, float]:
        """Seconds by phase; of one that ran more than once, their sum."""
        out: dict[str, float] = {}
        for p in self.phases:
            out[f"{p['phase']}_s"] = round(out.get(f"{p['phase']}_s", 0.0) + p["seconds"], 3)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p["phase"], p["status"], p["seconds"], p["rows"]) for p in self.phases]
        return spark.createDataFrame(rows, "phase string, status string, seconds double, rows long")
