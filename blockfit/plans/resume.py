"""Rounds of a trainer kept in a folder, from which a stopped fit goes on."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

#: What a problem may hold on the driver between two rounds.
_HELD = ("x", "u", "z", "_x_bar", "_bar_before", "_z_before")


class SavedRounds:
    """Round number, ``z``, the block states and the history, written together below ``folder``.

    A round is a folder of its own: first the state table, if the states are one, then the arrays of the driver with
    number, parameters and history in one Parquet file, whose ``_SUCCESS`` completes it. Rounds that are not complete
    are ignored; older ones are deleted once a later one is complete. ``folder`` must be shared by all
    executors and belong to one fit: other ``params`` than those written are an error, other data are not noticed.
    """

    def __init__(self, spark: SparkSession, folder: str, params: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.params = json.dumps(params, sort_keys=True)
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _rounds(self) -> list[tuple[int, str]]:
        """Complete and other rounds as (number, folder), the latest first."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        numbers = [int(n.removeprefix("round-")) for n in names if n.startswith("round-")]
        return [(n, f"{self.folder}/round-{n}") for n in sorted(numbers, reverse=True)]

    def _of(self, problem) -> list[str]:
        """What has to be the same when going on: parameters, and whether the states are a table."""
        return [type(problem).__name__, self.params]

    def _complete(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{folder}/driver/_SUCCESS"))

    def write(self, problem, done: int, history: list[dict], finished: bool) -> None:
        """Keep the state after ``done`` rounds."""
        target = f"{self.folder}/round-{done}"
        if self._complete(target):
            return
        state = getattr(problem, "state", None)
        if state is not None:
            state.write.mode("overwrite").parquet(f"{target}/state")
        facts = {"done": done, "finished": finished, "history": history, "params": self._of(problem)}
        rows = [("", [], bytearray(json.dumps(facts).encode()))]
        for name in _HELD:
            value = getattr(problem, name, None)
            if isinstance(value, np.ndarray):
                rows.append((name, list(value.shape), bytearray(np.ascontiguousarray(value, float).tobytes())))
        table = self.spark.createDataFrame(rows, "name string, shape array<long>, data binary")
        table.coalesce(1).write.mode("overwrite").parquet(f"{target}/driver")
        for number, folder in self._rounds():
            if number < done:
                self._fs.delete(self._path(folder), True)

    def restore(self, problem) -> tuple[int, list[dict], bool]:
        """Give ``problem`` the latest complete state; ``(rounds done, history, finished)``."""
        for _, folder in self._rounds():
            if not self._complete(folder):
                continue
            rows = {r["name"]: r for r in self.spark.read.parquet(f"{folder}/driver").collect()}
            facts = json.loads(bytes(rows.pop("")["data"]))
            if facts["params"] != self._of(problem):
                raise ValueError(f"{self.folder} holds rounds of a fit with other parameters")
            for name, row in rows.items():
                setattr(problem, name, np.frombuffer(bytes(row["data"])).reshape(row["shape"]).copy())
            if getattr(problem, "state", None) is not None:
                problem.take_state(self.spark.read.parquet(f"{folder}/state"))
            return facts["done"], facts["history"], facts["finished"]
        return 0, [], False
