"""Keeping a verification queue current while proposals, verdicts and tasks still arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CELL = ("task", "arm", "seed")

#: What is kept of a task: whether it is known, its cells that wait with their rows, its cells that are done with.
_STATE = "known boolean, waiting string, closed string"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a task that join the queue now that these have arrived, whatever order they came in."""
    known, waiting, closed = state.get if state.exists else (False, "{}", "[]")
    waiting, closed = json.loads(waiting), set(json.loads(closed))
    for frame in frames:
        known = known or bool((frame["kind"] == "task").any())
        closed.update(frame.loc[frame["kind"] == "verdict", "cell"])
        asked = frame[frame["kind"] == "proposal"]
        for cell, row in zip(asked["cell"], asked["row"], strict=True):
            waiting.setdefault(cell, row)
    waiting = {cell: row for cell, row in waiting.items() if cell not in closed}
    ready, left = (waiting, {}) if known else ({}, waiting)
    state.update((bool(known), json.dumps(left), json.dumps(sorted(closed | set(ready)))))
    yield pd.DataFrame({"row": list(ready.values())}, dtype=str)


def arrivals(proposals: DataFrame, verdicts: DataFrame, tasks: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """All three as rows of one stream: (task, kind, cell, row)."""
    task = F.col(cell[0]).cast("string").alias("task")
    named = F.to_json(F.struct(*cell)).alias("cell")
    none = F.lit(None).cast("string")
    return (
        proposals.select(task, F.lit("proposal").alias("kind"), named, F.to_json(F.struct(*proposals.columns)).alias("row"))
        .unionByName(verdicts.select(task, F.lit("verdict").alias("kind"), named, none.alias("row")))
        .unionByName(tasks.select(task, F.lit("task").alias("kind"), none.alias("cell"), none.alias("row")))
    )


def follow_queue(
    spark: SparkSession, proposals: str, schema: str, verified: str, verified_schema: str, tasks: str,
    out: str, checkpoint: str, cell: Sequence[str] = CELL,
) -> StreamingQuery:
    """Append each proposal that has no verdict once its task is known, a cell at most once.

    ``proposals``, ``verified`` and ``tasks`` are folders of JSON lines that grow. What waits for its task is state of the
    task, which the checkpoint carries over restarts; a batch touches only tasks of which something arrived. A verdict
    that arrives no later than what releases a proposal keeps it out of the queue.
    """
    def stream(path: str, of: str) -> DataFrame:
        return spark.readStream.schema(of).json(path)

    key = spark.createDataFrame([], schema).select(cell[0]).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    all_ = arrivals(stream(proposals, schema), stream(verified, verified_schema), stream(tasks, key), cell)
    queued = all_.groupBy("task").applyInPandasWithState(_advance, "row string", _STATE, "append", GroupStateTimeout.NoTimeout)
    rows = queued.select(F.from_json("row", schema).alias("r")).select("r.*")
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
