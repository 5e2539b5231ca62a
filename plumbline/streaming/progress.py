"""Job progress from log rows, as a batch window and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def progress(rows: DataFrame, job: str, seq: str, raw: str) -> DataFrame:
    """``rows`` with the running maximum ``progress`` of each job and its ``status``."""
    upto = Window.partitionBy(job).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("progress", F.max(raw).over(upto))
    state = F.when(F.col("progress") >= 100, "complete").when(F.col(seq) == 1, "queued").otherwise("running")
    return out.withColumn("status", state)


def progress_stream(rows: DataFrame, job: str, raw: str) -> DataFrame:
    """The running maximum of a stream of ``job, raw``: one row a job and micro-batch, never falling."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else -1
        for b in batches:
            if len(b):
                top = max(top, int(b[raw].max()))
        state.update((top,))
        yield pd.DataFrame({job: [key[0]], "progress": [top]})

    kind = dict(rows.dtypes)[job]
    return rows.groupBy(job).applyInPandasWithState(step, f"{job} {kind}, progress long", "top long", "update", GroupStateTimeout.NoTimeout)


def recovered(states: DataFrame, status: str = "status") -> DataFrame:
    """States after a restart: what was queued or running has failed."""
    return states.withColumn(status, F.when(F.col(status).isin("queued", "running"), "failed").otherwise(F.col(status)))
