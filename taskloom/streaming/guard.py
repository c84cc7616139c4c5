"""A guard over running trainings: the alarms of trajectories.collapse(), as the rollouts come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "seen boolean, streak int, last long, alarmed boolean"


def collapse_alarms(rollouts: DataFrame, after: int = 2, initial: int = 5) -> DataFrame:
    """(run, first_alarm) of a stream of rollouts (run, rollout_id, mean_reward): a row when a run falls to zero for `after` in a row, or begins with `initial` zeros.

    A run's state is whether it ever had another reward, its zeros in a row, its last rollout and whether it gave its alarm, which it does once. Within a
    batch rollouts are taken by id; from batch to batch they must come in that order, as a training writes them: one whose id is not
    above the run's last is left out, so that a file that comes twice changes nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, streak, last, alarmed = state.get if state.exists else (False, 0, None, False)
        f = pd.concat(list(frames)).sort_values("rollout_id")
        alarm = None
        for at, reward in zip(f["rollout_id"].tolist(), f["mean_reward"].tolist(), strict=True):
            if last is not None and at <= last:
                continue
            last = at
            seen, streak = (seen, streak + 1) if reward == 0 else (True, 0)
            if not alarmed and streak >= (after if seen else initial):
                alarmed, alarm = True, at
        state.update((seen, streak, last, alarmed))
        if alarm is not None:
            yield pd.DataFrame({"run": [key[0]], "first_alarm": [alarm]})

    schema = f"run {rollouts.schema['run'].dataType.simpleString()}, first_alarm long"
    return rollouts.groupBy("run").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str, **patience: int) -> None:
    """Alarms of the JSON lines that are in `folder` and were not read before, appended to Parquet files in `out`; goes on from `checkpoint`, also after a stop in the middle of a batch."""
    alarms = collapse_alarms(spark.readStream.schema(schema).json(folder), **patience)
    alarms.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
