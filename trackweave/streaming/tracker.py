"""Streams: the single-object follower with state for each case, windowed state counts, and progress lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.operators.frames import CORE, core_step
from trackweave.operators.tracking import FOLLOWED, Follower

STATE = "x double, y double, vx double, vy double, area double, seen long, streak long"


def follow_stream(rows: DataFrame, reach: float) -> DataFrame:
    """The batch operator ``follow`` over a stream of (case_id, frame, cx, cy, area, measured): rows of a case are taken in frame
    order within a micro-batch, and its state goes on from batch to batch."""

    def advance(key, batches, state: GroupState):
        f = Follower(*state.get) if state.exists else Follower()
        rows_ = pd.concat(list(batches)).sort_values("frame", kind="stable")
        out = [f.step(*r, reach) for r in zip(rows_["cx"], rows_["cy"], rows_["area"], rows_["measured"])]
        state.update(f.values())
        yield pd.DataFrame({"case_id": rows_["case_id"].to_numpy(), "frame": rows_["frame"].to_numpy(), "state": [o[0] for o in out], "follow_confidence": [o[1] for o in out], "reason": [o[2] for o in out]})

    return rows.select("case_id", "frame", "cx", "cy", "area", "measured").groupBy("case_id").applyInPandasWithState(advance, FOLLOWED, STATE, "append", GroupStateTimeout.NoTimeout)


def state_counts(events: DataFrame, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Rows per window and event type over an event-time stream; rows later than ``late`` are dropped with their windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def progress(lines: DataFrame, column: str = "value") -> DataFrame:
    """Progress events of JSON lines: (kind, stage, frame, total, percent, message); other lines are log rows."""
    doc = F.try_parse_json(column)
    get = lambda name, kind: F.try_variant_get(doc, f"$.{name}", kind)
    stage = get("stage", "string")
    return lines.select(F.when(stage.isNotNull(), "progress").otherwise("log").alias("kind"), stage.alias("stage"), get("frame", "int").alias("frame"), get("total", "int").alias("total"), get("percent", "double").alias("percent"), F.when(stage.isNull(), F.col(column)).otherwise(get("message", "string")).alias("message"))


def core_stream(candidates: DataFrame) -> DataFrame:
    """The batch operator ``core_track`` over a stream of its candidates: each case's last core, an array, is the state that goes on."""

    def advance(key, batches, state: GroupState):
        core = list(state.get[0]) if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("frame", kind="stable").itertuples(index=False):
            core, found = core_step(core, r.height, r.width, list(r.cores))
            out.append((r.case_id, r.frame, *found, r.masked))
        if core is not None:
            state.update((core,))
        rows = pd.DataFrame(out, columns=[c.split()[0] for c in CORE.split(", ")])
        yield rows.astype(dict.fromkeys("xywh", "Int64"))

    rows = candidates.select("case_id", "frame", "height", "width", "cores", "masked")
    return rows.groupBy("case_id").applyInPandasWithState(advance, CORE, "core array<double>", "append", GroupStateTimeout.NoTimeout)
