"""Folds over a case's rows in frame order, where what was kept decides what comes next.

A fold holds a few numbers a case and one Arrow batch of rows sorted by Spark, so a case is as long as it likes; the same
step serves the batch operators here and the streaming one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Frames a track may pause, and rows a follower predicts through before it is lost.
MAX_GAP, MAX_PREDICTED = 8, 8


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], schema: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``fold`` over each key's rows in ``order``: it takes the rows one by one, as tuples, and yields result rows of ``schema``.

    Rows are dealt by key and sorted by Spark; a worker holds one batch, whatever a key's length.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    at = [rows.columns.index(k) for k in keys]

    def run(batches):
        out: list[tuple] = []

        def each():  # rows in order; between batches the caller's results are sent on
            for b in batches:
                yield from b.itertuples(index=False, name=None)

        stream = each()
        head = next(stream, None)
        while head is not None:
            key, first, head = tuple(head[i] for i in at), head, None

            def own():
                nonlocal head
                yield first  # noqa: B023
                for row in stream:
                    if tuple(row[i] for i in at) != key:  # noqa: B023
                        head = row
                        return
                    yield row

            mine = own()
            for result in fold(mine):
                out.append(result)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            for _ in mine:  # rows that the fold did not ask for
                pass
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def link(rows, max_distance: float, exclusive: bool = False):
    """Track number of each (frame, x, y), candidates of a frame in given order: the nearest open track strictly closer than
    ``max_distance``, the older on ties, else a new one. Unless ``exclusive``, a track may take several candidates of a frame."""
    open_, made = {}, 0
    for frame, x, y in rows:
        open_ = {k: t for k, t in open_.items() if frame - t[0] <= MAX_GAP}
        best, near = None, max_distance
        for k, (_, tx, ty, taken) in open_.items():
            d = math.hypot(x - tx, y - ty)
            if d < near and not (exclusive and taken == frame):
                best, near = k, d
        if best is None:
            made += 1
            best = made
        open_[best] = (frame, x, y, frame)
        yield best


def link_tracks(candidates: DataFrame, max_distance: float, exclusive: bool = False) -> DataFrame:
    """(case_id, frame, ord, track): greedy linking of candidates (case_id, frame, ord, cx, cy).

    No track outlives a pause of more than MAX_GAP frames, so a case is cut there and its stretches are linked apart.
    """
    per_case = Window.partitionBy("case_id").orderBy("frame", "ord")
    pause = F.coalesce((F.col("frame") - F.lag("frame").over(per_case) > MAX_GAP).cast("int"), F.lit(0))
    rows = candidates.select("case_id", "frame", "ord", "cx", "cy", pause.alias("pause"))
    rows = rows.select("case_id", F.sum("pause").over(per_case).alias("stretch"), "frame", "ord", "cx", "cy")

    def fold(own):
        held: list[tuple] = []

        def places():
            for r in own:
                held.append(r)
                yield r[2], r[4], r[5]

        for track in link(places(), max_distance, exclusive):
            yield (*held.pop(), track)

    linked = fold_sorted(rows, ["case_id", "stretch"], ["frame", "ord"], "case_id long, stretch long, frame long, ord long, cx double, cy double, track long", fold)
    made = linked.groupBy("case_id", "stretch").agg(F.max("track").alias("made"))
    earlier = F.sum("made").over(Window.partitionBy("case_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    before = made.select("case_id", "stretch", F.coalesce(earlier, F.lit(0)).alias("before"))
    return linked.join(before, ["case_id", "stretch"]).select("case_id", "frame", "ord", (F.col("track") + F.col("before")).alias("track"))


@dataclass
class Follower:
    """What a single-object tracker remembers."""

    x: float = 0.0
    y: float = 0.0
    vx: float = 0.0
    vy: float = 0.0
    area: float = 0.0
    seen: int = 0
    streak: int = 0

    def step(self, x: float, y: float, area: float, measured: bool, reach: float) -> tuple[str, float, str]:
        """(state, confidence, reason) of a row: the measurement if it is near the prediction and of like size, else a prediction
        for up to MAX_PREDICTED rows (the first two of low confidence), then lost."""
        if not self.seen:
            if not measured:
                return "waiting", 0.0, "before the first object frame"
            self.x, self.y, self.area, self.seen = x, y, area, 1
            return "tracked", 0.96, "initial box"
        px, py = self.x + self.vx, self.y + self.vy
        share = area / max(1.0, self.area)
        reason = "no_measurement" if not measured else "jump_too_large" if math.hypot(x - px, y - py) > reach else "size_drift" if not 0.25 <= share <= 4.0 else ""
        if not reason:
            state = "auto_recovered" if self.streak else "tracked"
            self.vx, self.vy, self.x, self.y = x - self.x, y - self.y, x, y
            self.seen, self.streak = self.seen + 1, 0
            return state, 0.72 if state == "tracked" else 0.6, "accepted"
        self.streak += 1
        if self.streak <= MAX_PREDICTED:
            return "predicted_only" if self.streak > 2 else "low_confidence", max(0.18, 0.40 - 0.05 * (self.streak - 1)), reason
        return "lost", 0.0, reason

    def values(self) -> tuple:
        return tuple(asdict(self).values())


FOLLOWED = "case_id long, frame long, state string, follow_confidence double, reason string"


def follow(rows: DataFrame, reach: float) -> DataFrame:
    """(case_id, frame, state, follow_confidence, reason) of (case_id, frame, cx, cy, area, measured)."""

    def fold(own):
        f = Follower()
        for case, frame, *r in own:
            yield case, frame, *f.step(*r, reach)

    return fold_sorted(rows.select("case_id", "frame", "cx", "cy", "area", "measured"), ["case_id"], ["frame"], FOLLOWED, fold)


def neighbour_score(x: float, y: float, w: float, at: tuple[float, float, float], direction: int) -> float | None:
    """Score of a step from a bar at (x, y, width) to the next; None outside the gates of step, height and width."""
    dx, dy = (x - at[0]) * direction, abs(y - at[1])
    size = min(w / max(1.0, at[2]), at[2] / max(1.0, w))
    if not 35 <= dx <= 190 or dy > 75 or size < 0.35:
        return None
    return 80.0 * size - 2.0 * abs(dx - 122.0) - 3.0 * dy


def neighbour_walk(bars: DataFrame) -> DataFrame:
    """(case_id, frame, x, y, w): the walk from each case's bar of largest score (of equals the earliest, then least), backwards and
    forwards over (case_id, frame, x, y, w, score): the best-scored bar of each frame; it stops at the first frame without one."""
    bar = F.struct("frame", "x", "y", "w", "score")
    seeds = bars.groupBy("case_id").agg(F.min_by(bar, F.struct(-F.col("score"), "frame", "x", "y", "w")).alias("s"))
    seeds = seeds.select("case_id", F.col("s.frame").alias("sf"), F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("s.w").alias("sw"))
    away = bars.join(seeds, "case_id").where("frame != sf")
    rows = away.select("case_id", F.when(F.col("frame") > F.col("sf"), 1).otherwise(-1).alias("way"), F.abs(F.col("frame") - F.col("sf")).alias("far"), "frame", "x", "y", "w", "score", "sx", "sy", "sw")

    def fold(own):
        at, far, best = None, 1, None
        for case, way, distance, frame, x, y, w, score, *seed in own:
            at = at or tuple(seed)
            if distance > far:
                if best is None or distance > far + 1:
                    break
                yield best[1]
                at, far, best = best[1][2:], distance, None
            s = neighbour_score(x, y, w, at, way)
            if s is not None and (best is None or s + score > best[0]):
                best = s + score, (case, frame, x, y, w)
        if best is not None:
            yield best[1]

    schema = "case_id long, frame long, x double, y double, w double"
    found = fold_sorted(rows, ["case_id", "way"], ["far", "x", "y", "w", "score"], schema, fold)
    return found.union(seeds.select("case_id", F.col("sf").cast("long"), "sx", "sy", "sw"))
