"""Control boxes around a tracked object, the record of a case's controls, and the gate that later modules ask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import geometry as G
from trackweave.functions import numbers as N
from trackweave.operators import pixels as P
from trackweave.operators import rules
from trackweave.operators.sampling import hash_order
from trackweave.sources.shared import short_batches

#: Version of the controls that later modules take, their kinds, and the kinds that are background.
VERSION = "Controls v0.2 clean masked"
KINDS = ("near_background", "far_background", "hud_artifact", "dark_region", "bright_region", "compression_noise", "random_background")
BACKGROUND_KINDS = tuple(k for k in KINDS if k != "hud_artifact")
#: Share of masked pixels from which a background control leaks overlays; distance of the near one in object sizes. Fixed values.
LEAK, NEAR = 0.08, 1.2
#: Steps of half a box, and places of the frame in halves of what is left beside the box.
STEPS = [(dx, dy) for dy in (-2, -1, 0, 1, 2) for dx in (-3, -2, -1, 1, 2, 3)]
ANCHORS = [(0, 0), (2, 0), (0, 2), (2, 2), (1, 0), (1, 2), (0, 1), (2, 1), (1, 1)]


def control_places(x: Column, y: Column, w: Column, h: Column, width: int | Column, height: int | Column) -> Column:
    """Boxes of the object's size around it and at the frame's anchors, moved into the frame: array of places, each once, in order.

    A place is one number: its row times the frame's width, and its column. Nothing here is a function of array elements, so Spark compiles it whole
    and works out rows and columns once, as long as the array is a column of its own before such functions read it.
    """
    width, height = F.lit(width), F.lit(height)
    right, down = F.greatest(F.lit(0), width - w).cast("long"), F.greatest(F.lit(0), height - h).cast("long")
    half = lambda c: F.greatest(F.lit(1), F.shiftright(c.cast("int"), 1))
    along = lambda at, size, most, k: F.greatest(F.lit(0), F.least(most, (at + k * half(size)).cast("long")))
    xs, ys = ({k: along(*own, k) for k in dict.fromkeys(step[i] for step in STEPS)} for i, own in enumerate(((x, w, right), (y, h, down))))
    near = [ys[dy] * width + xs[dx] for dx, dy in STEPS]
    far = [F.shiftright(down * j, 1) * width + F.shiftright(right * i, 1) for i, j in ANCHORS]
    return F.array_distinct(F.array(*near, *far))


def control_grid(x: Column, y: Column, w: Column, h: Column, width: int | Column, height: int | Column) -> Column:
    """:func:`control_places` as array of struct(x, y)."""
    width = F.lit(width)
    return F.transform(control_places(x, y, w, h, width, height), lambda p: F.struct((p % width).cast("int").alias("x"), F.floor(p / width).cast("int").alias("y")))


def high_share(stack: np.ndarray) -> np.ndarray:
    """Of each raster at 64 x 64, the share of log magnitude beyond 0.35 of the largest radius."""
    mag = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(P.half_up(P.resized(stack, 64, 64)) / 255), axes=(1, 2))))
    yy, xx = np.indices((64, 64)) - 31.5
    radius = np.hypot(yy, xx)
    return mag[:, radius > 0.35 * radius.max()].sum(axis=1) / (mag.sum(axis=(1, 2)) + 1e-9)


MEASURED = ["artifact_ratio", "black", "cyan", "texture", "luminance", "edges", "hf"]


def control_candidates(frames: DataFrame) -> DataFrame:
    """A row for each box of the grid of each frame, measured: frames (case_id, frame, height, width, blue, green, red, x, y, w, h with the object's box).

    Columns: case_id, frame, ord (the box's number in the grid), x, y, w, h, overlap, artifact_ratio, black, cyan, edge_score, texture, luminance,
    edges, hf, distance, near (the wanted distance), draw (its turn in a seeded order), reasons, object_luminance, object_hf.
    """
    grid = control_grid(*[F.col(c) for c in "xywh"], F.col("width"), F.col("height"))
    planes = ["blue", "green", "red"]
    short_batches(frames.sparkSession)
    rows = frames.withColumn("g", grid).select("case_id", "frame", "height", "width", *planes, *"xywh", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                own = [np.asarray(p, np.int64).reshape(1, r.height, r.width) for p in (r.blue, r.green, r.red)]
                luma, (hue, saturation, value), mask = P.gray(*own)[0], [c[0] for c in P.hsv(*own)], P.artifact_parts(*own)["mask"][0]
                cyan = (hue >= P.CYAN_HUES[0]) & (hue <= P.CYAN_HUES[1]) & (saturation > P.CYAN_LEAST) & (value > P.CYAN_LEAST)
                crop = lambda v: np.stack([v[y : y + r.h, x : x + r.w] for x, y in zip([*r.gx, r.x], [*r.gy, r.y])])  # noqa: B023, E731
                grays = crop(luma)
                mean = lambda v: v.mean(axis=(1, 2))
                found = [mean(crop(mask)), mean(grays < P.BLACK), mean(crop(cyan)), grays.std(axis=(1, 2)), mean(grays), mean(P.canny(grays, 50, 140)), high_share(grays)]
                out.append((r.case_id, r.frame, r.height, r.width, r.x, r.y, r.w, r.h, r.gx, r.gy, *[v[:-1] for v in found], found[4][-1], found[6][-1]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    schema = "case_id long, frame long, height int, width int, ox int, oy int, w int, h int, x array<int>, y array<int>, " + ", ".join(f"{c} array<double>" for c in MEASURED) + ", object_luminance double, object_hf double"
    lists = ["x", "y", *MEASURED]
    one = rows.mapInPandas(measure, schema).select("case_id", "frame", "height", "width", "ox", "oy", "w", "h", "object_luminance", "object_hf", F.posexplode(F.arrays_zip(*lists)).alias("ord", "c"))
    one = one.select("*", *[F.col(f"c.{c}").alias(c) for c in lists]).drop("c")
    box, thing = tuple(F.col(c) for c in "xywh"), (F.col("ox"), F.col("oy"), F.col("w"), F.col("h"))
    beside = F.least("x", "y", F.col("width") - F.col("x") - F.col("w"), F.col("height") - F.col("y") - F.col("h"))
    one = one.withColumns({
        "overlap": G.overlap_of_smaller(box, thing), "edge_score": N.clip(beside / F.greatest(F.lit(1.0), F.least("w", "h") * 0.5)),
        "distance": F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")), "near": F.greatest("w", "h") * NEAR, "draw": hash_order(42, "case_id", "frame", "ord"),
    })
    return one.withColumn("reasons", rules.candidate_reasons(*[F.col(c) for c in ("overlap", "artifact_ratio", "black", "cyan", "edge_score")]))


def control_frames(candidates: DataFrame) -> DataFrame:
    """One row a frame for :func:`controls_summary`, from measured candidates: their picks, and what the record asks of these."""
    key = ["case_id", "frame"]
    row = F.struct("ord", *MEASURED)
    whole = [F.max("object_luminance").alias("object_luminance"), F.max("object_hf").alias("object_hf"), F.count("*").alias("n")]
    picks = rules.pick_controls_of(candidates.repartition(*key).withColumn("ord", row), F.size("reasons") == 0, F.col("near"), key, whole)
    return record_inputs(picks, {k: F.col(k) for k in KINDS})


def record_inputs(frames: DataFrame, picks: dict[str, Column]) -> DataFrame:
    """Adds what the record asks of a frame's picks, structs with luminance, hf and artifact_ratio; ``frames`` has n (candidates) and n_valid."""
    of = lambda k, c: picks[k][c]
    average = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(values), F.lit(0))
    some = lambda kinds, c: F.array_compact(F.array(*[of(k, c) for k in kinds]))
    there = {k: picks[k].isNotNull() for k in KINDS}
    hf = ("near_background", "far_background", "compression_noise")
    return frames.withColumns({
        "near_luminance": of("near_background", "luminance"), "far_luminance": of("far_background", "luminance"), "hud_luminance": of("hud_artifact", "luminance"), "compression_luminance": of("compression_noise", "luminance"),
        "background_hf": average(some(hf, "hf")), "made": F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*there.values())), "artifact_mean": average(some(BACKGROUND_KINDS, "artifact_ratio")),
        "leaks": F.size(F.filter(some(BACKGROUND_KINDS, "artifact_ratio"), lambda v: v > LEAK)), "fallbacks": sum((F.when(t, 0).otherwise(1) for t in there.values()), F.lit(0)),
        "clean_near": there["near_background"], "clean_far": there["far_background"], "clean_compression": there["compression_noise"], "accepted": F.coalesce("n_valid", F.lit(0)),
        "rejected": F.col("n") - F.coalesce("n_valid", F.lit(0)), "object_flow": F.lit(None).cast("double"), "background_flow": F.lit(None).cast("double"),
    })


def controls_summary(frames: DataFrame) -> DataFrame:
    """The controls record of each case, from one row a frame.

    Columns: case_id; object_luminance, near_, far_, hud_ and compression_luminance, object_hf, background_hf, object_flow,
    background_flow (null where there is none); clean_near, clean_far, clean_compression (boolean); made (map of kind to boolean);
    fallbacks, leaks (counts); artifact_mean (of the background controls; a frame without any counts as 1); accepted, rejected (candidates).
    """
    mean = lambda c: F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0))
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    g = frames.groupBy("case_id").agg(
        F.count("*").alias("valid_frames"), *[mean(c).alias(c) for c in ("object_luminance", "near_luminance", "far_luminance", "hud_luminance", "compression_luminance", "object_hf", "background_hf", "object_flow", "background_flow")],
        *[share(f"clean_{c}").alias(f"clean_{c}") for c in ("near", "far", "compression")], *[F.count_if(F.element_at("made", k)).alias(k) for k in KINDS],
        F.sum("fallbacks").alias("fallbacks"), F.sum("leaks").alias("leaks"), F.avg(F.coalesce("artifact_mean", F.lit(1.0))).alias("artifact_rate"),
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"),
    )
    near, far = F.col("near_luminance"), F.col("far_luminance")
    g = g.withColumn("background_luminance", F.when((near != 0) | (far != 0), (near + far) / 2).otherwise(0.0))
    like = lambda a, b: N.similarity(F.col(a), F.col(b))
    missing = F.array_compact(F.array(*[F.when(F.col(k) == 0, F.lit(k)) for k in KINDS]))
    g = g.withColumns({
        "missing": missing, "background_similarity": like("object_luminance", "background_luminance"), "hud_similarity": F.when(F.col("hud_luminance") != 0, like("object_luminance", "hud_luminance")).otherwise(0.0),
        "compression_similarity": F.when(F.col("compression_luminance") != 0, (like("object_luminance", "compression_luminance") + like("object_hf", "background_hf")) / 2).otherwise(0.0),
        "fallback_rate": F.col("fallbacks") / F.greatest(F.lit(1), F.col("valid_frames") * len(KINDS)), "leakage_rate": F.col("leaks") / F.greatest(F.lit(1), F.col("valid_frames") * len(BACKGROUND_KINDS)),
        "delta_luminance": F.col("object_luminance") - F.col("background_luminance"), "delta_hf": F.col("object_hf") - F.col("background_hf"), "delta_flow": F.col("object_flow") - F.col("background_flow"),
    })
    complete = 1 - F.size("missing") / F.lit(float(len(KINDS)))
    clean = F.greatest(F.lit(0.0), 1 - F.col("artifact_rate") * 2.5 - F.col("leakage_rate") * 2 - F.col("fallback_rate"))
    keys = (F.col("clean_near") + F.col("clean_far") + F.col("clean_compression")) / 3
    return g.withColumn("validity", F.greatest(F.lit(0.0), F.least(F.lit(0.98), complete * clean * keys))).withColumn("controls_version", F.lit(VERSION))


def controls_pass(least: float = 0.45) -> Column:
    """Whether a case's controls are of the wanted version and valid enough."""
    return F.coalesce((F.col("controls_version") == VERSION) & (F.col("validity") >= least), F.lit(False))


def controls_gate(rows: DataFrame, controls: DataFrame, least: float = 0.45) -> DataFrame:
    """Rows of cases whose controls are of the wanted version and valid enough."""
    passing = controls.where(controls_pass(least))
    return rows.join(passing.select("case_id").distinct(), "case_id", "left_semi")
