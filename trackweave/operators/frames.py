"""Operators over tables of colour frames: (case_id, frame, height, width, blue, green, red), planes as arrays of 0 to 255 row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.sources.shared import short_batches

from . import pixels as P
from .tracking import fold_sorted

PLANES = ("blue", "green", "red")


def with_kernel(frames: DataFrame, columns: str, kernel: Callable[[np.ndarray, ...], dict], planes: tuple[str, ...] = PLANES, keep: tuple[str, ...] = ("case_id", "frame")) -> DataFrame:
    """``frames``' columns ``keep`` and those of ``columns`` that ``kernel`` makes of the planes, as stacks (n, height, width) of one size.

    Rows of a batch that have the same size are taken together; frames need not be of one size. Nothing is shuffled.
    """
    short_batches(frames.sparkSession)
    types = dict(frames.select(*keep).dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keep] + [columns])
    made = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (h, w), own in b.groupby(["height", "width"], sort=False):
                stacks = [np.stack(own[p].to_numpy()).reshape(len(own), h, w).astype(np.int64) for p in planes]
                found = kernel(*stacks)
                yield own[list(keep)].assign(**{c: list(found[c]) if np.ndim(found[c]) > 1 else found[c] for c in made})[[*keep, *made]]

    return frames.select(*dict.fromkeys((*keep, "height", "width", *planes))).mapInPandas(run, schema)


def colour_statistics(frames: DataFrame) -> DataFrame:
    """Means and deviation of gray, and means of every colour and of hue, saturation and value, a row a frame."""

    def kernel(b, g, r):
        luma, (hue, saturation, value) = P.gray(b, g, r), P.hsv(b, g, r)
        mean = lambda x: x.mean(axis=(1, 2))
        named = {"luminance": luma, "red": r, "green": g, "blue": b, "hue": hue, "saturation": saturation, "value": value}
        return {f"{k}_mean": mean(v) for k, v in named.items()} | {"luminance_std": luma.std(axis=(1, 2))}

    names = ["luminance_mean", "luminance_std", "red_mean", "green_mean", "blue_mean", "hue_mean", "saturation_mean", "value_mean"]
    return with_kernel(frames, ", ".join(f"{n} double" for n in names), kernel)


def gray_frames(frames: DataFrame, height: int | None = None, width: int | None = None, how: str = "area") -> DataFrame:
    """(case_id, frame, height, width, gray), resized to (height, width) and rounded half up where these are given."""

    def kernel(b, g, r):
        luma = P.gray(b, g, r)
        if height:
            luma = P.half_up(P.resized(luma, height, width, how))
        return {"gray": luma.reshape(len(luma), -1)}

    made = with_kernel(frames, "gray array<int>", kernel, keep=("case_id", "frame", "height", "width"))
    return made.withColumns({"height": F.lit(height), "width": F.lit(width)}) if height else made


def edge_density(frames: DataFrame, low: float = 50, high: float = 140) -> DataFrame:
    """(case_id, frame, edges): the share of pixels on an edge."""
    return with_kernel(frames, "edges double", lambda b, g, r: {"edges": P.canny(P.gray(b, g, r), low, high).mean(axis=(1, 2))})


def artifact_shares(frames: DataFrame) -> DataFrame:
    """(case_id, frame, black, cyan, white, edges, border, mask): shares of pixels of each part of the artifact mask."""
    names = ["black", "cyan", "white", "edges", "border", "mask"]
    return with_kernel(frames, ", ".join(f"{n} double" for n in names), lambda *s: {k: v.mean(axis=(1, 2)) for k, v in P.artifact_parts(*s).items()})


def artifact_masks(frames: DataFrame) -> DataFrame:
    """(case_id, frame, height, width, mask): the whole mask, row by row."""
    made = with_kernel(frames, "mask array<boolean>", lambda *s: {"mask": P.artifact_parts(*s)["mask"].reshape(len(s[0]), -1)}, keep=("case_id", "frame", "height", "width"))
    return made.select("case_id", "frame", "height", "width", "mask")


#: The artifact mask of a crop: limits of cyan and of dark overlays. Fixed values.
CORE_CYAN, CORE_DARK, CORE_SHARE, CORE_EXTENT = 55, 8, 0.015, 0.35
#: Of a core: areas it may have, its longest form, weights of distance and change of size, and its confidence. Fixed values.
CORE_AREAS, CORE_EDGE_SHARE, CORE_FORM, CORE_AWAY, CORE_CHANGE, CORE_SURE, CORE_BLEND = (6, 0.30), 0.03, 18, 0.45, 0.25, 12, 0.35
CANDIDATE = 8  # numbers a candidate has: score of its own, centre, area, box


def overlay_mask(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Cyan drawing and dark blocks that touch the edge or are long, both grown by two pixels."""
    luma, (hue, saturation, value) = P.gray(b, g, r), P.hsv(b, g, r)
    _, h, w = luma.shape
    cyan = (hue >= P.CYAN_HUES[0]) & (hue <= P.CYAN_HUES[1]) & (saturation > CORE_CYAN) & (value > CORE_CYAN)
    found = P.labels(luma < CORE_DARK)
    t = P.component_table(found)
    touching = (t["x"] <= 2) | (t["y"] <= 2) | (t["x"] + t["w"] >= w - 2) | (t["y"] + t["h"] >= h - 2)
    dark = P.keep_components(found, t, (t["area"] > CORE_SHARE * h * w) & (touching | (t["w"] > CORE_EXTENT * w) | (t["h"] > CORE_EXTENT * h)))
    return P.dilate(cyan, 5, 5) | P.dilate(dark, 5, 5)


def _cores(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> dict:
    luma, mask = P.gray(b, g, r), overlay_mask(b, g, r)
    n, h, w = luma.shape
    median = np.array([np.median(x[~m]) if (~m).any() else np.median(x) for x, m in zip(luma, mask)])
    standing = P.blurred(np.where(mask, 0.0, np.abs(luma - median[:, None, None])), 5)
    limit = np.full(n, np.inf)
    for k, x in enumerate(standing):
        some = x[x > 0]
        if some.size:
            limit[k] = max(np.percentile(some, 97.5), some.mean() + some.std())
    found = P.labels(P.closed(standing >= limit[:, None, None], 5, 5))
    t = P.component_table(found)
    edge = (t["x"] <= 1) | (t["y"] <= 1) | (t["x"] + t["w"] >= w - 1) | (t["y"] + t["h"] >= h - 1)
    form = np.maximum(t["w"] / np.maximum(t["h"], 1), t["h"] / np.maximum(t["w"], 1))
    fits = (t["area"] >= CORE_AREAS[0]) & (t["area"] <= CORE_AREAS[1] * h * w) & ~(edge & (t["area"] > CORE_EDGE_SHARE * h * w)) & (form <= CORE_FORM)
    rows: list[list[float]] = [[] for _ in range(n)]
    for k in np.flatnonzero(fits):
        y, x = np.nonzero(found[t["raster"][k]] == t["label"][k])
        score = standing[t["raster"][k]][y, x].mean() * np.sqrt(t["area"][k])
        rows[t["raster"][k]] += [float(v) for v in (score, x.mean(), y.mean(), t["area"][k], t["x"][k], t["y"][k], t["w"][k], t["h"][k])]
    return {"cores": np.array([*map(np.array, rows), None], dtype=object)[:-1], "masked": mask.sum(axis=(1, 2))}


def core_candidates(frames: DataFrame) -> DataFrame:
    """(case_id, frame, height, width, cores, masked): what stands out of each crop, eight numbers a candidate, and pixels under overlays."""
    made = with_kernel(frames, "cores array<double>, masked long", _cores, keep=("case_id", "frame", "height", "width"))
    return made.select("case_id", "frame", "height", "width", "cores", "masked")


CORE = "case_id long, frame long, status string, confidence double, x long, y long, w long, h long, masked long"


def core_step(state: list[float] | None, height: int, width: int, cores: list[float]) -> tuple[list[float] | None, tuple]:
    """(state, (status, confidence, box)) after a crop. The state is the last core's box; it draws the choice among candidates and the box itself."""
    best, picked = None, None
    for k in range(0, len(cores), CANDIDATE):
        score, cx, cy, area = cores[k : k + 4]
        if state is not None:
            x, y, w, h = state
            score -= CORE_AWAY * float(np.hypot(cx - x - w / 2, cy - y - h / 2)) + CORE_CHANGE * abs(area**0.5 - (w * h) ** 0.5)
        if best is None or score > best:
            best, picked = score, cores[k : k + CANDIDATE]
    if picked is None:
        if state is None:
            return None, ("CORE_NOT_FOUND", 0.0, None, None, None, None)
        box, status, confidence = list(state), "LOW_CONFIDENCE", 0.0
    else:
        x, y, w, h = picked[4:]
        side = min(max(8, round(max(w, h) * 1.35), 32), max(width, height))
        box = [max(0, min(width - side, round(x + w / 2 - side / 2))), max(0, min(height - side, round(y + h / 2 - side / 2))), side, side]
        confidence = max(0.0, best) / (picked[3] + 1e-6)
        status = "TRACKING_ACTIVE" if confidence > CORE_SURE else "LOW_CONFIDENCE"
    if state is not None:
        box = [round(p * (1 - CORE_BLEND) + c * CORE_BLEND) for p, c in zip(state, box)]
    x, y = max(0, min(width - 1, int(box[0]))), max(0, min(height - 1, int(box[1])))
    w, h = max(8, min(width - x, int(box[2]))), max(8, min(height - y, int(box[3])))
    return [float(x), float(y), float(w), float(h)], (status, float(confidence), x, y, w, h)


def core_track(frames: DataFrame) -> DataFrame:
    """(case_id, frame, status, confidence, x, y, w, h, masked): the core of each crop, drawn towards the one before it; in order of frame."""

    def fold(own):
        state = None
        for case, frame, height, width, cores, masked in own:
            state, found = core_step(state, height, width, list(cores))
            yield (case, frame, *found, masked)

    return fold_sorted(core_candidates(frames), ["case_id"], ["frame"], CORE, fold)


def strips(grays: DataFrame, rows: int = 16) -> DataFrame:
    """(case_id, strip, frame, height, width, px): every gray frame cut into strips of ``rows`` rows, so that a long case is many groups."""
    cut = F.explode(F.sequence(F.lit(0), F.expr(f"(height - 1) div {rows}").cast("int"))).alias("strip")
    return grays.select("case_id", "frame", "height", "width", "gray", cut).select("case_id", "strip", "frame", "height", "width", F.slice("gray", F.col("strip") * F.col("width") * rows + 1, F.col("width") * rows).alias("px"))


def accumulated_motion(grays: DataFrame, rows: int = 16) -> DataFrame:
    """(case_id, height, width, frames, motion): for each case the sum over its frames of each pixel's change since the frame before.

    A strip's frames meet their predecessors by a window; each Arrow batch adds up what it holds of a strip, and sums of sums follow pixel by pixel
    with partial aggregation. What is put together in one row is one raster a case, whatever its number of frames.
    """
    before = F.lag("px").over(Window.partitionBy("case_id", "strip").orderBy("frame"))
    changed = strips(grays, rows).withColumn("before", before)
    changed = changed.select("case_id", "strip", "height", "width", F.when(F.col("before").isNotNull(), F.zip_with("px", "before", lambda a, b: F.abs(a - b))).alias("px"), F.size("px").alias("size"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for (case, strip, h, w, size), own in b.groupby(["case_id", "strip", "height", "width", "size"], sort=False):
                some = own["px"].dropna()
                out.append((case, strip, h, w, len(own), np.stack(some.to_numpy()).astype(np.int64).sum(axis=0) if len(some) else np.zeros(size, np.int64)))
            yield pd.DataFrame(out, columns=["case_id", "strip", "height", "width", "frames", "px"])

    short_batches(changed.sparkSession)
    sums = changed.mapInPandas(add_up, "case_id long, strip int, height int, width int, frames long, px array<long>")
    counted = sums.groupBy("case_id", "strip", "height", "width").agg(F.sum("frames").alias("frames"))
    pixel = sums.select("case_id", "strip", F.posexplode("px").alias("at", "v")).groupBy("case_id", "strip", "at").agg(F.sum("v").alias("v"))
    whole = pixel.groupBy("case_id", "strip").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("px"))
    whole = whole.join(counted, ["case_id", "strip"]).groupBy("case_id", "height", "width").agg(F.max("frames").alias("frames"), F.array_sort(F.collect_list(F.struct("strip", "px"))).alias("parts"))
    return whole.select("case_id", "height", "width", "frames", F.flatten(F.transform("parts", lambda p: p["px"])).alias("motion"))


#: Of the region of motion: least frames, least threshold, percentile, padding, and shares of the frame of a sure one. Fixed values.
MOTION_FRAMES, MOTION_FLOOR, MOTION_PERCENTILE, MOTION_PAD, MOTION_SHARES = 3, 18, 96, 0.35, (0.0003, 0.35)


def motion_regions(frames: DataFrame, height: int, width: int) -> DataFrame:
    """(case_id, status, confidence, x, y, w, h, area_share, threshold, motion_mean, motion_max) of each case.

    Gray frames are brought to (height, width); changes are added up, smoothed, brought to 0 to 255, cut at a percentile, closed; the box of the
    component of most pixels is padded and brought back to the size of the case's frames.
    """
    sizes = frames.groupBy("case_id").agg(F.max("height").alias("full_h"), F.max("width").alias("full_w"))
    moved = accumulated_motion(gray_frames(frames, height, width)).join(sizes, "case_id")

    def region(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                sums = P.blurred(np.asarray(r.motion, np.float64).reshape(1, r.height, r.width), 9)
                spread = sums.max() - sums.min()
                level = np.floor((sums - sums.min()) * 255 / spread + 1e-6) if spread > 0 else np.zeros(sums.shape)
                limit = max(MOTION_FLOOR, int(np.percentile(level, MOTION_PERCENTILE)))
                t = P.component_table(P.labels(P.closed(level > limit, 7, 7)))
                if r.frames < MOTION_FRAMES or not len(t["area"]):
                    out.append((r.case_id, "manual_review_required", None, 0, 0, 0, 0, None, None, None, None))
                    continue
                k = int(np.lexsort((t["label"], -t["area"]))[0])
                x, y, w, h = (int(t[c][k]) for c in "xywh")
                share, sx, sy = w * h / (r.width * r.height), r.full_w / r.width, r.full_h / r.height
                rx, ry = max(0, int((x - w * MOTION_PAD) * sx)), max(0, int((y - h * MOTION_PAD) * sy))
                rw, rh = min(r.full_w - rx, int(w * (1 + 2 * MOTION_PAD) * sx)), min(r.full_h - ry, int(h * (1 + 2 * MOTION_PAD) * sy))
                sure = MOTION_SHARES[0] <= share <= MOTION_SHARES[1]
                out.append((r.case_id, "proposed" if sure else "manual_review_required", "medium" if sure else "low", rx, ry, rw, rh, share, limit, sums.mean(), sums.max()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REGION.split(", ")])

    short_batches(moved.sparkSession)
    return moved.mapInPandas(region, REGION)


REGION = "case_id long, status string, confidence string, x long, y long, w long, h long, area_share double, threshold double, motion_mean double, motion_max double"


#: Of the brightest region: percentile, deviations above the mean, share of the box and least pixels it is padded by. Fixed values.
BRIGHT_PERCENTILE, BRIGHT_DEVIATIONS, BRIGHT_PAD, BRIGHT_LEAST = 99.5, 2.5, 0.75, 8


def bright_regions(frames: DataFrame) -> DataFrame:
    """(case_id, frame, mode, x, y, w, h): the box of the component of most pixels among the brightest of each smoothed gray frame, padded and cut to the frame.

    A frame without any takes a quarter of its shorter side in the middle, mode ``auto-brightness-fallback``.
    """

    def kernel(b, g, r):
        luma = P.half_up(P.blurred(P.gray(b, g, r), 5))
        n, h, w = luma.shape
        limit = np.maximum(np.percentile(luma, BRIGHT_PERCENTILE, axis=(1, 2)), luma.mean(axis=(1, 2)) + BRIGHT_DEVIATIONS * luma.std(axis=(1, 2)))
        t, side = P.component_table(P.labels(luma >= limit[:, None, None] - 1e-6)), min(w, h) // 4  # whole numbers against interpolated ones
        found = [("auto-brightness-fallback", (w - side) // 2, (h - side) // 2, side, side)] * n
        for k in np.lexsort((-t["label"], t["area"])):  # the largest of a frame comes last, of equals the first
            x, y, own_w, own_h = (int(t[c][k]) for c in "xywh")
            pad = max(BRIGHT_LEAST, int(max(own_w, own_h) * BRIGHT_PAD))
            x0, y0 = max(0, x - pad), max(0, y - pad)
            found[t["raster"][k]] = ("auto-brightness", x0, y0, min(w, x + own_w + pad) - x0, min(h, y + own_h + pad) - y0)
        return dict(zip(("mode", "x", "y", "w", "h"), map(np.array, zip(*found))))

    return with_kernel(frames, "mode string, x int, y int, w int, h int", kernel)
