"""Frames of any size as tables of tiles: neighbourhoods by sent margins, percentiles by counts, components joined over tile borders.

A tile is a row (case_id, frame, height, width, ty, tx, y0, x0, th, tw, px): its place among the tiles, its corner, its size, its values row by row.
No frame is ever one row: what a neighbourhood needs of the next tiles is a margin, and what a component needs of them is its border pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import geometry as G

from trackweave.sources.shared import Kept, short_batches

from . import pixels as P
from .graph import least_reachable

PLACE = ["case_id", "frame", "height", "width", "ty", "tx", "y0", "x0", "th", "tw"]
TILE = "case_id long, frame long, height int, width int, ty int, tx int, y0 int, x0 int, th int, tw int, px array<int>"


def cut(px: str, width: Column, top: Column, rows: Column, left: Column, columns: Column) -> Column:
    """A rectangle out of values that lie row by row."""
    return F.flatten(F.transform(F.sequence(top, top + rows - 1), lambda y: F.slice(px, y * width + left + 1, columns)))


def tiled(grays: DataFrame, size: int) -> DataFrame:
    """The tiles, ``size`` pixels high and wide but for the last, of (case_id, frame, height, width, gray)."""
    count = lambda n: F.sequence(F.lit(0), F.expr(f"({n} - 1) div {size}").cast("int"))
    rows = grays.select("case_id", "frame", "height", "width", "gray", F.explode(count("height")).alias("ty")).select("*", F.explode(count("width")).alias("tx"))
    rows = rows.withColumns({"y0": F.col("ty") * size, "x0": F.col("tx") * size})
    rows = rows.withColumns({"th": F.least(F.lit(size), F.col("height") - F.col("y0")), "tw": F.least(F.lit(size), F.col("width") - F.col("x0"))})
    return rows.select(*PLACE, cut("gray", F.col("width"), F.col("y0"), F.col("th"), F.col("x0"), F.col("tw")).alias("px"))


def neighbourhood(tiles: DataFrame, size: int, margin: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles of what ``kernel`` makes of their values, where a pixel's result hangs on no pixel further than ``margin`` (at most ``size``).

    Every tile sends its eight neighbours the margin they need; a tile and up to eight margins then meet in one row. The kernel takes the
    rectangle that these make, (1, h, w), which ends where the frame ends, so it treats the frame's edges as it would in the whole.
    """
    if margin > size:
        raise ValueError("a margin is wider than a tile")
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    sent = tiles.select(*PLACE, "px", step.alias("d")).select(*PLACE, "px", "d.dy", "d.dx")
    last = lambda n: F.expr(f"({n} - 1) div {size}")
    sent = sent.where((F.col("ty") + F.col("dy")).between(0, last("height")) & (F.col("tx") + F.col("dx")).between(0, last("width")))
    taken = lambda d, n: F.when(F.col(d) == 0, F.col(n)).otherwise(F.least(F.lit(margin), F.col(n)))
    first = lambda d, n: F.when(F.col(d) == 1, F.col(n) - taken(d, n)).otherwise(0)
    rows, columns = taken("dy", "th"), taken("dx", "tw")
    part = F.struct((F.col("y0") + first("dy", "th")).alias("y"), (F.col("x0") + first("dx", "tw")).alias("x"), rows.alias("h"), columns.alias("w"), cut("px", F.col("tw"), first("dy", "th"), rows, first("dx", "tw"), columns).alias("px"))
    sent = sent.where((rows > 0) & (columns > 0)).select("case_id", "frame", "height", "width", (F.col("ty") + F.col("dy")).alias("ty"), (F.col("tx") + F.col("dx")).alias("tx"), part.alias("part"))
    met = sent.groupBy("case_id", "frame", "height", "width", "ty", "tx").agg(F.collect_list("part").alias("parts"))
    met = met.select("case_id", "frame", "height", "width", "ty", "tx", *[F.col(f"parts.{n}").alias(n) for n in ("y", "x", "h", "w")], F.flatten("parts.px").alias("px"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                ys, xs, hs, ws = (np.asarray(v, np.int64) for v in (r.y, r.x, r.h, r.w))
                top, left = ys.min(), xs.min()
                whole, at = np.zeros(((ys + hs).max() - top, (xs + ws).max() - left), np.int64), 0
                for y, x, h, w in zip(ys - top, xs - left, hs, ws):
                    whole[y : y + h, x : x + w] = r.px[at : at + h * w].reshape(h, w)
                    at += h * w
                y0, x0 = r.ty * size, r.tx * size
                th, tw = min(size, r.height - y0), min(size, r.width - x0)
                made = kernel(whole[None])[0, y0 - top : y0 - top + th, x0 - left : x0 - left + tw]
                out.append((r.case_id, r.frame, r.height, r.width, r.ty, r.tx, y0, x0, th, tw, made.astype(np.int64).ravel()))
            yield pd.DataFrame(out, columns=[*PLACE, "px"])

    short_batches(met.sparkSession)
    return met.mapInPandas(run, TILE)


def percentiles(tiles: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(case_id, frame, one column a name of ``shares``): interpolated percentiles of whole frames, from the counts of each value."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (case, frame), own in b.groupby(["case_id", "frame"], sort=False):
                value, n = np.unique(np.concatenate(own["px"].to_list()), return_counts=True)
                yield pd.DataFrame({"case_id": case, "frame": frame, "value": value, "n": n})

    short_batches(tiles.sparkSession)
    counts = tiles.select("case_id", "frame", "px").mapInPandas(count, "case_id long, frame long, value long, n long").groupBy("case_id", "frame", "value").agg(F.sum("n").alias("n"))
    by_frame = Window.partitionBy("case_id", "frame")
    counts = counts.withColumns({"upto": F.sum("n").over(by_frame.orderBy("value")), "total": F.sum("n").over(by_frame)})

    def at(share: float) -> Column:
        place = (F.col("total") - 1) * (share / 100)
        low, high = (F.min(F.when(F.col("upto") > f(place), F.col("value"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(place - F.floor(place))

    return counts.groupBy("case_id", "frame").agg(*[at(s).alias(n) for n, s in shares.items()])


def components(masks: DataFrame, size: int, source: str | None = None) -> DataFrame:
    """(case_id, frame, root, x, y, w, h, area): the 8-connected components of mask tiles; root is the place, row by row, of a component's first pixel.

    With ``source``, a text column that tells several masks of a frame apart, after frame.

    Each tile labels its own pixels. Labels that touch over a tile border are linked by a join on the places of border pixels, and linked
    labels sink to the least of them; boxes and areas are aggregated by that.
    """

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                found = P.labels(np.asarray(r.px).reshape(1, r.th, r.tw) != 0)
                t = P.component_table(found)
                if not len(t["label"]):
                    continue
                named = lambda label: (label // r.tw + r.y0) * r.width + label % r.tw + r.x0  # noqa: B023, E731
                rows = [pd.DataFrame({"node": named(t["label"]), "place": -1, "x": t["x"] + r.x0, "y": t["y"] + r.y0, "right": t["x"] + t["w"] + r.x0, "bottom": t["y"] + t["h"] + r.y0, "area": t["area"]})]
                y, x = np.nonzero(found[0] >= 0)
                ring = (y == 0) | (x == 0) | (y == r.th - 1) | (x == r.tw - 1)
                y, x = y[ring], x[ring]
                rows.append(pd.DataFrame({"node": named(found[0, y, x]), "place": (y + r.y0) * r.width + x + r.x0, "x": x + r.x0, "y": y + r.y0, "right": 0, "bottom": 0, "area": 0}))
                yield pd.concat(rows).assign(case_id=r.case_id, frame=r.frame, width=r.width, source=r.source)[["case_id", "frame", "source", "width", "node", "place", "x", "y", "right", "bottom", "area"]]

    schema = "case_id long, frame long, source string, width int, node long, place long, x long, y long, right long, bottom long, area long"
    short_batches(masks.sparkSession)
    kept = Kept(masks.select(*PLACE, "px", (F.col(source) if source else F.lit("")).alias("source")).mapInPandas(own, schema), "tile-labels")
    found, frame = kept.df, ["case_id", "frame", "source"]
    border = found.where("place >= 0")
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    out = border.select(*frame, "width", "x", "y", F.col("node").alias("a"), steps.alias("d")).select("*", "d.dy", "d.dx")
    ahead = lambda v, d: F.floor((F.col(v) + F.col(d)) / size) != F.floor(F.col(v) / size)
    out = out.where((ahead("x", "dx") | ahead("y", "dy")) & (F.col("x") + F.col("dx")).between(0, F.col("width") - 1))
    out = out.select(*frame, "a", ((F.col("y") + F.col("dy")) * F.col("width") + F.col("x") + F.col("dx")).alias("place"))
    links = out.join(border.select(*frame, "place", F.col("node").alias("b")), [*frame, "place"]).select(*frame, "a", "b").distinct()
    roots = least_reachable(links, frame)
    parts = found.where("place < 0").join(roots, [*frame, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    least, most = {c: F.min(c).alias(c) for c in "xy"}, {c: F.max(c).alias(c) for c in ("right", "bottom")}
    boxes = parts.groupBy(*frame, "root").agg(*least.values(), *most.values(), F.sum("area").alias("area"))
    return boxes.select("case_id", "frame", *([F.col("source").alias(source)] if source else []), "root", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "area")


def box_statistics(boxes: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` (case_id, frame, *keys, x, y, w, h) with n, total and squares of the values inside: partial sums of each tile a box meets."""
    t = tiles.select("case_id", "frame", "y0", "x0", "th", "tw", "px")
    meet = (F.col("x") < F.col("x0") + F.col("tw")) & (F.col("x0") < F.col("x") + F.col("w")) & (F.col("y") < F.col("y0") + F.col("th")) & (F.col("y0") < F.col("y") + F.col("h"))
    rows = boxes.join(t, ["case_id", "frame"]).where(meet)
    top, left = F.greatest(F.col("y") - F.col("y0"), F.lit(0)).cast("int"), F.greatest(F.col("x") - F.col("x0"), F.lit(0)).cast("int")
    bottom, right = F.least(F.col("y") + F.col("h") - F.col("y0"), "th").cast("int"), F.least(F.col("x") + F.col("w") - F.col("x0"), "tw").cast("int")
    rows = rows.select("case_id", "frame", *keys, cut("px", F.col("tw"), top, bottom - top, left, right - left).alias("v"))
    plus = lambda f: F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + f(x.cast("long")))
    sums = rows.select("case_id", "frame", *keys, F.size("v").alias("n"), plus(lambda x: x).alias("total"), plus(lambda x: x * x).alias("squares"))
    return sums.groupBy("case_id", "frame", *keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


#: Of candidate boxes: percentiles and least thresholds of change and dark contrast, the darkest share and its limit, smoothing of the
#: ground, limits of dark long boxes, weights of the order, and how many stay of a frame. Fixed values.
CHANGE, CHANGE_FLOOR, DARKEST, DARK_LIMIT, DARK_MORE, GROUND = 96, 8, 7, 115, 8, 31
DARK_FORM, DARK_SHARES, DARK_WEIGHT, MOST = 2.0, (0.00001, 0.025), 2.8, 24


def candidate_boxes(grays: DataFrame, size: int = 64) -> DataFrame:
    """(case_id, frame, rank, source, x, y, w, h, pixels, contrast, brightness, aspect_ratio, dark_score) of gray frames, at most ``MOST`` a frame.

    ``motion``: pixels that changed since the frame before by more than a percentile of the frame's changes, opened and closed. ``dark_elongated``:
    dark pixels that stand out of the smoothed ground, opened and closed, in long boxes. A background model learned over frames is not part of this.
    """
    key = ["case_id", "frame"]
    tiles = Kept(tiled(grays, size), "tiles").df
    soft = Kept(neighbourhood(tiles, size, 2, lambda x: P.half_up(P.blurred(x, 5))), "tiles-soft").df
    before = F.lag("px").over(Window.partitionBy("case_id", "ty", "tx").orderBy("frame"))
    change = soft.withColumn("before", before).select(*PLACE, F.coalesce(F.zip_with("px", "before", lambda a, b: F.abs(a - b)), F.transform("px", lambda _: F.lit(0))).alias("px"))
    change = Kept(change, "tiles-change").df
    limit = percentiles(change, {"p": CHANGE}).select(*key, F.greatest(F.lit(CHANGE_FLOOR), F.floor("p")).alias("limit"))
    over = change.join(limit, key).select(*PLACE, F.transform("px", lambda v: (v > F.col("limit")).cast("int")).alias("px"))
    moved = neighbourhood(over, size, 8, lambda x: P.closed(P.opened(x, 3, 3), 7, 7))

    contrast = Kept(neighbourhood(soft, size, GROUND // 2, lambda x: np.maximum(P.half_up(P.blurred(x, GROUND)) - x, 0)), "tiles-contrast").df
    deep = percentiles(contrast, {"p": CHANGE}).select(*key, F.greatest(F.lit(CHANGE_FLOOR), F.floor("p")).alias("deep"))
    dark = percentiles(soft, {"p": DARKEST}).select(*key, F.least(F.lit(DARK_LIMIT), F.floor("p") + DARK_MORE).alias("dark"))
    both = soft.withColumnRenamed("px", "soft").join(contrast.select(*key, "ty", "tx", "px"), [*key, "ty", "tx"]).join(deep, key).join(dark, key)
    both = both.select(*PLACE, F.zip_with("soft", "px", lambda s, c: ((s <= F.col("dark")) & (c > F.col("deep"))).cast("int")).alias("px"))
    dark_mask = neighbourhood(both, size, 6, lambda x: P.closed(P.opened(x, 3, 3), 9, 3))

    found = Kept(components(moved.withColumn("source", F.lit("motion")).union(dark_mask.withColumn("source", F.lit("dark_elongated"))), size, "source"), "tiles-boxes").df
    sizes = tiles.where("ty = 0 and tx = 0").select(*key, "height", "width")
    keys = ["source", "root"]
    inner = box_statistics(found, tiles, keys)
    pad = F.greatest(F.lit(8), F.floor(F.greatest("w", "h") * 0.7)).cast("long")
    x0, y0 = F.greatest(F.col("x") - pad, F.lit(0)), F.greatest(F.col("y") - pad, F.lit(0))
    around = found.join(sizes, key).select(*key, *keys, x0.alias("x"), y0.alias("y"), (F.least(F.col("x") + F.col("w") + pad, "width") - x0).alias("w"), (F.least(F.col("y") + F.col("h") + pad, "height") - y0).alias("h"))
    outer = box_statistics(around, tiles, keys).select(*key, *keys, (F.col("total") / F.col("n")).alias("local"))
    rows = found.join(inner, [*key, *keys]).join(outer, [*key, *keys]).join(sizes, key)
    mean = F.col("total") / F.col("n")
    rows = rows.withColumns({"brightness": mean, "contrast": F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))), "aspect_ratio": F.greatest("w", "h") / F.least("w", "h"), "dark_score": F.greatest(F.lit(0.0), F.col("local") - mean), "share": F.col("w") * F.col("h") / (F.col("height") * F.col("width"))})
    long_dark = (F.col("aspect_ratio") >= DARK_FORM) & F.col("share").between(*DARK_SHARES)
    rows = rows.where(((F.col("source") == "motion") | long_dark) & ~G.edge_artifact(tuple(F.col(c) for c in "xywh"), F.col("width"), F.col("height")))
    score = F.when(F.col("source") == "dark_elongated", DARK_WEIGHT).otherwise(1.0) * (1 + F.least(F.lit(2.5), F.col("dark_score") / 18)) * (1 + F.least(F.lit(2.0), F.col("aspect_ratio") / 4)) * (F.col("contrast") + 3) * F.sqrt(F.greatest(F.col("w") * F.col("h"), F.lit(1)))
    order = Window.partitionBy(*key).orderBy(F.desc(F.round(score, 6)), "source", "root")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST).select(*key, "rank", "source", "x", "y", "w", "h", F.col("area").alias("pixels"), "contrast", "brightness", "aspect_ratio", "dark_score")
