"""Pixel kernels that array functions cannot say: numpy over Arrow batches of crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _rasters(v: pd.Series, side: int) -> np.ndarray:
    return np.stack(v.to_numpy()).reshape(len(v), side, side) if len(v) else np.zeros((0, side, side))


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    out = mask.copy()
    h, w = mask.shape[-2:]
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            out[..., max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] |= mask[..., max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def label_components(mask: np.ndarray) -> list[np.ndarray]:
    """Pixel indices of each 8-connected component, in reading order of their first pixels."""
    h, w = mask.shape
    left, out = mask.copy(), []
    for start in np.flatnonzero(mask.ravel()):
        if not left.flat[start]:
            continue
        todo, own = [int(start)], []
        left.flat[start] = False
        while todo:
            at = todo.pop()
            own.append(at)
            y, x = divmod(at, w)
            for ny in range(max(0, y - 1), min(h, y + 2)):
                for nx in range(max(0, x - 1), min(w, x + 2)):
                    if left[ny, nx]:
                        left[ny, nx] = False
                        todo.append(ny * w + nx)
        out.append(np.array(sorted(own)))
    return out


def component_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of each component."""
    out = []
    for own in label_components(mask):
        y, x = np.divmod(own, mask.shape[1])
        out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, len(own)))
    return out


def artifact_mask(image: np.ndarray, dark: float, white: float, least_area: int, border: int, radius: int) -> np.ndarray:
    """Large filled dark regions, white pixels and the border, grown by ``radius``; ``image`` is one raster."""
    black = image < dark
    raw = np.zeros(image.shape, bool)
    for own in label_components(black):
        y, x = np.divmod(own, image.shape[1])
        if len(own) >= least_area and len(own) / ((np.ptp(x) + 1) * (np.ptp(y) + 1)) > 0.55:
            raw.flat[own] = True
    raw |= image > white
    if border:
        raw[:border] = raw[-border:] = raw[:, :border] = raw[:, -border:] = True
    return dilate(raw, radius)


def spatial_spectrum(v: Column, side: int) -> Column:
    """struct(energy, high): mean log magnitude of the two-dimensional transform, and the share beyond 0.35 of the largest radius."""
    yy, xx = np.indices((side, side))
    radius = np.hypot(yy - (side - 1) / 2, xx - (side - 1) / 2)
    far = radius > 0.35 * radius.max()

    @F.pandas_udf("energy double, high double")
    def run(values: pd.Series) -> pd.DataFrame:
        mag = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(_rasters(values, side)), axes=(1, 2))))
        return pd.DataFrame({"energy": mag.mean(axis=(1, 2)), "high": mag[:, far].sum(axis=1) / (mag.sum(axis=(1, 2)) + 1e-9)})

    return run(v)


def artifact_ratio(v: Column, side: int, dark: float, white: float, least_area: int, border: int = 0, radius: int = 0) -> Column:
    """struct(ratio, components): share of masked pixels and number of bright components outside the mask."""

    @F.pandas_udf("ratio double, components int")
    def run(values: pd.Series) -> pd.DataFrame:
        masks = [artifact_mask(x, dark, white, least_area, border, radius) for x in _rasters(values, side)]
        bright = [len(component_boxes((x > x.mean()) & ~m)) for x, m in zip(_rasters(values, side), masks)]
        return pd.DataFrame({"ratio": [m.mean() for m in masks], "components": pd.Series(bright, dtype="int32")})

    return run(v)


def saliency_core(image: np.ndarray, previous: tuple | None = None) -> tuple[int, int, int, int] | None:
    """Box of the component that stands out most from the median: mean deviation less its distance to the previous core; None if none does."""
    deviation = np.abs(image - np.median(image))
    mask = deviation > max(np.percentile(deviation, 97.5), deviation.mean() + deviation.std())
    best = None
    for own in label_components(mask):
        y, x = np.divmod(own, image.shape[1])
        score = deviation.flat[own].mean()
        if previous:
            score -= 0.01 * np.hypot(x.mean() - previous[0] - previous[2] / 2, y.mean() - previous[1] - previous[3] / 2)
        if best is None or score > best[0]:
            best = (score, (int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
    return best[1] if best else None


def motion_region(images: np.ndarray, share: float = 0.96, pad: float = 0.35) -> tuple[int, int, int, int] | None:
    """Padded box of the largest component of the accumulated frame differences at or over a percentile."""
    if len(images) < 2:
        return None
    change = np.abs(np.diff(images, axis=0)).sum(axis=0)
    boxes = component_boxes((change >= np.quantile(change, share)) & (change > 0))
    if not boxes:
        return None
    x, y, w, h, _ = max(boxes, key=lambda b: b[4])
    px, py = int(w * pad), int(h * pad)
    x0, y0 = max(0, x - px), max(0, y - py)
    return x0, y0, min(images.shape[2], x + w + px) - x0, min(images.shape[1], y + h + py) - y0
