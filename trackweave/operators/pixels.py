"""Pixel kernels in numpy over stacks of rasters (n, height, width); operators.frames applies them to tables.

Nothing here knows of Spark: a kernel takes the rasters of one Arrow batch that have the same size.
"""

from __future__ import annotations

import numpy as np

#: Weights of blue, green and red in gray, in parts of 2 ** 14, and the rounding half: fixed values of the eight-bit conversion.
GRAY = (1868, 9617, 4899)
#: Small smoothing kernels by size; larger ones follow from their deviation. Fixed values.
SMALL_KERNELS = {3: (1 / 4, 1 / 2, 1 / 4), 5: (1 / 16, 1 / 4, 3 / 8, 1 / 4, 1 / 16), 7: (1 / 32, 7 / 64, 7 / 32, 9 / 32, 7 / 32, 7 / 64, 1 / 32)}
#: sRGB primaries to the reference white D65, rows x, y, z. Fixed values.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])


def gray(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> np.ndarray:
    return (b.astype(np.int64) * GRAY[0] + g.astype(np.int64) * GRAY[1] + r.astype(np.int64) * GRAY[2] + (1 << 13)) >> 14


def hsv(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in half degrees (0 to 179), saturation and value (0 to 255), each rounded half up; gray pixels have hue 0."""
    b, g, r = (x.astype(np.int64) for x in (b, g, r))
    value = np.maximum(np.maximum(b, g), r)
    spread = value - np.minimum(np.minimum(b, g), r)
    turn = np.where(value == r, g - b, np.where(value == g, b - r + 2 * spread, r - g + 4 * spread))
    hue = (60 * turn + spread) // np.maximum(2 * spread, 1)
    saturation = (510 * spread + value) // np.maximum(2 * value, 1)
    return np.where(hue < 0, hue + 180, hue), saturation, value


def lab(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L* (0 to 100), a* and b* of sRGB pixels under D65: the linear piece below each knee, the power above it."""
    rgb = np.stack([r, g, b]).astype(np.float64) / 255
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    xyz = np.tensordot(XYZ, linear, 1) / XYZ.sum(axis=1).reshape(3, *[1] * (linear.ndim - 1))
    f = np.where(xyz > (6 / 29) ** 3, np.cbrt(xyz), xyz * (29 / 6) ** 2 / 3 + 4 / 29)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def _running(x: np.ndarray, size: int, axis: int, pick) -> np.ndarray:
    """``pick`` (maximum or minimum) over ``size`` (odd) neighbours along an axis; what lies outside has no say."""
    out, n = x.copy(), x.shape[axis]
    for d in range(1, min(size // 2, n - 1) + 1):
        lo, hi = [slice(None)] * x.ndim, [slice(None)] * x.ndim
        lo[axis], hi[axis] = slice(0, n - d), slice(d, n)
        out[tuple(lo)] = pick(out[tuple(lo)], x[tuple(hi)])
        out[tuple(hi)] = pick(out[tuple(hi)], x[tuple(lo)])
    return out


def dilate(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Running maximum over a rectangle, one axis after the other."""
    return _running(_running(x, height, -2, np.maximum), width, -1, np.maximum)


def erode(x: np.ndarray, height: int, width: int) -> np.ndarray:
    return _running(_running(x, height, -2, np.minimum), width, -1, np.minimum)


def closed(x: np.ndarray, height: int, width: int) -> np.ndarray:
    return erode(dilate(x, height, width), height, width)


def opened(x: np.ndarray, height: int, width: int) -> np.ndarray:
    return dilate(erode(x, height, width), height, width)


def smoothing(size: int) -> np.ndarray:
    if size in SMALL_KERNELS:
        return np.array(SMALL_KERNELS[size])
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def blurred(x: np.ndarray, size: int) -> np.ndarray:
    """Separable Gaussian; rasters are mirrored at their edge pixel."""
    out = x.astype(np.float64)
    for axis in (-2, -1):
        n, half, total = x.shape[axis], size // 2, 0.0
        at = np.abs(np.arange(-half, n + half))
        at = np.abs((at % max(2 * (n - 1), 1)) - np.where(at % max(2 * (n - 1), 1) >= n, 2 * (n - 1), 0)) if n > 1 else np.zeros(n + 2 * half, int)
        padded = np.take(out, at, axis=axis)
        for k, w in enumerate(smoothing(size)):
            total = total + w * np.take(padded, np.arange(k, k + n), axis=axis)
        out = total
    return out


def half_up(x: np.ndarray) -> np.ndarray:
    """Whole numbers, halves up; what float sums leave a billionth below a half counts as one."""
    return np.floor(x + 0.5 + 1e-9).astype(np.int64)


def canny(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: 3 x 3 gradients, only ridges of their strength across their direction, and from ridges over ``high`` on along those over ``low``."""
    p = np.pad(image.astype(np.int64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows, cols = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:], p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
    dx, dy = rows[:, :, 2:] - rows[:, :, :-2], cols[:, 2:] - cols[:, :-2]
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, ((0, 0), (1, 1), (1, 1)))
    n, h, w = size.shape
    at = lambda y, x: m[:, 1 + y : 1 + y + h, 1 + x : 1 + x + w]
    flat = np.abs(dy) < np.tan(np.pi / 8) * np.abs(dx)
    steep = np.abs(dy) > np.tan(3 * np.pi / 8) * np.abs(dx)
    falling = (dx < 0) == (dy < 0)
    across = np.where(falling, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))
    ridge = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), across))
    weak = ridge & (size > low)
    found = weak & (size > high)
    while True:  # a flood over the whole stack, a ring of pixels a turn
        grown = dilate(found, 3, 3) & weak
        if (grown == found).all():
            return found
        found = grown


def labels(mask: np.ndarray) -> np.ndarray:
    """For every pixel of each raster's mask the least place (row by row) of its 8-connected component; -1 elsewhere.

    Places take the least of their neighbours', and then the place their own place names: so rounds grow with the logarithm of a component.
    """
    n, h, w = mask.shape
    none = h * w
    own = np.where(mask, np.arange(none).reshape(h, w), none)
    if not n:
        return own
    while True:
        least = np.where(mask, erode(own, 3, 3), none)
        flat = np.concatenate((least.reshape(n, -1), np.full((n, 1), none)), axis=1)
        least = np.take_along_axis(flat, flat, axis=1)[:, :-1].reshape(n, h, w)
        if (least == own).all():
            return np.where(mask, own, -1)
        own = least


def component_table(found: np.ndarray) -> dict[str, np.ndarray]:
    """Of :func:`labels`, a row a component: its raster, its label, and its box and area in pixels, in order of raster and label."""
    k, y, x = np.nonzero(found >= 0)
    own = found[k, y, x]
    key, first, at, area = np.unique(k.astype(np.int64) * (found.shape[1] * found.shape[2] + 1) + own, return_index=True, return_inverse=True, return_counts=True)
    top, left, bottom, right = (np.full(len(key), v, np.int64) for v in (1 << 40, 1 << 40, -1, -1))
    np.minimum.at(top, at, y), np.minimum.at(left, at, x), np.maximum.at(bottom, at, y), np.maximum.at(right, at, x)
    return {"raster": k[first], "label": own[first], "x": left, "y": top, "w": right - left + 1, "h": bottom - top + 1, "area": area}


def keep_components(found: np.ndarray, table: dict[str, np.ndarray], keep: np.ndarray) -> np.ndarray:
    """The mask of those components of ``table`` that ``keep`` says."""
    n, size = len(found), found.shape[1] * found.shape[2]
    wanted = np.zeros((n, size + 1), bool)
    wanted[table["raster"][keep], table["label"][keep]] = True
    return np.take_along_axis(wanted, np.where(found < 0, size, found).reshape(n, -1), axis=1).reshape(found.shape)


#: Limits of the artifact mask: fixed values.
BLACK, WHITE, BORDER, LEAST_AREA, LEAST_SHARE, FILLED = 12, 235, 4, 120, 0.0025, 0.55
CYAN_HUES, CYAN_LEAST, WHITE_SATURATION = (78, 105), 70, 45


def artifact_parts(b: np.ndarray, g: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """Masks of overlays: large filled black blocks, cyan and white drawing, the border, edges beside these, and all of them grown by 7 pixels."""
    luma, (hue, saturation, value) = gray(b, g, r), hsv(b, g, r)
    _, h, w = luma.shape
    found = labels(closed(luma < BLACK, 9, 9))
    table = component_table(found)
    large = (table["area"] >= max(LEAST_AREA, int(h * w * LEAST_SHARE))) & (table["area"] / (table["w"] * table["h"]) > FILLED)
    black = keep_components(found, table, large)
    cyan = (hue >= CYAN_HUES[0]) & (hue <= CYAN_HUES[1]) & (saturation > CYAN_LEAST) & (value > CYAN_LEAST)
    white = (luma > WHITE) & (saturation < WHITE_SATURATION)
    border = np.ones(luma.shape, bool)
    border[:, BORDER : h - BORDER, BORDER : w - BORDER] = False
    drawn = black | cyan | white
    beside = dilate(canny(luma, 80, 180), 3, 3) & dilate(drawn, 9, 9)
    return {"black": black, "cyan": cyan, "white": white, "edges": beside, "border": border, "mask": dilate(drawn | beside | border, 15, 15)}


def resize_weights(n: int, to: int, how: str) -> np.ndarray:
    """(to, n) weights of one axis. ``area``: a target pixel is the mean of what it covers; ``linear``: of its two nearest, edges held."""
    out = np.zeros((to, n))
    for k in range(to):
        if how == "area":
            lo, hi = k * n / to, (k + 1) * n / to
            for at in range(int(lo), min(n, int(np.ceil(hi)))):
                out[k, at] = max(0.0, min(hi, at + 1) - max(lo, at)) / (hi - lo)
        else:
            place = (k + 0.5) * n / to - 0.5
            at = int(np.floor(place))
            out[k, min(max(at, 0), n - 1)] += 1 - (place - at)
            out[k, min(max(at + 1, 0), n - 1)] += place - at
    return out


def resized(x: np.ndarray, height: int, width: int, how: str = "area") -> np.ndarray:
    """Rasters at any other size: two matrix products for the whole stack."""
    return np.einsum("yh,nhw,xw->nyx", resize_weights(x.shape[1], height, how), x.astype(np.float64), resize_weights(x.shape[2], width, how), optimize=True)
