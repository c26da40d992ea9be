"""Pixel kernels against loops, frame operators against whole frames, tiles against frames that are not cut."""

import colorsys
import math

import numpy as np
import pytest

from trackweave.operators import controls
from trackweave.operators import frames as V
from trackweave.operators import pixels as P
from trackweave.operators import tiles as T
from trackweave.operators.graph import least_reachable
from trackweave.operators.raster import component_boxes
from trackweave.streaming import tracker as streams


def planes(seed, n=3, h=30, w=34):
    """Frames with dark blocks, cyan lines, white spots and texture."""
    r = np.random.default_rng(seed)
    b, g, red = (r.integers(60, 200, (n, h, w)) for _ in range(3))
    for k in range(n):
        y, x = r.integers(2, h - 16), r.integers(2, w - 18)
        for p in (b, g, red):
            p[k, y : y + 13, x : x + 14] = r.integers(0, 6, (13, 14))
        p = r.integers(4, h - 4)
        b[k, p, 6:20], g[k, p, 6:20], red[k, p, 6:20] = 220, 210, 20
        for p in (b, g, red):
            p[k, 5:9, 24:29] = 250
    return b, g, red


def window_pick(x, height, width, pick):
    n, h, w = x.shape
    out = np.empty_like(x)
    for k in range(n):
        for i in range(h):
            for j in range(w):
                out[k, i, j] = pick(x[k, max(0, i - height // 2) : i + height // 2 + 1, max(0, j - width // 2) : j + width // 2 + 1])
    return out


def test_morphology_is_a_maximum_over_a_rectangle():
    x = np.random.default_rng(1).integers(0, 9, (2, 11, 13))
    for size in ((3, 3), (9, 3), (5, 15), (1, 1)):
        assert (P.dilate(x, *size) == window_pick(x, *size, np.max)).all() and (P.erode(x, *size) == window_pick(x, *size, np.min)).all()
    m = x > 5
    assert (P.closed(m, 3, 5) == window_pick(window_pick(m, 3, 5, np.max), 3, 5, np.min)).all()
    assert (P.opened(m, 3, 3) == window_pick(window_pick(m, 3, 3, np.min), 3, 3, np.max)).all()


def test_colours():
    b, g, r = (np.random.default_rng(k).integers(0, 256, (1, 20, 20)) for k in range(3))
    hue, saturation, value = P.hsv(b, g, r)
    for y in range(20):
        for x in range(20):
            h, s, v = colorsys.rgb_to_hsv(r[0, y, x] / 255, g[0, y, x] / 255, b[0, y, x] / 255)
            assert min(abs(h * 180 - hue[0, y, x]), 180 - abs(h * 180 - hue[0, y, x])) <= 0.5 + 1e-6 and abs(s * 255 - saturation[0, y, x]) <= 0.5 + 1e-6 and round(v * 255) == value[0, y, x]
    one = lambda *bgr: [np.array([[[c]]]) for c in bgr]
    assert P.gray(*one(255, 255, 255)).item() == 255 and P.gray(*one(0, 0, 255)).item() == 76 and P.gray(*one(255, 0, 0)).item() == 29
    assert [c.item() for c in P.hsv(*one(7, 7, 7))] == [0, 0, 7]
    known = {(255, 255, 255): (100, 0, 0), (0, 0, 0): (0, 0, 0), (0, 0, 255): (53.24, 80.09, 67.20), (0, 255, 0): (87.73, -86.18, 83.18), (255, 0, 0): (32.30, 79.19, -107.86)}
    for bgr, want in known.items():
        assert np.allclose([c.item() for c in P.lab(*one(*bgr))], want, atol=0.05)


def test_smoothing_mirrors_the_edge():
    x = np.random.default_rng(2).integers(0, 256, (2, 9, 12)).astype(float)
    for size in (3, 5, 7, 9):
        half, w = size // 2, P.smoothing(size)
        padded = np.pad(x, ((0, 0), (half, half), (half, half)), mode="reflect")
        want = np.zeros_like(x)
        for i in range(size):
            for j in range(size):
                want += w[i] * w[j] * padded[:, i : i + 9, j : j + 12]
        assert np.allclose(P.blurred(x, size), want) and abs(w.sum() - 1) < 1e-12


def plain_canny(image, low, high):
    """One frame, pixel by pixel."""
    h, w = image.shape
    at = lambda y, x: int(image[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            dx[y, x] = sum(k * (at(y + i, x + 1) - at(y + i, x - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            dy[y, x] = sum(k * (at(y + 1, x + i) - at(y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
    size = abs(dx) + abs(dy)
    m = lambda y, x: size[y, x] if 0 <= y < h and 0 <= x < w else 0
    ridge = set()
    for y in range(h):
        for x in range(w):
            s, a, b = size[y, x], abs(dx[y, x]), abs(dy[y, x])
            if s <= low:
                continue
            if b < math.tan(math.pi / 8) * a:
                ok = s > m(y, x - 1) and s >= m(y, x + 1)
            elif b > math.tan(3 * math.pi / 8) * a:
                ok = s > m(y - 1, x) and s >= m(y + 1, x)
            elif (dx[y, x] < 0) == (dy[y, x] < 0):
                ok = s > m(y - 1, x - 1) and s > m(y + 1, x + 1)
            else:
                ok = s > m(y - 1, x + 1) and s > m(y + 1, x - 1)
            if ok:
                ridge.add((y, x))
    out, todo = set(), [p for p in ridge if size[p] > high]
    while todo:
        y, x = todo.pop()
        if (y, x) not in out:
            out.add((y, x))
            todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (y + i, x + j) in ridge]
    found = np.zeros((h, w), bool)
    for p in out:
        found[p] = True
    return found


def test_edges_equal_a_pixel_by_pixel_version():
    images = np.stack([P.gray(*(p[:1] for p in planes(4)))[0], np.add.outer(np.arange(30) * 9, np.zeros(34, int)), (np.indices((30, 34)).sum(axis=0) > 30) * 200])
    for low, high in ((50, 140), (200, 700)):
        assert (P.canny(images, low, high) == np.stack([plain_canny(x, low, high) for x in images])).all()
    step = np.zeros((1, 8, 8), int)
    step[:, :, 4:] = 100
    assert P.canny(step, 50, 140)[0].sum(axis=0).tolist() == [0, 0, 0, 8, 0, 0, 0, 0]  # one pixel wide: the left of the two of equal strength


def test_labels_and_boxes_equal_a_flood():
    masks = np.random.default_rng(3).random((5, 14, 17)) < 0.4
    masks[3] = False
    masks[4] = np.indices((14, 17))[1] % 4 != 3  # long components
    t = P.component_table(P.labels(masks))
    got = [[(int(t["x"][k]), int(t["y"][k]), int(t["w"][k]), int(t["h"][k]), int(t["area"][k])) for k in np.flatnonzero(t["raster"] == n)] for n in range(5)]
    assert got == [component_boxes(m) for m in masks]


def test_artifact_mask_pixel_for_pixel():
    b, g, r = planes(5)
    got = P.artifact_parts(b, g, r)
    gray, (hue, s, v) = P.gray(b, g, r), P.hsv(b, g, r)
    for k in range(len(gray)):
        closed = window_pick(window_pick((gray[k : k + 1] < 12), 9, 9, np.max), 9, 9, np.min)[0]
        raw = np.zeros(gray[k].shape, bool)
        for x, y, w, h, area in component_boxes(closed):
            if area >= 120 and area / (w * h) > 0.55:
                raw[y : y + h, x : x + w] |= closed[y : y + h, x : x + w]
        assert raw.any()  # the dark block
        raw |= (hue[k] >= 78) & (hue[k] <= 105) & (s[k] > 70) & (v[k] > 70)
        raw |= (gray[k] > 235) & (s[k] < 45)
        near = window_pick(plain_canny(gray[k], 80, 180)[None], 3, 3, np.max)[0] & window_pick(raw[None], 9, 9, np.max)[0]
        raw |= near
        raw[:4] = raw[-4:] = raw[:, :4] = raw[:, -4:] = True
        assert (got["mask"][k] == window_pick(raw[None], 15, 15, np.max)[0]).all()


@pytest.mark.parametrize("how", ["area", "linear"])
def test_resizing_by_any_factor(how):
    x = np.random.default_rng(6).integers(0, 256, (2, 7, 11))
    for height, width in ((3, 4), (7, 11), (5, 16), (14, 22)):
        want = np.zeros((2, height, width))
        for i in range(height):
            for j in range(width):
                if how == "area":
                    y0, y1, x0, x1 = i * 7 / height, (i + 1) * 7 / height, j * 11 / width, (j + 1) * 11 / width
                    for y in range(7):
                        for z in range(11):
                            want[:, i, j] += x[:, y, z] * max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, z + 1) - max(x0, z)) / ((y1 - y0) * (x1 - x0))
                else:
                    py, px = min(max((i + 0.5) * 7 / height - 0.5, 0), 6), min(max((j + 0.5) * 11 / width - 0.5, 0), 10)
                    y, z, fy, fx = int(py), int(px), py % 1, px % 1
                    y1, z1 = min(y + 1, 6), min(z + 1, 10)
                    want[:, i, j] = (x[:, y, z] * (1 - fx) + x[:, y, z1] * fx) * (1 - fy) + (x[:, y1, z] * (1 - fx) + x[:, y1, z1] * fx) * fy
        assert np.allclose(P.resized(x, height, width, how), want)
    assert np.allclose(P.resized(x, 1, 1, "area")[:, 0, 0], x.mean(axis=(1, 2)))


FRAME = "case_id long, frame long, height int, width int, blue array<int>, green array<int>, red array<int>"


def table(spark, stacks):
    """Frames of several sizes: stacks of (blue, green, red), a case each; every second frame number is left out."""
    rows = [(c, 2 * k, b.shape[1], b.shape[2], *[p[k].ravel().tolist() for p in (b, g, r)]) for c, (b, g, r) in enumerate(stacks) for k in range(len(b))]
    return spark.createDataFrame(rows, FRAME)


def test_frames_of_several_sizes_in_one_table(spark):
    stacks = [planes(7), planes(8, 2, 20, 25)]
    df = table(spark, stacks).repartition(2)
    for r in V.colour_statistics(df).collect():
        b, g, red = (p[r.frame // 2] for p in stacks[r.case_id])
        assert math.isclose(r.luminance_mean, P.gray(b, g, red).mean()) and math.isclose(r.red_mean, red.mean())
    assert all(math.isclose(r.edges, plain_canny(P.gray(*(p[r.frame // 2] for p in stacks[r.case_id])), 50, 140).mean()) for r in V.edge_density(df).collect())
    for r in V.artifact_masks(df).collect():
        assert (np.array(r["mask"]).reshape(r.height, r.width) == P.artifact_parts(*stacks[r.case_id])["mask"][r.frame // 2]).all()
    assert V.colour_statistics(df.limit(0)).count() == 0 and V.artifact_shares(df).count() == 5
    small = V.gray_frames(df, 6, 9).where("case_id = 0 and frame = 4").first()
    assert small.gray == P.half_up(P.resized(P.gray(*stacks[0]), 6, 9))[2].ravel().tolist() and (small.height, small.width) == (6, 9)


def spots(n, h, w, at, size=5, seed=0):
    """Gray frames with a bright spot at given corners."""
    r = np.random.default_rng(seed)
    g = r.integers(90, 94, (n, h, w))
    for k, (y, x) in enumerate(at):
        if y is not None:
            g[k, y : y + size, x : x + size] = 230
    return g, g.copy(), g.copy()


def test_core_is_drawn_to_the_one_before(spark):
    lone = spots(4, 60, 60, [(20, 20), (22, 22), (None, None), (23, 23)])
    df = table(spark, [lone, spots(2, 60, 60, [(None, None), (30, 30)], seed=1)])
    rows = {(r.case_id, r.frame): r for r in V.core_track(df.repartition(3)).collect()}
    first = rows[0, 0]
    assert first.confidence > 5 and abs(first.x + first.w / 2 - 22.5) <= 2 and first.w == 32
    assert rows[0, 2].x - first.x in (0, 1)  # 0.65 of the old place and 0.35 of the new one
    step = V.core_step([10.0, 10.0, 32.0, 32.0], 60, 60, [])
    assert step == ([10.0, 10.0, 32.0, 32.0], ("LOW_CONFIDENCE", 0.0, 10, 10, 32, 32)) and V.core_step(None, 60, 60, [])[1][0] == "CORE_NOT_FOUND"
    near, far = [50.0, 26.0, 26.0, 25.0, 24, 24, 5, 5], [58.0, 50.0, 50.0, 25.0, 48, 48, 5, 5]
    assert V.core_step(None, 60, 60, near + far)[1][2] == 28 and V.core_step([10.0, 10.0, 32.0, 32.0], 60, 60, near + far)[1][2] == 10  # nearness outweighs eight points


def test_core_in_batch_and_stream(spark, tmp_path):
    r = np.random.default_rng(9)
    df = table(spark, [spots(6, 48, 48, [(int(y), int(x)) for y, x in r.integers(5, 40, (6, 2))], seed=k) for k in range(2)])
    found = V.core_candidates(df)
    want = sorted(V.core_track(df).collect())
    for k, part in enumerate((found.where("frame < 6"), found.where("frame >= 6"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    source = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = streams.core_stream(source).writeStream.format("memory").queryName("cores").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(spark.table("cores").collect()) == want


def plain_motion(stack, height, width):
    """motion_regions over one case, frame by frame."""
    gray = P.half_up(P.resized(P.gray(*stack), height, width))
    total = P.blurred(np.abs(np.diff(gray, axis=0)).sum(axis=0)[None], 9)[0]
    level = np.floor((total - total.min()) * 255 / (total.max() - total.min()) + 1e-6)
    mask = P.closed((level > max(18, int(np.percentile(level, 96))))[None], 7, 7)[0]
    x, y, w, h, _ = max(component_boxes(mask), key=lambda b: b[4])
    return x, y, w, h, total.max()


def test_motion_of_a_case_in_strips(spark):
    stacks = [spots(8, 44, 50, [(10 + k, 12 + 2 * k) for k in range(8)]), spots(2, 44, 50, [(5, 5), (9, 9)], seed=3)]
    rows = {r.case_id: r for r in V.motion_regions(table(spark, stacks).repartition(4), 33, 40).collect()}
    x, y, w, h, most = plain_motion(stacks[0], 33, 40)
    r = rows[0]
    assert math.isclose(r.motion_max, most) and (r.x, r.y) == (max(0, int((x - w * 0.35) * 50 / 40)), max(0, int((y - h * 0.35) * 44 / 33))) and r.status == "proposed"
    assert (rows[1].status, rows[1].w) == ("manual_review_required", 0)  # two frames are not enough
    sums = V.accumulated_motion(V.gray_frames(table(spark, stacks[:1])), rows=7).first()
    assert sums.frames == 8 and sums.motion == np.abs(np.diff(P.gray(*stacks[0]), axis=0)).sum(axis=0).ravel().tolist()


GRAY = "case_id long, frame long, height int, width int, gray array<int>"


def gray_table(spark, stack, case=0):
    return spark.createDataFrame([(case, k, *x.shape, x.ravel().tolist()) for k, x in enumerate(stack)], GRAY)


def test_bright_regions(spark):
    one = spots(3, 60, 80, [(20, 30), (50, 70), (None, None)], size=6)
    one[0][2] = one[1][2] = one[2][2] = 7
    got = {r.frame: (r.mode, r.x, r.y, r.w, r.h) for r in V.bright_regions(table(spark, [one])).collect()}
    mode, x, y, w, h = got[0]
    assert mode == "auto-brightness" and x <= 24 and x + w >= 42 and y <= 14 and y + h >= 32 and w < 40
    assert got[2][1] + got[2][3] == 80 and got[2][2] + got[2][4] == 60  # cut to the frame
    assert got[4] == ("auto-brightness", 0, 0, 80, 60)  # all of an even frame is its brightest
    spread = np.zeros((1, 40, 60), int)
    spread[:, :, 30:] = 255
    assert V.bright_regions(table(spark, [(spread, spread.copy(), spread.copy())])).first()[2:] == ("auto-brightness-fallback", 25, 15, 10, 10)


def test_tiles_see_their_neighbours(spark):
    stack = np.random.default_rng(11).integers(0, 256, (2, 21, 27))
    tiles = T.tiled(gray_table(spark, stack), 8)
    assert tiles.count() == 2 * 3 * 4
    for margin, kernel in ((2, lambda x: P.half_up(P.blurred(x, 5))), (8, lambda x: P.closed(P.opened(x, 3, 3), 7, 7)), (7, lambda x: P.half_up(P.blurred(x, 15)))):
        want = kernel(stack)
        for r in T.neighbourhood(tiles, 8, margin, kernel).collect():
            assert r.px == want[r.frame, r.y0 : r.y0 + r.th, r.x0 : r.x0 + r.tw].ravel().tolist()
    with pytest.raises(ValueError, match="margin"):
        T.neighbourhood(tiles, 8, 9, lambda x: x)
    shares = {r.frame: (r.a, r.b) for r in T.percentiles(tiles, {"a": 96, "b": 7}).collect()}
    assert all(np.allclose(shares[k], (np.percentile(stack[k], 96), np.percentile(stack[k], 7))) for k in (0, 1))


def test_components_over_tile_borders(spark):
    masks = (np.random.default_rng(12).random((3, 20, 26)) < 0.45).astype(int)
    masks[2] = np.indices((20, 26)).sum(axis=0) % 2 == 0  # one component through all corners
    got = T.components(T.tiled(gray_table(spark, masks), 6), 6).collect()
    rows = {k: sorted((r.x, r.y, r.w, r.h, r.area) for r in got if r.frame == k) for k in range(3)}
    assert rows == {k: sorted(component_boxes(masks[k] > 0)) for k in range(3)} and len(rows[2]) == 1
    assert T.components(T.tiled(gray_table(spark, masks * 0), 6), 6).count() == 0


def test_least_reachable(spark):
    chain = [("k", i, i + 1) for i in range(40)] + [("k", 100, 102), ("k", 102, 101), ("l", 5, 40), ("l", 7, 7)]
    got = {(r.key, r.node): r.root for r in least_reachable(spark.createDataFrame(chain, "key string, a long, b long"), ["key"]).collect()}
    assert got == {("k", i): 0 for i in range(41)} | {("k", i): 100 for i in (100, 101, 102)} | {("l", 5): 5, ("l", 40): 5}


def plain_candidates(stack):
    """candidate_boxes over whole frames."""
    soft, out = P.half_up(P.blurred(stack, 5)), []
    for k in range(len(stack)):
        change = np.abs(soft[k] - soft[k - 1]) if k else np.zeros_like(soft[0])
        moved = P.closed(P.opened((change > max(8, int(np.percentile(change, 96))))[None], 3, 3), 7, 7)[0]
        contrast = np.maximum(P.half_up(P.blurred(soft[k : k + 1], 31))[0] - soft[k], 0)
        dark = (soft[k] <= min(115, int(np.percentile(soft[k], 7)) + 8)) & (contrast > max(8, int(np.percentile(contrast, 96))))
        dark = P.closed(P.opened(dark[None], 3, 3), 9, 3)[0]
        h0, w0 = stack[k].shape
        for source, mask in (("motion", moved), ("dark_elongated", dark)):
            for x, y, w, h, area in component_boxes(mask):
                crop, pad, share = stack[k, y : y + h, x : x + w], max(8, int(max(w, h) * 0.7)), w * h / (h0 * w0)
                local = stack[k, max(0, y - pad) : y + h + pad, max(0, x - pad) : x + w + pad]
                near = x <= w0 * 0.025 or y <= h0 * 0.025 or x + w >= w0 - w0 * 0.025 or y + h >= h0 - h0 * 0.025
                if w * h < max(12, h0 * w0 * 0.000015) or share > 0.18 or w > w0 * 0.65 or h > h0 * 0.65 or (near and share < 0.0003):
                    continue
                if source == "dark_elongated" and (max(w, h) / min(w, h) < 2 or not 0.00001 <= share <= 0.025):
                    continue
                out.append((k, source, x, y, w, h, area, round(crop.std(), 6), round(crop.mean(), 6), round(max(0, local.mean() - crop.mean()), 6)))
    return sorted(out)


def test_candidate_boxes_equal_whole_frames(spark):
    r = np.random.default_rng(13)
    stack = r.integers(150, 170, (3, 70, 90))
    for k in range(3):
        stack[k, 20 + 6 * k : 30 + 6 * k, 28:40] = 240  # moves over a tile border
        stack[k, 50:54, 20:41] = 40  # dark and long
    got = T.candidate_boxes(gray_table(spark, stack), 32).collect()
    assert sorted((r.frame, r.source, r.x, r.y, r.w, r.h, r.pixels, round(r.contrast, 6), round(r.brightness, 6), round(r.dark_score, 6)) for r in got) == plain_candidates(stack)
    assert {r.source for r in got} == {"motion", "dark_elongated"} and all(r["rank"] >= 1 for r in got)


def test_controls_from_pixels_to_the_gate(spark):
    """One frame of 120 x 160 with a black block and texture, each step of the chain by hand."""
    r = np.random.default_rng(14)
    g = r.integers(80, 130, (1, 120, 160))
    g[0, 40:80, 100:140] = 3
    g[0, 52:58, 72:80] = 230
    ox, oy, w, h = 70, 50, 12, 10
    frame = table(spark, [(g, g.copy(), g.copy())]).selectExpr("*", f"{ox} AS x", f"{oy} AS y", f"{w} AS w", f"{h} AS h")
    rows = {(c.x, c.y): c for c in controls.control_candidates(frame).collect()}
    raw = [(ox + dx * 6, oy + dy * 5) for dy in (-2, -1, 0, 1, 2) for dx in (-3, -2, -1, 1, 2, 3)] + [(x, y) for x in (0, 74, 148) for y in (0, 55, 110)]
    assert set(rows) == set(raw)
    mask = P.artifact_parts(g, g, g)["mask"][0]
    valid = []
    for (x, y), c in rows.items():
        crop, reasons = g[0, y : y + h, x : x + w], []
        overlap = max(0, min(x, ox) + w - max(x, ox)) * max(0, min(y, oy) + h - max(y, oy)) / (w * h)
        edge = min(1.0, max(0.0, min(x, y, 160 - x - w, 120 - y - h) / (min(w, h) * 0.5)))
        shares = mask[y : y + h, x : x + w].mean(), (crop < 12).mean()
        reasons += ["overlaps_object"] * (overlap > 0.02) + ["artifact_mask_ratio_high"] * int(shares[0] > 0.005) + ["black_block_ratio_high"] * int(shares[1] > 0.001) + ["too_close_to_edge"] * (edge < 0.12)
        assert np.allclose((c.overlap, c.artifact_ratio, c.black, c.cyan, c.edge_score, c.texture, c.luminance), (overlap, *shares, 0, edge, crop.std(), crop.mean())) and list(c.reasons) == reasons
        assert math.isclose(c.edges, plain_canny(crop, 50, 140).mean()) and math.isclose(c.object_luminance, g[0, oy : oy + h, ox : ox + w].mean())
        valid += [c] * (not reasons)
    picked = controls.control_frames(controls.control_candidates(frame)).first()
    far = max(valid, key=lambda c: math.hypot(c.x - ox, c.y - oy))
    near = min(valid, key=lambda c: (abs(math.hypot(c.x - ox, c.y - oy) - 14.4), c.ord))
    flat = min(valid, key=lambda c: c.texture + c.edges * 100)
    assert (picked.near_background.ord, picked.far_background.ord, picked.compression_noise.ord) == (near.ord, far.ord, flat.ord)
    assert picked.random_background.ord in {c.ord for c in valid} and picked.hud_artifact.ord in {c.ord for c in rows.values() if c.artifact_ratio > 0.005} and (picked.accepted, picked.rejected) == (len(valid), len(rows) - len(valid))
    assert math.isclose(picked.background_hf, (near.hf + far.hf + flat.hf) / 3) and picked.leaks == 0 and not picked.made["dark_region"] and picked.fallbacks == 1
    record = controls.controls_summary(controls.control_frames(controls.control_candidates(frame)))
    found = record.first()
    assert math.isclose(found.validity, (6 / 7) * (1 - found.artifact_rate * 2.5 - 1 / 7)) and found.missing == ["dark_region"]
    assert controls.controls_gate(frame.select("case_id"), record).count() == 1


def test_controls_leak_and_missing(spark):
    row = "struct<luminance: double, hf: double, artifact_ratio: double>"
    kinds = list(controls.KINDS)
    one = lambda a: (50.0, 0.5, a)
    rows = [(1, 0, 10, 4, 60.0, 0.4, one(0.1), one(0.0), one(0.9), None, None, None, one(0.2)), (1, 1, 10, None, 60.0, 0.4, *[None] * 7)]
    df = spark.createDataFrame(rows, "case_id long, frame long, n long, n_valid long, object_luminance double, object_hf double, " + ", ".join(f"{k} {row}" for k in kinds))
    found = {r.frame: r for r in controls.record_inputs(df, {k: df[k] for k in kinds}).collect()}
    assert math.isclose(found[0].artifact_mean, 0.1) and found[0].leaks == 2 and found[0].fallbacks == 3 and found[0].background_hf == 0.5
    assert found[1].artifact_mean is None and found[1].fallbacks == 7 and (found[1].accepted, found[1].rejected) == (0, 10)
    record = controls.controls_summary(controls.record_inputs(df, {k: df[k] for k in kinds})).first()
    assert math.isclose(record.artifact_rate, (0.1 + 1.0) / 2) and math.isclose(record.leakage_rate, 2 / 12) and math.isclose(record.fallback_rate, 10 / 14)
