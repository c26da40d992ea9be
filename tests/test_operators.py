"""Operators against values worked out by hand or by numpy."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import geometry as G
from trackweave.functions import numbers as N
from trackweave.functions import text as T
from trackweave.functions import vectors as V
from trackweave.operators import controls, regions
from trackweave.operators import joins, metrics, ml, raster, rules, sampling, series, tracking
from trackweave.sources import readers, sinks
from trackweave.streaming import tracker as streams


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return tuple(F.lit(x) for x in v)


def test_boxes_stay_inside(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(int(x) for x in r) for r in rng.integers(-50, 800, (200, 4))]
    df = spark.createDataFrame(rows, "x int, y int, w int, h int")
    b = tuple(F.col(c) for c in "xywh")
    for made in (G.clamp(b, 640, 360), G.expand(b, 0.25, 640, 360), G.shift_inside(b, 640, 360)):
        for r in df.select(G.as_box(made).alias("b")).collect():
            assert 0 <= r.b.x and 0 <= r.b.y and r.b.w >= 1 and r.b.h >= 1 and r.b.x + r.b.w <= 640 and r.b.y + r.b.h <= 360
    assert value(spark, G.iou(box(0, 0, 10, 10), box(5, 0, 10, 10))) == pytest.approx(1 / 3)
    assert value(spark, G.overlap_of_smaller(box(0, 0, 10, 10), box(5, 5, 2, 2))) == 1.0
    assert value(spark, G.clamp_or_null(box(700, 0, 5, 5), 640, 360)) is None
    assert tuple(value(spark, G.normalized(F.lit(None).cast("struct<x:int,y:int,w:int,h:int>"), F.array(*box(1, 2, 3, 4))))) == (1, 2, 3, 4)


def test_overlap_join_finds_each_pair_once(spark):
    rng = np.random.default_rng(1)
    rows = [(0, str(i), *(int(x) for x in rng.integers(0, 300, 2)), *(int(x) for x in rng.integers(1, 200, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, id string, x int, y int, w int, h int")
    got = sorted((r.a_id, r.b_id) for r in joins.overlapping(df, df, "k").collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if min(a[2] + a[4], b[2] + b[4]) > max(a[2], b[2]) and min(a[3] + a[5], b[3] + b[5]) > max(a[3], b[3]))
    assert got == want


def test_numbers(spark):
    assert value(spark, N.linear_score(F.lit(20.0), 10, 30)) == 50.0 and value(spark, N.linear_score(F.lit(None).cast("double"), 10, 30)) == 0.0 and value(spark, N.linear_score(F.lit(5.0), 3, 3)) == 0.0
    assert value(spark, N.similarity(F.lit(10.0), F.lit(5.0))) == 0.5
    assert [value(spark, N.strength(F.lit(s).cast("double"))) for s in (0.8, 0.5, 0.1, 0.0, None)] == ["strong", "moderate", "weak", "missing", "missing"]
    assert value(spark, N.fourcc(F.lit(0x34 << 24 | 0x76 << 16 | ord("p") << 8 | ord("m")))) == "mpv4"
    z = lambda v, s=0.1, n=50, p=10.0: value(spark, N.zscore_class(F.lit(v), F.lit(s), F.lit(n), F.lit(p), F.lit("dark_strict")))
    assert [z(1.0), z(60.0), z(30.0), z(1.0, s=1e-6), z(1.0, n=3), z(float("nan")), z(1.0, p=99.6)] == ["public_safe", "unstable", "exploratory", "unstable", "discard", "discard", "exploratory"]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=64), rng.normal(size=64)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), [1.0] * 64)], "a array<double>, b array<double>, c array<double>")
    A, B, C = (F.col(x) for x in "abc")
    r = df.select(V.mean(A), V.std(A), V.correlation(A, B), V.correlation(A, C), V.percentile(A, 0.37), V.block_mean(A, 8, 8, 2), V.mean_abs_difference(A, B), V.stencil_laplacian(A, 8, 8)).first()
    x = a.reshape(8, 8)
    lap = x[1:-1, :-2] + x[1:-1, 2:] + x[:-2, 1:-1] + x[2:, 1:-1] - 4 * x[1:-1, 1:-1]
    assert np.allclose(r[:3], [a.mean(), a.std(), np.corrcoef(a, b)[0, 1]]) and r[3] is None and r[4] == pytest.approx(np.percentile(a, 37))
    assert np.allclose(r[5], x.reshape(4, 2, 4, 2).mean(axis=(1, 3)).ravel()) and r[6] == pytest.approx(np.abs(a - b).mean()) and np.allclose(r[7], lap.ravel())


def track(spark, rows):
    return spark.createDataFrame([(1, f, float(x), float(y), 10, 10, 0.9, "tracked") for f, x, y in rows], "case_id long, frame long, cx double, cy double, w int, h int, confidence double, status string")


def test_motion_and_its_summary(spark):
    df = track(spark, [(0, 0, 0), (1, 3, 4), (3, 3, 14), (4, 3, 14)])
    got = series.with_motion(df).orderBy("frame").select("velocity", "acceleration").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (5.0, 5.0), (5.0, 0.0), (0.0, -5.0)]
    s = metrics.motion_summary(df).first()
    assert (s.valid_tracked_frames, s.mean_velocity, s.median_velocity, s.max_acceleration, s.continuity) == (4, pytest.approx(10 / 3), 5.0, 5.0, 0.8)
    one = metrics.motion_summary(track(spark, [(7, 1, 1)])).first()
    assert (one.mean_velocity, one.jitter, one.stability) == (0.0, 0.0, 1.0)
    assert metrics.motion_summary(df.where("false")).count() == 0


def test_spectrum_matches_numpy(spark):
    rng = np.random.default_rng(3)
    lum = rng.normal(size=41)
    got = series.temporal_spectrum(track(spark, [(i, v, 0) for i, v in enumerate(lum)]), "cx", fps=25.0).first()
    spec = np.abs(np.fft.rfft((lum - lum.mean()) * np.hanning(41))) ** 2
    spec[0] = 0
    p = spec / (spec.sum() + 1e-9)
    assert got.peak_frequency == pytest.approx(np.fft.rfftfreq(41, 1 / 25)[spec.argmax()]) and got.peak_strength == pytest.approx(p.max(), rel=1e-6)
    assert got.entropy == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum() / np.log2(len(p)), rel=1e-6)
    assert series.temporal_spectrum(track(spark, [(0, 1, 0)]), "cx").first().peak_strength == 0.0


def test_segments_dilation_and_samples(spark):
    mask = [0, 1, 1, 0, 0, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([(1, i, bool(m)) for i, m in enumerate(mask)], "case_id long, frame long, m boolean")
    assert sorted((r.start_frame, r.end_frame) for r in series.segments(df, "m", 2).collect()) == [(1, 2), (7, 9)]
    assert [r.d for r in series.dilate(df, "m", 1, "d").orderBy("frame").collect()] == [any(mask[max(0, i - 1) : i + 2]) for i in range(10)]
    assert [r.streak for r in series.streaks(df, F.col("m")).orderBy("frame").collect()] == [0, 1, 2, 0, 0, 1, 0, 1, 2, 3]
    many = spark.range(101).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("frame"))
    assert sorted(r.frame for r in sampling.evenly(many, 8).collect()) == sorted({int(np.round(x)) for x in np.linspace(0, 100, 8)})
    assert [r.frame for r in sampling.strided(many, 10).orderBy("frame").collect()] == list(range(0, 100, 10))
    assert sampling.drawn(many, 7, 1, "frame", "case_id").count() == 7


def test_nearest_hint_and_merge(spark):
    rows = track(spark, [(0, 0, 0), (20, 1, 1), (24, 2, 2)]).withColumns({"x": F.col("cx").cast("int"), "y": F.col("cy").cast("int")})
    probes = spark.createDataFrame([(1, 10), (1, 22), (1, 100), (2, 0)], "case_id long, frame long")
    got = {(r.case_id, r.frame): r.near_frame for r in joins.nearest_frame(probes, rows, 10, ["x"]).collect()}
    assert got == {(1, 10): 0, (1, 22): 20, (1, 100): None, (2, 0): None}
    hints = spark.createDataFrame([(1, 22, 1, 1, 10, 10)], "case_id long, hint_frame long, hx int, hy int, hw int, hh int")
    assert joins.hinted(hints, rows).first().frame == 20
    old, new = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, p string, q string"), spark.createDataFrame([(2, None, "z"), (3, "n", None)], "k int, p string, q string")
    assert sorted(tuple(r) for r in joins.upsert(old, new, "k", ["p", "q"]).collect()) == [(1, "a", "b"), (2, "c", "z"), (3, "n", None)]
    assert joins.replace_by_key(old, new, "k").count() == 3 and joins.first_of([new, old], "k", ["p", "q"]).count() == 3


def test_rules_and_text(spark):
    reasons = value(spark, rules.candidate_reasons(*[F.lit(x) for x in (0.5, 0.0, 0.01, 0.0, 0.05)]))
    assert reasons == ["overlaps_object", "black_block_ratio_high", "too_close_to_edge"]
    assert [value(spark, T.slug(F.lit(s))) for s in ("  My Clip (1).x ", "___", "my_clip_1_x")] == ["my_clip_1_x", "case", "my_clip_1_x"]
    assert value(spark, T.public_path(F.lit("C:/Users/a/b.mp4"))) == "b.mp4" and value(spark, T.public_path(F.lit("/data/b.mp4"))) == "/data/b.mp4"
    assert value(spark, T.path_class(F.lit("x/Brightness/pca.csv"))) == "mixed" and value(spark, T.frame_number(F.lit("crop_000120.png"))) == 120
    lines = spark.createDataFrame([(1, "a SECRET token"), (2, "secretary")], "n int, line string")
    assert sorted((r.n, r.rule) for r in T.scan(lines).collect()) == [(1, "secret_word"), (1, "token_word")]
    ids = T.unique_ids(spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, "c")], "n int, name string"), "name", "n")
    assert sorted(r.unique_id for r in ids.collect()) == ["a_b", "a_b_02", "c"]


def test_components_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0]) + 7
    df = spark.createDataFrame([(i, "ab"[i % 2], r.tolist()) for i, r in enumerate(x)], "frame long, label string, v array<double>")
    scored, shares, loadings = ml.components(df, 4, scale=False)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:4]) and np.allclose(np.abs(loadings.T), np.abs(vt[:4]), atol=1e-6)
    rebuilt = (x - x.mean(axis=0)) @ vt[:2].T @ vt[:2]
    got = [r.residual for r in ml.residuals(scored, loadings, 2).orderBy("frame").collect()]
    assert np.allclose(got, ((x - x.mean(axis=0) - rebuilt) ** 2).mean(axis=1))
    p = np.array([r.scores[:2] for r in scored.orderBy("frame").collect()])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    for r in ml.silhouette(scored, "label", "frame", 2).collect():
        own = np.arange(120) % 2 == "ab".index(r.label)
        near, far = d[own][:, own].sum(axis=1) / (own.sum() - 1), d[own][:, ~own].mean(axis=1)
        assert math.isclose(r.silhouette, ((far - near) / np.maximum(near, far)).mean(), rel_tol=1e-9)
    full, _, load = ml.components(df, 3)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    assert np.allclose([r.z for r in full.orderBy("frame").collect()], z, atol=1e-6) and np.allclose([r.scores for r in full.orderBy("frame").collect()], z @ load, atol=1e-6)


def test_rasters():
    image = np.full((20, 20), 0.5)
    image[2:7, 3:9], image[12, 12], image[15:18, 15] = 0.0, 1.0, 0.0
    assert raster.component_boxes(image < 0.1) == [(3, 2, 6, 5, 30), (15, 15, 1, 3, 3)]
    mask = raster.artifact_mask(image, 0.1, 0.9, 10, 1, 1)
    assert mask[1, 2] and mask[13, 13] and mask[0, 0] and not mask[10, 10] and not mask[16, 15]
    assert raster.saliency_core(np.where(image == 1.0, 5.0, 0.5)) == (12, 12, 1, 1)
    moving = np.zeros((3, 20, 20))
    moving[1, 5:8, 6:10] = 1
    x, y, w, h = raster.motion_region(moving)
    assert x <= 6 and y <= 5 and x + w >= 10 and y + h >= 8 and raster.motion_region(moving[:1]) is None


def test_linking_and_walking(spark):
    rows = [(0, 0, 0), (0, 100, 0), (1, 5, 0), (1, 6, 0), (5, 101, 0), (20, 5, 0)]
    assert list(tracking.link(rows, 30.0)) == [1, 2, 1, 1, 2, 3]
    assert list(tracking.link(rows, 30.0, exclusive=True)) == [1, 2, 1, 3, 2, 4]
    df = spark.createDataFrame([(c, f, i, float(x), float(y)) for c in (1, 2) for i, (f, x, y) in enumerate(rows)], "case_id long, frame long, ord long, cx double, cy double")
    assert sorted((r.case_id, r.ord, r.track) for r in tracking.link_tracks(df, 30.0).collect()) == [(c, i, t) for c in (1, 2) for i, t in enumerate([1, 2, 1, 1, 2, 3])]
    bars = [(0, 0.0, 0.0, 10.0, 1.0), (1, 120.0, 0.0, 10.0, 9.0), (1, 130.0, 70.0, 10.0, 1.0), (2, 240.0, 5.0, 12.0, 1.0), (2, 245.0, 5.0, 12.0, 1.0), (4, 480.0, 0.0, 10.0, 1.0)]
    df = spark.createDataFrame([(c, *b) for c in (1, 2) for b in bars], "case_id long, frame long, x double, y double, w double, score double")
    assert sorted((r.case_id, r.frame, r.x) for r in tracking.neighbour_walk(df).collect()) == [(c, f, x) for c in (1, 2) for f, x in ((0, 0.0), (1, 120.0), (2, 240.0))]


def test_folds_take_their_rows_batch_by_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(c, f, float(f % 5)) for c in range(4) for f in range(c * 7)], "case_id long, frame long, v double")
        got = {}
        for r in series.smoothed(df, "v", 0.5).orderBy("case_id", "frame").collect():
            got.setdefault(r.case_id, []).append(r.ema)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c in range(1, 4):
        now = None
        for f in range(c * 7):
            now = round(f % 5 if now is None else now * 0.5 + f % 5 * 0.5)
            want.setdefault(c, []).append(now)
    assert got == want


def test_follower_in_batch_and_stream(spark, tmp_path):
    measured = [0, 1, 1, 1, 0, 0, 0, 1] + [0] * 10
    rows = spark.createDataFrame([(c, i, 10.0 + 2 * i, 5.0, 50.0, bool(m)) for c in (1, 2) for i, m in enumerate(measured)], "case_id long, frame long, cx double, cy double, area double, measured boolean")
    batch = sorted(tuple(r) for r in tracking.follow(rows, 20.0).collect())
    states = [r[2] for r in batch if r[0] == 1]
    assert states[:8] == ["waiting", "tracked", "tracked", "tracked", "low_confidence", "low_confidence", "predicted_only", "auto_recovered"] and states[-1] == "lost"
    for part, (lo, hi) in enumerate(((0, 6), (6, 18))):
        rows.where(F.col("frame").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = streams.follow_stream(source, 20.0).writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM followed").collect()) == batch


def test_progress_lines(spark):
    lines = spark.createDataFrame([('{"stage":"tracking","frame":3,"total":9,"percent":33.3}',), ("plain log",), ("{broken",)], "value string")
    got = [(r.kind, r.stage, r.frame) for r in streams.progress(lines).collect()]
    assert got == [("progress", "tracking", 3), ("log", None, None), ("log", None, None)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m/sub").mkdir(parents=True)
    for name in ("a.MP4", "sub/b.m4v", "c.txt"):
        (tmp_path / "m" / name).write_text(name)
    assert readers.media_files(spark, f"{tmp_path}/m").count() == 2 and readers.media_files(spark, f"{tmp_path}/m", readers.IMPORTED).count() == 1
    assert readers.fingerprints(spark, f"{tmp_path}/m").select("sha256").distinct().count() == 3
    (tmp_path / "r.csv").write_text("frame,status,bbox_x,extra\n3,tracked,12.7,z\n1,lost,,\n3,again,5,\n")
    rois = readers.roi_table(spark, f"{tmp_path}/r.csv").withColumn("o", F.monotonically_increasing_id())
    assert [(r.frame, r.bbox_x, r.area) for r in rois.orderBy("frame", "o").collect()] == [(1, None, None), (3, 12, None), (3, 5, None)]
    assert {r.frame: r.status for r in readers.last_by_frame(rois, "o").collect()} == {1: "lost", 3: "again"}
    (tmp_path / "t.json").write_text(json.dumps({"case_id": "c", "track": [{"frame": 1, "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}, "centroid": [2.5, 4.0], "status": "tracked"}, {"frame": 2, "bbox_xywh": [5, 6, 7, 8]}, {"frame": 3}]}))
    assert [(r.frame, r.x, r.cx) for r in readers.track_points(spark, f"{tmp_path}/t.json").orderBy("frame").collect()] == [(1, 1, 2.5), (2, 5, None), (3, None, None)]
    docs = readers.tolerant_documents(spark.createDataFrame([('{"a":1}',), (None,), ("{",)], "value string"))
    assert [r.error for r in docs.collect()] == [None, None, "invalid JSON"]
    probe = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264"}], "format": {"bit_rate": "9"}})
    assert tuple(value(spark, readers.stream_facts(F.lit(probe)))) == ("h264", True, "9")
    df = spark.createDataFrame([(1, 0, 1.5), (1, 1, None)], "case_id long, frame long, v double")
    sinks.write_table(df, f"{tmp_path}/out", ["frame", "v", "missing"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2
    for version in (1, 2):
        sinks.write_version(df.withColumn("n", F.lit(version)), f"{tmp_path}/v", version)
    assert {r.n for r in sinks.read_latest(spark, f"{tmp_path}/v").collect()} == {2}
    assert [r.row for r in sinks.markdown_rows(df, ["frame", "v"]).collect()] == ["| 0 | 1.50000 |", "| 1 |  |"]
    assert sinks.insert_absent(df, df.withColumn("case_id", F.col("frame")), "case_id").count() == 3
    assert math.isclose(sinks.with_defaults(df, {"v": 9.0, "w": 1}).agg(F.sum("v")).first()[0], 10.5)
    assert [(r.tile_row, r.tile_column) for r in sinks.tile_layout(df, "frame", 1).orderBy("frame").collect()] == [(0, 0), (1, 0)]
    assert readers.text_lines(spark, f"{tmp_path}/r.csv").count() == 4  # the break at the end of the file ends a line and begins none


def test_control_grid_and_record(spark):
    got = [tuple(b) for b in value(spark, controls.control_grid(F.lit(10), F.lit(20), F.lit(8), F.lit(6), 40, 30))]
    raw = [(10 + dx * 4, 20 + dy * 3) for dy in (-2, -1, 0, 1, 2) for dx in (-3, -2, -1, 1, 2, 3)]
    raw += [(0, 0), (32, 0), (0, 24), (32, 24), (16, 0), (16, 24), (0, 12), (32, 12), (16, 12)]
    assert got == list(dict.fromkeys((max(0, min(32, x)), max(0, min(24, y))) for x, y in raw))
    schema = "case_id long, object_luminance double, near_luminance double, far_luminance double, hud_luminance double, compression_luminance double, object_hf double, background_hf double, object_flow double, background_flow double, clean_near boolean, clean_far boolean, clean_compression boolean, made map<string,boolean>, fallbacks int, leaks int, artifact_mean double, accepted int, rejected int"
    every = dict.fromkeys(controls.KINDS, True)
    rows = [(1, 100.0, 80.0, 60.0, 50.0, 90.0, 0.4, 0.2, 1.0, 0.5, True, True, True, every, 0, 0, 0.01, 9, 1), (1, 120.0, 90.0, None, None, None, 0.6, 0.4, 2.0, float("nan"), True, False, False, {"near_background": True}, 2, 1, 0.002, 5, 5), (2, 10.0, None, None, None, None, None, None, None, None, False, False, False, {}, 7, 0, None, 0, 3)]
    found = {r.case_id: r for r in controls.controls_summary(spark.createDataFrame(rows, schema)).collect()}
    a, b = found[1], found[2]
    assert (a.object_luminance, a.near_luminance, a.far_luminance, a.background_luminance, a.delta_luminance) == (110.0, 85.0, 60.0, 72.5, 37.5)
    assert math.isclose(a.background_similarity, 1 - 37.5 / 110) and math.isclose(a.compression_similarity, (1 - 20 / 110 + 1 - 0.2) / 2) and math.isclose(a.delta_flow, 1.0)
    clean = 1 - 0.006 * 2.5 - 1 / 12 * 2 - 2 / 14
    assert math.isclose(a.validity, clean * (1 + 0.5 + 0.5) / 3) and a.missing == [] and (a.accepted, a.rejected) == (14, 6)
    assert b.artifact_rate == 1.0 and b.validity == 0.0 and b.missing == list(controls.KINDS)
    assert {r.case_id for r in controls.controls_gate(spark.range(3).withColumnRenamed("id", "case_id"), spark.createDataFrame([(0, controls.VERSION, 0.45), (1, controls.VERSION, 0.44), (2, "older", 0.9)], "case_id long, controls_version string, validity double")).collect()} == {0}


def test_regions_and_readiness(spark):
    box = lambda b: tuple(value(spark, F.struct(*b)))
    assert box(regions.centred(F.lit(321.6), F.lit(183.7), F.lit(64), F.lit(64), 640, 360)) == (290, 152, 64, 64) and box(regions.clipped(tuple(F.lit(v) for v in (-5.0, 358.5, 700.0, 9.0)), 640, 360)) == (0, 358, 640, 4)
    assert box(regions.whole_entity(F.lit(640), F.lit(360))) == (96, 21, 448, 316) and [value(spark, regions.frame_at(F.lit(i), F.lit(5))) for i in (-2, 3, 9)] == [0, 3, 4]
    modes = [value(spark, regions.roi_mode(F.lit(m).cast("string"), F.lit(w), F.lit(9))) for m, w in (("manual", 3), ("manual", 0), ("auto", 3), ("other", 3), (None, 3))]
    assert modes == ["configured", "auto_brightness", "auto_brightness", "configured", "configured"]
    assert [value(spark, regions.infrared_mode(F.lit(t), F.lit(d))) for t, d in (("a FLIR clip", 9.0), ("clip", 9.0), ("clip", 3.9))] == ["true_ir_unknown_calibration", "pseudo_intensity_only", "true_ir_unknown_calibration"]
    assert [value(spark, regions.core_confident(F.lit(n))) for n in (12, 13)] == [False, True]
    tests = regions.patch_grid_choices(F.lit(0), F.lit(0), 16, 640, 360, tuple(F.lit(v) for v in (10, 10, 20, 20)), F.lit(0.05), F.lit(0.95), F.lit(True))
    assert [k for k, t in tests.items() if value(spark, t)] == ["corners", "outside_central_zone"] and not value(spark, regions.beside_core(F.lit(320), F.lit(180), 16, 640, 360, F.lit(0.1)))
    rows = spark.createDataFrame([(1, f, v) for f, v in ((3, 0.0), (5, 1.0), (9, 7.0), (11, 2.0), (20, 1.0))] + [(2, 4, 1.0)], "case_id long, frame long, d double")
    assert sorted((r.case_id, r.ord, r.frame) for r in regions.review_frames(rows, "d").collect()) == [(1, 0, 3), (1, 1, 9), (1, 2, 20), (2, 0, 4)]
    outputs = F.array(*[F.lit(o) for o in ("track", "track_based_metrics", "dynamic_rois_json", "motion_metrics", "motion_timeseries", "controls_metrics", "controls_timeseries")])
    gates = regions.readiness(outputs, F.lit("tracking_good"), F.lit(True), F.lit("older"), controls.VERSION)
    assert len(gates) == 15 and {k for k, g in gates.items() if value(spark, g)} == {"tracking_generated", "tracking_validated", "track_based_analysis_ready", "motion_analysis_ready", "controls_analysis_ready"}
    assert value(spark, regions.review_status(gates)) == "tracking_human_validated" and [tuple(value(spark, regions.module_lock(F.lit(m), gates))) for m in ("video", "motion", "pca", "publicSummary", "x")] == [("ready", False), ("available", False), ("validated", False), ("pending", False), ("placeholder", False)]
    shares = spark.createDataFrame([(1, k, k / 10) for k in range(1, 9)], "case_id long, component int, cumulative double")
    errors, sweep = spark.createDataFrame([(1, 2.0), (1, 4.0)], "case_id long, z double"), spark.createDataFrame([(1, 9.0, "unstable"), (1, 3.0, "public_safe")], "case_id long, zscore double, class string")
    assert tuple(regions.known_metrics(shares, errors, sweep).first()) == (1, 0.5, 0.8, 3.0, 4.0, 9.0, 1)
    assert value(spark, T.placeholders(F.lit("filename: `unknown` and [edit me]"))) == [0, 7] and value(spark, T.case_label(F.lit("c1"), F.lit("clip dod-42.mp4"))) == "DOD_42" and value(spark, T.case_label(F.lit("c1"), F.lit("x"))) == "c1"


def test_json_documents(spark, tmp_path):
    sinks.write_documents(spark.createDataFrame([(1, "é", None), (2, "b", 3.5)], "case_id long, name string, score double"), f"{tmp_path}/docs")
    back = sorted((r.case_id, json.loads(r.value)) for r in spark.read.text(f"{tmp_path}/docs").collect())
    assert back == [(1, {"name": "é", "score": None}), (2, {"name": "b", "score": 3.5})]
