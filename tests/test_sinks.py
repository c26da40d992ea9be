"""Fixed-column sinks, backfilled records, configurations, artefact listings, sweeps and records of classes."""

import math

import numpy as np
from pyspark.sql import functions as F

from trackweave.functions import numbers as N
from trackweave.functions import text as T
from trackweave.operators import joins, metrics, ml, regions, sweeps
from trackweave.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_tables_of_fixed_columns(spark, tmp_path):
    track = spark.createDataFrame([(1, 5, 2.5, 3.5, "tracked", 0.9, 10, 20, 4, 6, 1.5), (2, 6, 1.0, 1.0, "lost", None, None, None, None, None, None)], "case_id long, frame long, cx double, cy double, status string, confidence double, x int, y int, w int, h int, velocity double")
    moved = sinks.motion_table(track)
    assert moved.columns == ["case_id", *sinks.MOTION_COLUMNS] and moved.where("case_id = 1").first().asDict() | {"bbox_area": 24, "centroid_x": 2.5, "velocity_px_per_frame": 1.5, "track_status": "tracked", "optical_flow_mean": None} == moved.where("case_id = 1").first().asDict()
    centroids = sinks.centroid_table(track)
    assert centroids.columns[1:] == sinks.CENTROID_COLUMNS
    sinks.write_table(centroids, f"{tmp_path}/c", sinks.CENTROID_COLUMNS)
    back = spark.read.option("header", True).csv(f"{tmp_path}/c")
    assert back.columns == [*sinks.CENTROID_COLUMNS, "case_id"] and back.where("case_id = 2").first().confidence is None
    found = spark.createDataFrame([(1, 5, 3, 4, 7, 8, 0.5, 0.1, 0.0, 0.2, 0.9, 12.0, 80.0, ["overlaps_object", "cyan_hud_ratio_high"]), (1, 5, 0, 0, 7, 8, 0.0, 0.0, 0.0, 0.0, 1.0, 9.0, 70.0, [])], "case_id long, frame long, x int, y int, w int, h int, overlap double, artifact_ratio double, black double, cyan double, edge_score double, texture double, luminance double, reasons array<string>")
    rejected = sinks.rejection_table(found)
    assert rejected.columns[1:] == sinks.REJECTION_COLUMNS and [(r.candidate_x, r.valid_for_background, r.rejection_reason, r.luminance_std) for r in rejected.orderBy("candidate_x").collect()] == [(0, True, "", 9.0), (3, False, "overlaps_object;cyan_hud_ratio_high", 12.0)]
    scored = sinks.score_table(spark.createDataFrame([(1, [0.5, -1.0]), (2, [2.0])], "frame long, scores array<double>"), ["frame"])
    assert sorted(map(tuple, scored.collect())) == [(1, 0.5, -1.0), (2, 2.0, None)]
    assert sinks.variance_table(spark.createDataFrame([(1, 0.6, 0.6)], "component int, ratio double, cumulative double")).columns == sinks.VARIANCE_COLUMNS
    boxed = sinks.flat_boxes(spark.sql("SELECT 1 AS k, named_struct('x', 1, 'y', 2, 'w', 3, 'h', 4) AS b"), "b").first()
    assert (boxed.b_x, boxed.b_y, boxed.b_w, boxed.b_h) == (1, 2, 3, 4) and "b" not in boxed.asDict()
    shown = sinks.public_fields(spark.createDataFrame([(1, "p", 0.5)], "case_id long, local_path string, score double"), ["local_path", "absent"], {"score": "tracking_score"})
    assert shown.columns == ["case_id", "tracking_score"]


def test_backfilled_records(spark):
    have = spark.createDataFrame([(1, None, "ok"), (7, True, None)], "case_id long, validated boolean, note string")
    cases = spark.createDataFrame([(1,), (2,), (2,)], "case_id long")
    got = {r.case_id: (r.validated, r.note, r.version) for r in sinks.backfilled(have, cases, {"validated": False, "note": "", "version": 1}).collect()}
    assert got == {1: (False, "ok", 1), 2: (False, "", 1), 7: (True, "", 1)}


def test_configurations_and_artefacts(spark, tmp_path):
    root = tmp_path / "out.d"
    for name, text in {"a1/motion/series.csv": "x\n", "a1/track.json": "{}", "b2/pca/deep/v.csv": "12345", "stray.txt": "z"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    listed = readers.artefacts(spark, str(root))
    assert sorted((r.case_id, r.kind, r.size_bytes) for r in listed.collect()) == [("a1", "", 2), ("a1", "motion", 2), ("b2", "pca", 5)]
    assert [r.case_id for r in readers.case_ids(listed).collect()] == ["a1", "b2"]
    configs = tmp_path / "cases"
    configs.mkdir()
    (configs / "first.json").write_text('{"case_id": "own", "source": "s"}')
    (configs / "second.case.json").write_text('{\n "source": null\n}')
    assert sorted((r.case_id, r.source) for r in readers.case_configs(spark, str(configs), "case_id string, source string").collect()) == [("own", "s"), ("second.case", None)]


def test_frame_facts(spark):
    code = ord("a") | ord("v") << 8 | ord("c") << 16 | ord("1") << 24
    rows = spark.createDataFrame([("p", 25.0, 50, 640, 360, code), ("q", 0.0, 50, 640, 360, code)], "path string, fps double, frames long, width int, height int, code int")
    assert [(r.codec, r.fps, r.duration) for r in readers.frame_facts(rows).orderBy("path").collect()] == [("avc1", 25.0, 2.0), ("avc1", 0.0, None)]


def test_small_functions(spark):
    assert one(spark, F.to_json(T.first_document(F.lit('log\n{"a": 1}\nmore\n{"b": 2}\nend')))) == '{"b":2}' and one(spark, T.first_document(F.lit("none")).isNull())
    tied = spark.createDataFrame([(2.0, 9, "x"), (1.0, 8, "y"), (1.0, 7, "z")], "v double, t int, name string")
    assert tied.agg(F.min_by("name", joins.least_by(F.col("v"), F.col("t"))).alias("n")).first().n == "z"
    assert [round(one(spark, N.log_size_score(F.lit(v))), 9) for v in (1.0, math.exp(-0.5), 0.01)] == [1.0, 0.5, 0.0]
    places = [(x, y, one(spark, regions.off_centre(F.lit(x), F.lit(y), 8, 40, 40))) for x, y in ((0, 0), (6, 20), (7, 20), (25, 25), (26, 25))]
    assert [p[2] for p in places] == [True, True, False, False, True]


def test_sweep_by_hand(spark):
    r = np.random.default_rng(2)
    stack = r.integers(0, 60, (12, 24, 24))
    stack[:, 8:16, 8:16] += 150
    grays = spark.createDataFrame([(1, k, 24, 24, x.ravel().tolist()) for k, x in enumerate(stack)], "case_id long, frame long, height int, width int, gray array<int>")
    rois = spark.createDataFrame([(1, "middle", 8, 8, 8, 8)], "case_id long, roi string, x int, y int, w int, h int")
    back = sweeps.background_patches(grays, rois, (8,))
    got = {(x.strategy, x.frame): x for x in sweeps.patch_sweep(back, sweeps.centre_targets(grays, rois, (8,))).collect()}
    activity = [0.0] + [np.abs(np.diff(stack, axis=0))[k].mean() for k in range(11)]
    quiet = set(np.argsort(activity, kind="stable")[:10].tolist())
    scaled = stack / 255
    for strategy, keep in {
        "outside_roi": lambda k, x, y, p: (x, y) != (8, 8), "low_activity_frames": lambda k, x, y, p: (x, y) != (8, 8) and k in quiet, "corners": lambda k, x, y, p: x != 8 and y != 8,
        "dark_strict": lambda k, x, y, p: p.mean() < 0.055 and p.max() < 0.2, "outside_central_zone": lambda k, x, y, p: not (x < 16.8 and x + 8 > 7.2 and y < 16.8 and y + 8 > 7.2),
    }.items():
        own = [scaled[k, y : y + 8, x : x + 8] for k in range(12) for y in (0, 8, 16) for x in (0, 8, 16) if keep(k, x, y, scaled[k, y : y + 8, x : x + 8])]
        if len(own) < 5:
            assert (strategy, 0) not in got
            continue
        template = np.mean(own, axis=0)
        errors = np.array([((p - template) ** 2).mean() for p in own])
        for k in range(12):
            row, error = got[strategy, k], ((scaled[k, 8:16, 8:16] - template) ** 2).mean()
            assert row.n == len(own) and math.isclose(row.error, error, abs_tol=1e-9) and math.isclose(row.zscore, (error - errors.mean()) / (errors.std() + 1e-12), rel_tol=1e-4)
            assert math.isclose(row.percentile, (errors < error).mean() * 100, abs_tol=1e-6)
    heads = sweeps.head_and_nearest(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((3, 9, 9, 1))], "g string, i int, v double"), "g", "v", 2, 2.5, "i")
    assert sorted((x["rank"], x.i) for x in heads.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_class_separation_by_hand(spark):
    rows = [(1, "object", [0.0, 0.0]), (1, "object", [2.0, 0.0]), (1, "near_background", [1.0, 3.0]), (1, "far_background", [1.0, 5.0]), (1, "hud_artifact", [4.0, 4.0]), (2, "object", [1.0, 1.0])]
    quality = spark.createDataFrame([(1, 0.8, 0.25)], "case_id long, validity double, silhouette double")
    got = {r.case_id: r for r in ml.class_separation(spark.createDataFrame(rows, "case_id long, class_label string, scores array<double>"), quality).collect()}
    scale = np.std([v for _, _, s in rows[:5] for v in s]) + 1e-9
    a, b = got[1], got[2]
    assert (a.object_samples, a.control_samples, a.background_distance, a.compression_distance, a.hud_distance) == (2, 3, 4.0, 0.0, 5.0)
    assert math.isclose(a.separation, 4.5 / scale) and math.isclose(a.nearest_similarity, 1 / (1 + 4 / scale)) and math.isclose(a.public_safe, 0.8 * 0.9)
    assert (b.separation, b.nearest_similarity, b.public_safe, b.background_pc1) == (0.0, 0.0, 0.0, 0.0)


def test_comparison_summary(spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.case_id: r for r in metrics.comparison_summary(d([(1, 1.0, 0.5), (1, 3.0, None)], "case_id long, residual double, correlation double"), d([(1, 0.5), (1, 0.89), (1, 0.9), (2, 0.95)], "case_id long, cumulative double"), d([(3, 2.0, 99.0)], "case_id long, zscore double, percentile double"), d([(1, 7.0)], "case_id long, std double")).collect()}
    assert (got[1].residual_mean, got[1].correlation_mean, got[1].components_for_90, got[1].zscore_mean, got[1].luminance_std_mean) == (2.0, 0.5, 3, None, 7.0) and got[2].components_for_90 == 1 and got[3].percentile_mean == 99.0


def test_case_joins(spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = {n: d([(k, f"{n}{k}") for k in own], "case_id long, v string") for n, own in {"track": [1], "motion": [1, 2], "pca": []}.items()}
    got = {r.case_id: r for r in joins.assembled(d([(1,), (2,), (3,)], "case_id long"), parts).collect()}
    assert (got[1].present, got[2].present, got[3].present) == (["track", "motion"], ["motion"], []) and got[1].track.v == "track1" and got[3].motion is None
    errors = d([(1, 5, "object"), (1, 6, "object"), (1, None, "object"), (1, 5, "hud_artifact")], "case_id long, frame long, class_label string")
    rois = d([(1, 5, 1, 2, 3, 4, "lost"), (1, None, 9, 9, 9, 9, "x")], "case_id long, frame long, x int, y int, w int, h int, status string")
    got = sorted(((r.class_label, r.frame or 0, r.bbox_x, r.track_status) for r in joins.with_regions(errors, rois).collect()))
    assert got == [("hud_artifact", 5, 1, ""), ("object", 0, None, "TRACKING_ACTIVE"), ("object", 5, 1, "lost"), ("object", 6, None, "TRACKING_ACTIVE")]
    both = joins.with_manifest(d([(1, "t"), (2, "t")], "case_id long, hint string"), d([(2, "m", "u"), (3, "m", "u")], "case_id long, hint string, url string")).collect()
    assert [tuple(r) for r in both] == [(2, "t", "u")]
