"""Entry points from files to a report."""

from pyspark.sql import functions as F

from trackweave import api
from trackweave.sources import fixtures as X
from trackweave.sources import sinks

SF = "/root/testdata/sf0.001"


def test_register_is_isolated_and_idempotent(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("Clip A.mp4", "1"), ("sub/clip-a.MOV", "2"), ("yt-b.webm", "3"), ("notes.txt", "4")):
        (tmp_path / name).write_text(text)
    rows = api.register_sources(spark, str(tmp_path), "b1").cache()
    got = {r.file: (r.case_id, r.source_quality) for r in rows.collect()}
    assert len({c for c, _ in got.values()}) == 3 and got["Clip A.mp4"][0] == "clip_a" and got["clip-a.MOV"][0] == "clip_a_02" and got["yt-b.webm"][1] == "secondary_copy"
    (tmp_path / "new.avi").write_text("5")
    assert [r.case_id for r in api.register_sources(spark, str(tmp_path), "b2", rows).collect()] == ["new"]


def test_from_tracks_to_report(spark, tmp_path):
    tracks = X.tracks(spark, SF)
    cases = tracks.select("case_id").distinct()
    undecided = cases.select("case_id", *[F.lit(None).cast("boolean").alias(f) for f in api.FLAGS])
    decisions = cases.select("case_id", F.when(F.col("case_id") % 3 == 0, "reject").when(F.col("case_id") % 3 == 1, "accept").otherwise("later").alias("decision"))
    validations = api.decide(undecided, decisions)
    accepted = {r.case_id for r in cases.collect() if r.case_id % 3 == 1}
    rois = api.dynamic_rois(tracks, validations, X.WIDTH, X.HEIGHT)
    assert {r.case_id for r in rois.select("case_id").distinct().collect()} == accepted
    assert rois.where("bbox_x is not null and (expanded_x > bbox_x or expanded_x + expanded_w < bbox_x + bbox_w)").count() == 0
    assert rois.where(F.col("status").isin("TRACK_LOST", "LOW_CONFIDENCE") & F.col("bbox_x").isNotNull()).count() == 0
    moved, record = api.run_motion(tracks, validations)
    assert record.where("stability < 0 or stability > 1").count() == 0 and moved.count() == record.agg(F.sum("valid_tracked_frames")).first()[0]
    frames = tracks.select("case_id", "frame", F.array("cx", "cy").alias("v"))
    assert api.run_spectral(frames, rois, 1.0).count() == rois.where("bbox_x is not null").select("case_id").distinct().count()
    report = api.unified_report(X.modules(spark, SF), validations)
    assert report.where("overall is null").count() == 0 and report.count() == X.modules(spark, SF).count()
    assert report.where("status['tracking'] = 'strong'").join(cases, "case_id").count() == len(accepted & {r.case_id for r in X.modules(spark, SF).collect()})
    assert api.run_anomaly(X.patches(spark, SF)).count() == 4
    sinks.write_table(rois, f"{tmp_path}/rois", sinks.ROI_COLUMNS)
    assert spark.read.option("header", True).csv(f"{tmp_path}/rois").count() == rois.count()


def test_tracker_registry(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 1.0, 4.0, True)], "case_id long, frame long, cx double, cy double, area double, measured boolean")
    name, found = api.track_cases(rows, ["not_there"], 10.0)
    assert name == "follower" and found.first().state == "tracked"
    api.register_tracker("still", lambda r, reach: r.select("case_id", "frame", F.lit("tracked").alias("state")))
    assert api.track_cases(rows, ["still"], 10.0)[0] == "still"
