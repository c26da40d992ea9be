"""Steps whose rows, memory or batches must not grow past their input."""

import datetime
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import frames as V
from trackweave.operators import joins, series
from trackweave.plans import tracks
from trackweave.sources import shared


@pytest.fixture
def conf(spark):
    """Sets session values for a test."""
    old = {}

    def put(key, value):
        old.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def events(spark, folder, rows):
    """An events table of (user, minute, value) in a new folder."""
    start = datetime.datetime(2024, 1, 1)
    made = [(i, start + datetime.timedelta(minutes=m), u, "view", float(v), '{"k": 7}') for i, (u, m, v) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_rows_outside_segments_make_no_frames(spark, tmp_path):
    late = 3_000_000_000  # minutes: more frames than an array holds
    sf = events(spark, tmp_path, [(1, 0, 9), (1, late, 9), (2, 0, 9), (2, 1, 8), (2, 500, 1), (2, 501, 2), (2, 502, 3), (2, 503, 4)])
    assert sorted(tuple(r) for r in tracks.q08_segment_expand_except(spark, sf).collect()) == [(2, f) for f in (500, 501, 502, 503)]
    marked = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (1, 3, True), (1, 4, None), (None, 0, True), (None, 1, True)], "case_id long, frame long, m boolean")
    found = {(r.case_id, r.frame) for r in series.outside_segments(marked, "m", 2).collect()}
    assert found == {(1, 0), (1, 1), (1, 4), (None, 0), (None, 1)}


def test_probes_are_not_sent_along_whole(spark, conf):
    conf("spark.sql.maxBroadcastTableSize", "4MB")
    probes = spark.range(2).select(F.lit(1).cast("long").alias("case_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(300_000).cast("long"))).alias("frame"))  # the size of what a list becomes is not foreseen
    rows = spark.createDataFrame([(1, 95, 1), (1, 105, 2), (1, 111, 3), (1, 111, 3), (2, 100, 4)], "case_id long, frame long, x int")
    found = joins.nearest_frame(probes, rows, 10, ["x"])
    near = {(r.frame, r.near_frame, r.x): r.n for r in found.where("near_frame is not null").groupBy("frame", "near_frame", "x").agg(F.count("*").alias("n")).collect()}
    best = {f: min((abs(f - g), g, x) for g, x in ((95, 1), (105, 2), (111, 3))) for f in range(85, 122)}
    assert near == {(f, g, x): 2 for f, (_, g, x) in best.items()} and found.count() == 600_002


def test_every_third_frame_makes_no_frames(spark, tmp_path):
    late = 3_000_000_000  # minutes: more frames than an array holds
    sf = events(spark, tmp_path, [(1, m, 5) for m in (0, 9, 10, 12, 13, 16, late - 2, late)])
    assert sorted(r.frame for r in tracks.q59_frame_window_join(spark, sf).collect()) == [m for m in (10, 13, 16, late - 2) if (m - 10) % 3 == 0]


def test_percentiles_part_neighbours_as_the_sql_does(spark):
    r, rows = random.Random(3), []
    for case in range(600):  # rows that differ in their last bits, as |cx - cy| do
        low = round(r.uniform(0, 400), 2)
        n = r.randrange(2, 40)
        rows += [(case, i, low if r.random() < 0.6 else math.nextafter(low, 500.0)) for i in range(n)]
    rows += [(600, 0, 5.0), (600, 1, 5.0), (601, 0, None), (601, 1, 7.0), (602, 0, None), (603, 0, math.inf), (603, 1, 1.0)]
    got = {(x.case_id, x.frame): x.flag for x in series.flag_at_percentile(spark.createDataFrame(rows, "case_id long, frame long, v double"), "v", 0.95).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (case_id BIGINT, frame BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    assert got == {(c, f): x for c, f, x in con.execute("SELECT case_id, frame, v >= quantile_cont(v, 0.95) OVER (PARTITION BY case_id) FROM t").fetchall()}


def test_grid_places_are_compiled_whole(spark):
    from trackweave.plans import regions

    plan = regions.q82_control_grid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("array_distinct") == 1


def test_documents_are_gathered_by_one_join(spark):
    cases = spark.range(3).withColumnRenamed("id", "case_id")
    parts = {f"d{i}": cases.where(F.col("case_id") % 13 == i % 2).select("case_id", F.lit(i).alias("n"), F.lit(None).cast("string").alias("s")) for i in range(13)}
    found = joins.assembled(cases, parts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r.case_id: r for r in found.collect()}
    assert got[0].present == [f"d{i}" for i in range(0, 13, 2)] and got[1].d3.n == 3 and got[1].d3.s is None and got[2].present == [] and got[2].d0 is None


def test_kernels_take_short_batches(spark, conf):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    conf("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    px = F.array_repeat(F.lit(1), 4)
    frames = spark.range(0, 1000, 1, 1).select(F.lit(0).cast("long").alias("case_id"), F.col("id").alias("frame"), F.lit(2).alias("height"), F.lit(2).alias("width"), px.alias("blue"), px.alias("green"), px.alias("red"))
    seen = V.with_kernel(frames, "n long", lambda b, g, r: {"n": np.full(len(b), len(b))})
    assert seen.agg(F.max("n")).first()[0] <= shared.BATCH_ROWS and seen.count() == 1000


def test_controls_are_picked_by_one_aggregation(spark):
    from trackweave.plans import regions

    found = regions.q83_controls_summary(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1 and plan.count("Aggregate ") == 2
