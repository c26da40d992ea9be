"""Queries with fitted models, pixel kernels and stateful folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.operators import ml, raster, tracking
from trackweave.plans.sql import PATCH, q
from trackweave.sources import fixtures as X


def q28_pca_variance(spark, sf):
    rows = X.patches(spark, sf)
    return ml.explained(spark, ml.components(rows, 20)[1]).select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


def q29_pca_separation(spark, sf):
    scored, _, _ = ml.components(X.patches(spark, sf).where("class_label is not null"), 5)
    centres = scored.groupBy("class_label").agg(*[F.avg(F.get("scores", F.lit(i))).alias(f"pc{i + 1}") for i in (0, 1)])
    own = F.broadcast(centres.where("class_label = 'object'").select(F.col("pc1").alias("o1"), F.col("pc2").alias("o2")))
    apart = centres.crossJoin(own).withColumn("distance", F.hypot(F.col("pc1") - F.col("o1"), F.col("pc2") - F.col("o2")))
    return apart.join(ml.silhouette(scored, "class_label", "frame"), "class_label").select("class_label", "n", F.round("distance", 4).alias("distance"), F.round("silhouette", 4).alias("silhouette"))


def q30_linear_autoencoder(spark, sf):
    scored, _, loadings = ml.components(X.patches(spark, sf).where("class_label is not null"), 10)
    out = None
    for k in (5, 10):
        own = ml.residuals(scored, loadings, k).groupBy("class_label").agg(F.round(F.avg("residual"), 5).alias(f"residual_k{k}"))
        out = own if out is None else out.join(own, "class_label")
    return out


def q81_dense_autoencoder(spark, sf):
    rows = X.patches(spark, sf)
    return ml.dense_autoencoder(rows).join(rows.select("frame", "class_label"), "frame").groupBy("case_id", "class_label").agg(F.count("*").alias("n"), F.round(F.avg("error"), 4).alias("mean_error"))


def q55_spatial_fft(spark, sf):
    return X.patches(spark, sf).select("frame", raster.spatial_spectrum(F.col("v"), 8).alias("s")).select("frame", F.round("s.energy", 6).alias("energy"), F.round("s.high", 6).alias("high"))


Q55 = q(PATCH, """
, f AS (SELECT unnest(range(0, 64)) AS k), r AS (SELECT k, sqrt(power(k // 8 - 3.5, 2) + power(k % 8 - 3.5, 2)) > 0.35 * sqrt(2 * 3.5 * 3.5) AS far FROM f),
t AS (SELECT frame, k, sum(val * cos(2 * pi() * ((k // 8 - 4) * (pos // 8) + (k % 8 - 4) * (pos % 8)) / 8)) AS re, sum(val * sin(2 * pi() * ((k // 8 - 4) * (pos // 8) + (k % 8 - 4) * (pos % 8)) / 8)) AS im FROM pixel, f GROUP BY 1, 2),
m AS (SELECT frame, far, ln(1 + sqrt(re * re + im * im)) AS mag FROM t JOIN r USING (k))
SELECT frame, round(avg(mag), 6) AS energy, round(sum(mag) FILTER (far) / (sum(mag) + 1e-9), 6) AS high FROM m GROUP BY frame""")


def q56_artifact_mask(spark, sf):
    return X.patches(spark, sf).select("case_id", "frame", raster.artifact_ratio(F.col("v"), 8, -0.1, 0.3, 3).alias("m")).select("case_id", "frame", F.round("m.ratio", 6).alias("ratio"), "m.components")


def _hourly(spark, sf):
    order = F.row_number().over(Window.partitionBy("case_id").orderBy("frame")).cast("long")
    return X.tracks(spark, sf).withColumn("ord", order).withColumn("frame", F.floor(F.col("frame") / 360).cast("long"))


def q51_link_tracks(spark, sf):
    linked = tracking.link_tracks(_hourly(spark, sf), 36.0)
    return linked.groupBy("case_id", "track").agg(F.count("*").alias("n"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))


def followed_rows(track):
    return track.select("case_id", "frame", "cx", "cy", (F.col("w") * F.col("h")).cast("double").alias("area"), F.col("status").isin(*X.VALID_STATES).alias("measured"))


def q52_tracker_fold(spark, sf):
    return tracking.follow(followed_rows(X.tracks(spark, sf)), 89.6).groupBy("case_id", "state").agg(F.count("*").alias("n"), F.round(F.avg("follow_confidence"), 4).alias("mean_confidence"))


def q76_neighbour_walk(spark, sf):
    rows = _hourly(spark, sf).select("case_id", "frame", (F.col("frame") * 20 % 640 + F.col("cy")).alias("x"), (F.col("cx") % 60).alias("y"), F.col("w").cast("double").alias("w"), F.round("cx", 2).alias("score"))
    return tracking.neighbour_walk(rows)


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()}
ORACLE_SQL = {"q55_spatial_fft": Q55}
