"""Queries over colour frames: colour, edges, artifacts, cores, motion, candidate boxes and resizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.operators import frames as V
from trackweave.operators import rules
from trackweave.operators import tiles as T
from trackweave.sources import fixtures as X

from .sql import FRAME, q


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def q91_colour_planes(spark, sf):
    found = V.colour_statistics(X.frames(spark, sf))
    return rounded(found, *[c for c in found.columns if c.endswith(("mean", "std"))])


Q91 = q(FRAME, """
, spread AS (SELECT *, greatest(b, g, r) AS value, greatest(b, g, r) - least(b, g, r) AS d FROM gray),
turned AS (SELECT *, (510 * d + value) // greatest(2 * value, 1) AS saturation, 60 * (CASE WHEN value = r THEN g - b WHEN value = g THEN b - r + 2 * d ELSE r - g + 4 * d END) + d AS a FROM spread),
hsv AS (SELECT *, floor(a / greatest(2 * d, 1)) + CASE WHEN floor(a / greatest(2 * d, 1)) < 0 THEN 180 ELSE 0 END AS hue FROM turned)
SELECT case_id, frame, round(avg(v), 6) AS luminance_mean, round(stddev_pop(v), 6) AS luminance_std, round(avg(r), 6) AS red_mean, round(avg(g), 6) AS green_mean, round(avg(b), 6) AS blue_mean,
  round(avg(hue), 6) AS hue_mean, round(avg(saturation), 6) AS saturation_mean, round(avg(value), 6) AS value_mean FROM hsv GROUP BY case_id, frame""")


def q92_edge_density(spark, sf):
    """Edge shares feed the line score and the verdict on a crop as long and thin as its frame number makes it."""
    found = V.edge_density(X.frames(spark, sf))
    w, h = F.lit(40), F.lit(8)
    return rounded(found.withColumn("line", rules.line_score(w, h, F.col("edges"))), "edges", "line")


def q93_artifact_mask(spark, sf):
    return rounded(V.artifact_shares(X.frames(spark, sf)), "black", "cyan", "white", "edges", "border", "mask")


def q94_core_track(spark, sf):
    return rounded(V.core_track(X.frames(spark, sf)), "confidence")


def q95_motion_region(spark, sf):
    return rounded(V.motion_regions(X.frames(spark, sf), 32, 36), "area_share", "motion_mean", "motion_max", places=4)


#: Gray frames at 32 x 36 by area, as whole numbers; weights of the nine-pixel smoothing, whose deviation is 1.7.
SMALL = FRAME + """,
ys AS (SELECT k, a, least((k + 1) * 40 / 32.0, a + 1) - greatest(k * 40 / 32.0, a) AS wy FROM (SELECT unnest(range(0, 32)) AS k), (SELECT unnest(range(0, 40)) AS a) WHERE least((k + 1) * 40 / 32.0, a + 1) > greatest(k * 40 / 32.0, a)),
xs AS (SELECT k, a, least((k + 1) * 40 / 36.0, a + 1) - greatest(k * 40 / 36.0, a) AS wx FROM (SELECT unnest(range(0, 36)) AS k), (SELECT unnest(range(0, 40)) AS a) WHERE least((k + 1) * 40 / 36.0, a + 1) > greatest(k * 40 / 36.0, a)),
small AS (SELECT case_id, frame, ys.k AS y, xs.k AS x, CAST(floor(sum(v * wy * wx) / (1.25 * 40 / 36.0) + 0.5 + 1e-9) AS INTEGER) AS v FROM gray JOIN ys ON ys.a = gray.y JOIN xs ON xs.a = gray.x GROUP BY ALL)"""

Q95 = q(SMALL, """
, changed AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY case_id, y, x ORDER BY frame)) AS d FROM small),
acc AS (SELECT case_id, y, x, coalesce(sum(d), 0) AS m, count(*) AS frames FROM changed GROUP BY case_id, y, x),
k AS (SELECT o, exp(-o * o / (2 * 1.7 * 1.7)) AS w FROM (SELECT unnest(range(-4, 5)) AS o)),
kw AS (SELECT o, w / (SELECT sum(w) FROM k) AS w FROM k),
rows_ AS (SELECT case_id, y, x, sum(m * w) AS m FROM (SELECT a.case_id, t.y, a.x, a.m, kw.w FROM (SELECT DISTINCT case_id, y FROM acc) t, kw, acc a WHERE a.case_id = t.case_id AND a.y = CASE WHEN t.y + o < 0 THEN -(t.y + o) WHEN t.y + o > 31 THEN 62 - (t.y + o) ELSE t.y + o END) GROUP BY ALL),
soft AS (SELECT case_id, y, x, sum(m * w) AS m FROM (SELECT a.case_id, a.y, t.x, a.m, kw.w FROM (SELECT DISTINCT case_id, x FROM acc) t, kw, rows_ a WHERE a.case_id = t.case_id AND a.x = CASE WHEN t.x + o < 0 THEN -(t.x + o) WHEN t.x + o > 35 THEN 70 - (t.x + o) ELSE t.x + o END) GROUP BY ALL),
lim AS (SELECT case_id, min(m) AS lo, max(m) AS hi, avg(m) AS mean FROM soft GROUP BY case_id),
level AS (SELECT case_id, y, x, floor((m - lo) * 255 / (hi - lo) + 1e-6) AS l FROM soft JOIN lim USING (case_id)),
cut AS (SELECT case_id, greatest(18, floor(quantile_cont(l, 0.96))) AS t FROM level GROUP BY case_id),
mask AS (SELECT case_id, y, x FROM level JOIN cut USING (case_id) WHERE l > t),
grown AS (SELECT DISTINCT a.case_id, a.y, a.x FROM acc a JOIN mask m ON m.case_id = a.case_id AND abs(m.y - a.y) <= 3 AND abs(m.x - a.x) <= 3),
closed AS (SELECT a.case_id, a.y, a.x FROM acc a WHERE NOT EXISTS (SELECT 1 FROM acc o WHERE o.case_id = a.case_id AND abs(o.y - a.y) <= 3 AND abs(o.x - a.x) <= 3 AND NOT EXISTS (SELECT 1 FROM grown g WHERE g.case_id = o.case_id AND g.y = o.y AND g.x = o.x))),
reach AS (SELECT case_id, y, x, y * 36 + x AS root FROM closed UNION SELECT c.case_id, c.y, c.x, r.root FROM reach r JOIN closed c ON c.case_id = r.case_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1 AND r.root < c.y * 36 + c.x),
part AS (SELECT case_id, y, x, min(root) AS root FROM reach GROUP BY case_id, y, x),
boxes AS (SELECT case_id, root, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM part GROUP BY case_id, root),
best AS (SELECT * FROM boxes QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY area DESC, root) = 1),
every AS (SELECT a.case_id, a.frames, b.x, b.y, b.w, b.h, coalesce(a.frames >= 3 AND b.w IS NOT NULL, false) AS found FROM (SELECT case_id, max(frames) AS frames FROM acc GROUP BY case_id) a LEFT JOIN best b USING (case_id)),
scaled AS (SELECT *, w * h / 1152.0 AS share, greatest(0, trunc((x - w * 0.35) * (40 / 36.0))) AS rx, greatest(0, trunc((y - h * 0.35) * (40 / 32.0))) AS ry FROM every)
SELECT case_id, CASE WHEN found AND share BETWEEN 0.0003 AND 0.35 THEN 'proposed' ELSE 'manual_review_required' END AS status, CASE WHEN found THEN CASE WHEN share BETWEEN 0.0003 AND 0.35 THEN 'medium' ELSE 'low' END END AS confidence,
  CAST(CASE WHEN found THEN rx ELSE 0 END AS BIGINT) AS x, CAST(CASE WHEN found THEN ry ELSE 0 END AS BIGINT) AS y, CAST(CASE WHEN found THEN least(40 - rx, trunc(w * 1.7 * (40 / 36.0))) ELSE 0 END AS BIGINT) AS w, CAST(CASE WHEN found THEN least(40 - ry, trunc(h * 1.7 * (40 / 32.0))) ELSE 0 END AS BIGINT) AS h,
  CASE WHEN found THEN round(share, 4) END AS area_share, CASE WHEN found THEN CAST(t AS DOUBLE) END AS threshold, CASE WHEN found THEN round(mean, 4) END AS motion_mean, CASE WHEN found THEN round(hi, 4) END AS motion_max FROM scaled JOIN lim USING (case_id) JOIN cut USING (case_id)""").replace("WITH", "WITH RECURSIVE", 1)


def q96_resize(spark, sf):
    """Every frame at 32 x 36 by area: its pixels' sum, sum weighted by place, and corners."""
    small = V.gray_frames(X.frames(spark, sf), 32, 36)
    weighted = F.aggregate(F.zip_with("gray", F.sequence(F.lit(1), F.size("gray")), lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda a, b: a + b)
    return small.select("case_id", "frame", F.aggregate("gray", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), weighted.alias("weighted"), F.get("gray", F.lit(0)).alias("first"), F.element_at("gray", -1).alias("last"))


Q96 = q(SMALL, "SELECT case_id, frame, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 36 + x + 1)) AS BIGINT) AS weighted, max(CASE WHEN y = 0 AND x = 0 THEN v END) AS first, max(CASE WHEN y = 31 AND x = 35 THEN v END) AS last FROM small GROUP BY case_id, frame")

def q97_tile_components(spark, sf):
    """Components of what is bright in each frame, labelled by tiles of 16 pixels and joined over their borders."""
    tiles = T.tiled(V.gray_frames(X.frames(spark, sf)), 16)
    bright = tiles.withColumn("px", F.transform("px", lambda v: (v >= 170).cast("int")))
    return T.components(bright, 16)


Q97 = q(FRAME, """
, bright AS (SELECT case_id, frame, y, x, y * 40 + x AS place FROM gray WHERE v >= 170),
reach AS (SELECT case_id, frame, y, x, place, place AS root FROM bright UNION SELECT b.case_id, b.frame, b.y, b.x, b.place, r.root FROM reach r JOIN bright b ON b.frame = r.frame AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1 AND r.root < b.place),
least_root AS (SELECT case_id, frame, y, x, min(root) AS root FROM reach GROUP BY ALL)
SELECT case_id, frame, root, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM least_root GROUP BY case_id, frame, root""").replace("WITH", "WITH RECURSIVE", 1)


def q98_candidate_boxes(spark, sf):
    return rounded(T.candidate_boxes(V.gray_frames(X.frames(spark, sf)), 16), "contrast", "brightness", "aspect_ratio", "dark_score")


QUERIES = {f.__name__: f for f in (q91_colour_planes, q92_edge_density, q93_artifact_mask, q94_core_track, q95_motion_region, q96_resize, q97_tile_components, q98_candidate_boxes)}
ORACLE_SQL = {"q91_colour_planes": Q91, "q95_motion_region": Q95, "q96_resize": Q96, "q97_tile_components": Q97}
