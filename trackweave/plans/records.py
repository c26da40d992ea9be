"""Queries over sequence tracks, nested documents and latent codes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import text as T
from trackweave.operators import documents, joins, metrics, ml, regions, series, sweeps
from trackweave.operators import frames as V
from trackweave.plans import texts
from trackweave.plans.sql import FRAME, PATCH, SERIES, TRACK, q
from trackweave.sources import fixtures as X

TOTAL, PAUSE = 10080, 400


def sequence_rows(spark, sf):
    """Tracked rows with what a sequence is summed up from; a step over a longer pause is no velocity."""
    rows = series.with_motion(X.valid_tracks(spark, sf))
    step = F.when((F.col("rn") > 1) & (F.col("gap") <= PAUSE), F.col("velocity"))
    return rows.select("case_id", "frame", F.timestamp_seconds("frame").alias("frame_time"), step.alias("velocity"), (F.col("confidence") * 20).alias("dark_delta"), (F.greatest("w", "h") / F.least("w", "h")).alias("aspect"), F.col("cy").alias("brightness"))


def q100_sequence_tracks(spark, sf):
    found = metrics.sequence_tracks(sequence_rows(spark, sf), PAUSE, 30.0, TOTAL)
    return found.withColumns({c: F.round(c, 6) for c in ("duration_seconds", "continuity", "persistence", "motion", "contrast", "mean_aspect", "mean_brightness", "confidence")})


Q100 = q(SERIES, f"""
, cut AS (SELECT *, CASE WHEN pf IS NOT NULL AND frame - pf <= {PAUSE} THEN velocity END AS step, CASE WHEN pf IS NULL OR frame - pf > {PAUSE} THEN 1 ELSE 0 END AS fresh FROM motion),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY frame) AS run FROM cut),
g AS (SELECT case_id, run, min(frame) AS a, max(frame) AS b, count(*) AS n, avg(step) AS motion, avg(confidence * 20) AS contrast, avg(greatest(w, h) / least(w, h)) AS aspect, avg(cy) AS brightness FROM runs GROUP BY case_id, run HAVING count(*) >= 3)
SELECT case_id, a AS start_frame, b AS end_frame, b - a + 1 AS duration_frames, round((b - a + 1) / 30.0, 6) AS duration_seconds, n AS detected_frames, round(n / (b - a + 1), 6) AS continuity, round(n / {TOTAL}.0, 6) AS persistence, round(coalesce(motion, 0), 6) AS motion,
  round(contrast, 6) AS contrast, round(aspect, 6) AS mean_aspect, round(brightness, 6) AS mean_brightness, round(least(0.95, 0.35 + 0.35 * (n / (b - a + 1)) + 0.20 * least(1.0, n / 12)), 6) AS confidence FROM g""")


def q101_nested_sanitise(spark, sf):
    """Public forms of documents that hold paths three levels deep, in lists and objects."""
    doc = F.to_json(F.struct(
        F.struct(F.array(F.struct(F.col("page_id").alias("n"), F.col("path")), F.struct((F.col("page_id") + 1).alias("n"), F.concat(F.lit("note on "), "path").alias("path"))).alias("files"), F.array("path", F.lit("plain")).alias("paths")).alias("case"),
        F.lit(True).alias("ready"), F.col("path").alias("source"),
    ))
    made = texts._paths(spark, sf).select("page_id", doc.alias("doc"))
    return documents.rewritten(made, "page_id", "doc", T.public_path)


Q101 = q(texts.PATHS, r"""
, public AS (SELECT page_id, path, CASE WHEN replace(path, '/', '\') LIKE '%C:\Users\%' OR replace(path, '/', '\') LIKE '%\runtime\%' THEN list_last(string_split(replace(path, '/', '\'), '\')) ELSE path END AS p,
  CASE WHEN replace('note on ' || path, '/', '\') LIKE '%C:\Users\%' OR replace('note on ' || path, '/', '\') LIKE '%\runtime\%' THEN list_last(string_split(replace(path, '/', '\'), '\')) ELSE 'note on ' || path END AS noted FROM paths)
SELECT page_id, CAST(json_object('case', json_object('files', json_array(json_object('n', page_id, 'path', p), json_object('n', page_id + 1, 'path', noted)), 'paths', json_array(p, 'plain')), 'ready', true, 'source', p) AS VARCHAR) AS doc FROM public""")


def q102_latent_components(spark, sf):
    """First two components of each case's codes, a mean a class; pixels are brought to a deviation of about one."""
    crops = X.patches(spark, sf).withColumn("v", F.transform("v", lambda x: x * 8))
    coded = ml.dense_autoencoder(crops).join(crops.select("case_id", "frame", "class_label"), ["case_id", "frame"])
    scored = ml.grouped_components(coded, "case_id", "code")
    return scored.groupBy("case_id", "class_label").agg(F.count("*").alias("n"), *[F.round(F.avg(F.get("scores", F.lit(k))), 6).alias(f"pc{k + 1}") for k in range(2)])


#: Frames hold one region a case, of 16 x 16 pixels at a place of its own.
def _rois(spark, sf):
    case = F.col("case_id").cast("int")
    return X.frames(spark, sf).select("case_id").distinct().select("case_id", F.lit("own").alias("roi"), (10 + case * 3).alias("x"), (12 + case).alias("y"), F.lit(16).alias("w"), F.lit(16).alias("h"))


def swept(spark, sf):
    grays = V.gray_frames(X.frames(spark, sf))
    return sweeps.patch_sweep(sweeps.background_patches(grays, _rois(spark, sf), (5, 8)), sweeps.centre_targets(grays, _rois(spark, sf), (5, 8)))


def q103_patch_sweep(spark, sf):
    found = swept(spark, sf).drop("roi", "mean", "std")
    return found.withColumns({c: F.round(c, 4) for c in ("error", "zscore", "percentile", "ratio")})


SWEEP = FRAME + """,
sizes AS (SELECT unnest([5, 8]) AS size), rois AS (SELECT case_id, 10 + case_id * 3 AS rx, 12 + case_id AS ry FROM (SELECT DISTINCT case_id FROM px)),
stepped AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY case_id, y, x ORDER BY frame)) AS d FROM gray), act AS (SELECT case_id, frame, coalesce(round(avg(d), 10), 0.0) AS activity FROM stepped GROUP BY case_id, frame),
calm AS (SELECT case_id, frame, row_number() OVER (PARTITION BY case_id ORDER BY activity, frame) <= greatest(10, count(*) OVER (PARTITION BY case_id) // 10) AS quiet FROM act),
cell AS (SELECT case_id, frame, size, x // size * size AS px, y // size * size AS py, y % size * size + x % size AS pos, v / 255 AS v FROM gray, sizes),
stat AS (SELECT case_id, frame, size, px, py, avg(v) AS mean, max(v) AS high, NOT (px < rx + 16 AND px + size > rx AND py < ry + 16 AND py + size > ry) AS outside, quiet FROM cell JOIN rois USING (case_id) JOIN calm USING (case_id, frame) GROUP BY ALL),
taken AS (SELECT case_id, frame, size, px, py, unnest(list_filter([CASE WHEN mean < 0.055 AND high < 0.20 THEN 'dark_strict' END, CASE WHEN (px < 7.2 OR px > 32.8 - size) AND (py < 7.2 OR py > 32.8 - size) THEN 'corners' END, CASE WHEN outside THEN 'outside_roi' END,
  CASE WHEN NOT (px < 28 AND px + size > 12 AND py < 28 AND py + size > 12) THEN 'outside_central_zone' END, CASE WHEN outside AND quiet THEN 'low_activity_frames' END, CASE WHEN outside THEN 'all_frames_excluding_roi' END, CASE WHEN outside AND high < 0.92 THEN 'exclude_saturated' END,
  CASE WHEN outside AND mean < 0.25 THEN 'brightness_threshold_loose' END], lambda s: s IS NOT NULL)) AS strategy FROM stat),
back AS (SELECT strategy, c.* FROM taken t JOIN cell c USING (case_id, frame, size, px, py)), tm AS (SELECT case_id, size, strategy, pos, avg(v) AS t FROM back GROUP BY ALL),
be AS (SELECT case_id, size, strategy, frame, px, py, round(avg((v - t) * (v - t)), 12) AS error FROM back JOIN tm USING (case_id, size, strategy, pos) GROUP BY ALL),
bs AS (SELECT case_id, size, strategy, count(*) AS n, avg(error) AS m, stddev_pop(error) AS sd FROM be GROUP BY ALL HAVING count(*) >= 5),
aim AS (SELECT case_id, size, greatest(0, least(40 - size, rx + 8 - size // 2)) AS px, greatest(0, least(40 - size, ry + 8 - size // 2)) AS py FROM rois, sizes),
tv AS (SELECT g.case_id, g.frame, size, px, py, (y - py) * size + x - px AS pos, v / 255 AS v FROM gray g JOIN aim a ON a.case_id = g.case_id AND x >= px AND x < px + size AND y >= py AND y < py + size),
te AS (SELECT tv.case_id, tv.size, strategy, frame, px, py, round(avg((v - t) * (v - t)), 12) AS error FROM tv JOIN tm ON tm.case_id = tv.case_id AND tm.size = tv.size AND tm.pos = tv.pos GROUP BY ALL),
scored AS (SELECT te.*, n, m, sd, (te.error - m) / (sd + 1e-12) AS z, (SELECT count(*) FROM be WHERE be.case_id = te.case_id AND be.size = te.size AND be.strategy = te.strategy AND be.error < te.error) * 100.0 / n AS p FROM te JOIN bs USING (case_id, size, strategy)),
named AS (SELECT *, CASE WHEN n < 30 THEN 'discard' WHEN sd < 1e-5 THEN 'unstable' WHEN z > 100 OR (z > 50 AND strategy IN ('dark_strict', 'brightness_threshold_loose')) THEN 'unstable' WHEN z > 20 OR p >= 99.5 THEN 'exploratory' ELSE 'public_safe' END AS class FROM scored)"""
Q103 = q(SWEEP, "SELECT case_id, CAST(size AS INTEGER) AS size, strategy, frame, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, n, round(error, 4) AS error, round(z, 4) AS zscore, round(p, 4) AS percentile, round(error / (m + 1e-12), 4) AS ratio, class FROM named")


def q104_sweep_heads(spark, sf):
    """Each case's ten largest scores of the sweep, and the one nearest to half a deviation."""
    scored = swept(spark, sf).select("case_id", "size", "strategy", "frame", F.round("zscore", 6).alias("zscore"))
    return sweeps.head_and_nearest(scored, "case_id", "zscore", 10, 0.5, "size", "strategy", "frame")


Q104 = q(SWEEP, """
, flat AS (SELECT case_id, CAST(size AS INTEGER) AS size, strategy, frame, round(z, 6) AS zscore FROM named)
SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY zscore DESC, size, strategy, frame) AS INTEGER) AS rank FROM flat QUALIFY rank <= 10
UNION ALL SELECT case_id, size, strategy, frame, zscore, 0 AS rank FROM flat QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY abs(zscore - 0.5), size, strategy, frame) = 1""")


def q105_class_separation(spark, sf):
    """The component record over the first two numbers of each crop, with a validity and a silhouette a case."""
    rows = X.patches(spark, sf).where("class_label is not null").select("case_id", "class_label", F.slice("v", 1, 2).alias("scores"))
    quality = rows.select("case_id").distinct().select("case_id", ((F.col("case_id") + 1) / F.lit(5.0)).alias("validity"), ((F.col("case_id") - 1) / F.lit(10.0)).alias("silhouette"))
    found = ml.class_separation(rows, quality)
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c not in ("case_id", "object_samples", "control_samples")})


_AT = ", ".join(f"avg(v[{k}]) FILTER (class_label IN ({', '.join(repr(c) for c in kinds)})) AS {n}{k}" for n, kinds in (("o", ("object",)), ("b", ("near_background", "far_background", "random_background")), ("c", ("compression_noise",)), ("h", ("hud_artifact",))) for k in (1, 2))
Q105 = q(PATCH, f"""
, g AS (SELECT case_id, count(*) FILTER (class_label = 'object') AS object_samples, count(*) FILTER (class_label <> 'object') AS control_samples, {_AT}, (sum(v[1]) + sum(v[2])) / (2 * count(*)) AS m, (sum(v[1] * v[1]) + sum(v[2] * v[2])) / (2 * count(*)) AS s FROM patch WHERE class_label IS NOT NULL GROUP BY case_id),
d AS (SELECT *, coalesce(sqrt((o1 - b1) ** 2 + (o2 - b2) ** 2), 0) AS db, coalesce(sqrt((o1 - c1) ** 2 + (o2 - c2) ** 2), 0) AS dc, coalesce(sqrt((o1 - h1) ** 2 + (o2 - h2) ** 2), 0) AS dh, sqrt(s - m * m) + 1e-9 AS scale FROM g),
e AS (SELECT *, list_filter([db, dc, dh], lambda x: x > 0) AS apart FROM d)
SELECT case_id, object_samples, control_samples, round(coalesce(o1, 0), 6) AS object_pc1, round(coalesce(o2, 0), 6) AS object_pc2, round(coalesce(b1, 0), 6) AS background_pc1, round(coalesce(b2, 0), 6) AS background_pc2, round(db, 6) AS background_distance, round(dc, 6) AS compression_distance, round(dh, 6) AS hud_distance,
  round(coalesce(list_avg(apart) / scale, 0), 6) AS separation, round(coalesce(1 / (1 + list_min(apart) / scale), 0), 6) AS nearest_similarity, round(greatest(0, least(1, (case_id + 1) / 5.0 * (0.5 + least(0.5, greatest(0, (case_id - 1) / 10.0 + 0.15))))), 6) AS public_safe FROM e""")


def q106_comparison_summary(spark, sf):
    """Suppliers as cases, their lines as the rows of four tables, each of which lacks some of the cases."""
    l = X.read(spark, sf, "lineitem").withColumn("case_id", F.col("l_suppkey"))  # noqa: E741
    shares = l.where("case_id % 3 != 0").groupBy("case_id", F.col("l_linenumber").alias("component")).agg(F.count("*").alias("k"))
    by = Window.partitionBy("case_id")
    shares = shares.withColumn("cumulative", F.sum("k").over(by.orderBy("component")) / F.sum("k").over(by))
    found = metrics.comparison_summary(
        l.where("case_id % 2 = 0").select("case_id", (F.col("l_extendedprice") / 10000).alias("residual"), F.col("l_discount").alias("correlation")), shares,
        l.where("case_id % 5 != 0").select("case_id", (F.col("l_quantity") / 10).alias("zscore"), (F.col("l_tax") * 1000).alias("percentile")), l.where("case_id % 7 != 0").select("case_id", F.col("l_quantity").alias("std")),
    )
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.endswith("_mean")})


Q106 = """
WITH s AS (SELECT l_suppkey AS case_id, l_linenumber AS component, count(*) AS k FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY ALL),
c AS (SELECT case_id, sum(k) OVER (PARTITION BY case_id ORDER BY component) / sum(k) OVER (PARTITION BY case_id) AS cumulative FROM s)
SELECT case_id, round(residual_mean, 6) AS residual_mean, round(correlation_mean, 6) AS correlation_mean, components_for_90, round(zscore_mean, 6) AS zscore_mean, round(percentile_mean, 6) AS percentile_mean, round(luminance_std_mean, 6) AS luminance_std_mean
FROM (SELECT l_suppkey AS case_id, avg(l_extendedprice / 10000) AS residual_mean, avg(l_discount) AS correlation_mean FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1)
FULL JOIN (SELECT case_id, count(*) FILTER (cumulative < 0.9) + 1 AS components_for_90 FROM c GROUP BY 1) USING (case_id)
FULL JOIN (SELECT l_suppkey AS case_id, avg(l_quantity / 10) AS zscore_mean, avg(l_tax * 1000) AS percentile_mean FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1) USING (case_id)
FULL JOIN (SELECT l_suppkey AS case_id, avg(l_quantity) AS luminance_std_mean FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1) USING (case_id)
"""


def q107_patch_places(spark, sf):
    """Patches of each frame off its middle, and off the core of a whole structure and not saturated."""
    rows = sweeps.patches(V.gray_frames(X.frames(spark, sf)), 8, 4)
    x, y, high = F.col("px"), F.col("py"), F.array_max("v")
    return rows.groupBy("case_id", "frame").agg(F.count("*").alias("n"), F.count_if(regions.off_centre(x, y, 8, F.col("width"), F.col("height"))).alias("off_centre"), F.count_if(regions.beside_core(x, y, 8, 40, 40, high)).alias("beside_core"))


Q107 = q(FRAME, """
, spot AS (SELECT k // 9 * 4 AS py, k % 9 * 4 AS px FROM (SELECT unnest(range(0, 81)) AS k)),
cell AS (SELECT case_id, frame, px, py, max(v) / 255 AS high FROM gray JOIN spot ON x >= px AND x < px + 8 AND y >= py AND y < py + 8 GROUP BY ALL)
SELECT case_id, frame, count(*) AS n, count(*) FILTER (NOT (px < 26 AND px + 8 > 14 AND py < 26 AND py + 8 > 14)) AS off_centre, count(*) FILTER (NOT (px < 28 AND px + 8 > 11 AND py < 31 AND py + 8 > 8) AND high < 0.94) AS beside_core FROM cell GROUP BY case_id, frame""")


def q108_case_documents(spark, sf):
    """Customers as cases, with thirteen documents each of which most of them lack."""
    o = X.read(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("k"))
    parts = {n: o.where(F.col("k") % 13 == i).groupBy("case_id").agg(F.count("*").alias("n"), F.max("k").alias("last")) for i, n in enumerate(joins.CASE_DOCUMENTS)}
    found = joins.assembled(X.read(spark, sf, "customer").select(F.col("c_custkey").alias("case_id")), parts)
    total = sum((F.coalesce(F.col(f"{n}.last") * (i + 1), F.lit(0)) for i, n in enumerate(parts)), F.lit(0))
    return found.select("case_id", F.array_join("present", ",").alias("present"), F.size("present").alias("n"), total.alias("checked"))


_PARTS = ", ".join(f"CASE WHEN count(*) FILTER (o_orderkey % 13 = {i}) > 0 THEN '{n}' END" for i, n in enumerate(joins.CASE_DOCUMENTS))
_SUM = " + ".join(f"coalesce(max(o_orderkey) FILTER (o_orderkey % 13 = {i}) * {i + 1}, 0)" for i in range(13))
Q108 = f"""
WITH g AS (SELECT o_custkey, list_filter([{_PARTS}], lambda x: x IS NOT NULL) AS names, {_SUM} AS checked FROM orders GROUP BY o_custkey)
SELECT c_custkey AS case_id, coalesce(array_to_string(names, ','), '') AS present, CAST(coalesce(len(names), 0) AS INTEGER) AS n, coalesce(checked, 0) AS checked FROM customer LEFT JOIN g ON c_custkey = o_custkey"""


def q109_error_regions(spark, sf):
    """Crop errors with the box of their frame, where a track has one; a fifth of the crops name no frame."""
    crops = X.patches(spark, sf)
    errors = crops.select("case_id", F.when(F.col("frame") % 5 != 0, F.col("frame")).alias("frame"), F.coalesce("class_label", F.lit("none")).alias("class_label"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) / 64, 6).alias("error"))
    rois = X.tracks(spark, sf).where("case_id < 4").select("case_id", "frame", *"xywh", "status")
    return joins.with_regions(errors, rois)


Q109 = q(TRACK, PATCH.replace("\npatch", ", patch", 1) + """,
err AS (SELECT case_id, CASE WHEN frame % 5 <> 0 THEN frame END AS frame, coalesce(class_label, 'none') AS class_label, round(list_sum([x * x FOR x IN v]) / 64, 6) AS error FROM patch)
SELECT e.case_id, e.frame, class_label, error, t.x AS bbox_x, t.y AS bbox_y, t.w AS bbox_w, t.h AS bbox_h, CASE WHEN class_label = 'object' THEN coalesce(status, 'TRACKING_ACTIVE') ELSE '' END AS track_status FROM err e LEFT JOIN track t ON t.case_id = e.case_id AND t.frame = e.frame AND t.case_id < 4""")


def q110_triage_manifest(spark, sf):
    """Cases of a triage, orders, that the manifest names: those of customers with a positive balance."""
    o, c = X.read(spark, sf, "orders"), X.read(spark, sf, "customer")
    triage = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("score"), F.max("o_orderpriority").alias("hint"))
    manifest = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("hint"))
    return joins.with_manifest(triage, manifest)


Q110 = "SELECT o_custkey AS case_id, count(*) AS score, max(o_orderpriority) AS hint, any_value(c_mktsegment) AS segment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY o_custkey"


def q111_bright_regions(spark, sf):
    """Frames with their bright end drawn out, so that some of them have a region that stands out."""
    frames = X.frames(spark, sf).withColumns({c: F.transform(c, lambda p: F.floor(p.cast("double") * p * p * p / F.lit(16581375.0)).cast("int")) for c in V.PLANES})
    return V.bright_regions(frames)


Q111 = q(FRAME, """
, drawn AS (SELECT case_id, frame, y, x, floor((floor(CAST(b AS DOUBLE) * b * b * b / 16581375.0) * 1868 + floor(CAST(g AS DOUBLE) * g * g * g / 16581375.0) * 9617 + floor(CAST(r AS DOUBLE) * r * r * r / 16581375.0) * 4899 + 8192) / 16384) AS v FROM px),
k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest([1, 4, 6, 4, 1]) AS w),
down AS (SELECT case_id, frame, t.y, a.x, sum(a.v * w) AS v FROM (SELECT unnest(range(0, 40)) AS y) t, k, drawn a WHERE a.y = CASE WHEN t.y + o < 0 THEN -(t.y + o) WHEN t.y + o > 39 THEN 78 - (t.y + o) ELSE t.y + o END GROUP BY ALL),
soft AS (SELECT case_id, frame, a.y, t.x, floor(sum(a.v * w) / 256 + 0.5 + 1e-9) AS v FROM (SELECT unnest(range(0, 40)) AS x) t, k, down a WHERE a.x = CASE WHEN t.x + o < 0 THEN -(t.x + o) WHEN t.x + o > 39 THEN 78 - (t.x + o) ELSE t.x + o END GROUP BY ALL),
lim AS (SELECT frame, greatest(quantile_cont(v, 0.995), avg(v) + 2.5 * stddev_pop(v)) AS t FROM soft GROUP BY frame),
bright AS (SELECT g.frame, y, x, y * 40 + x AS place FROM soft g JOIN lim USING (frame) WHERE v >= t - 1e-6),
reach AS (SELECT frame, y, x, place, place AS root FROM bright UNION SELECT b.frame, b.y, b.x, b.place, r.root FROM reach r JOIN bright b ON b.frame = r.frame AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1 AND r.root < b.place),
part AS (SELECT frame, y, x, min(root) AS root FROM reach GROUP BY ALL), boxes AS (SELECT frame, root, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM part GROUP BY frame, root),
best AS (SELECT *, greatest(8, CAST(floor(greatest(w, h) * 0.75) AS INTEGER)) AS pad FROM boxes QUALIFY row_number() OVER (PARTITION BY frame ORDER BY area DESC, root) = 1),
every AS (SELECT DISTINCT case_id, frame FROM gray)
SELECT case_id, frame, CASE WHEN pad IS NULL THEN 'auto-brightness-fallback' ELSE 'auto-brightness' END AS mode, CAST(CASE WHEN pad IS NULL THEN 15 ELSE greatest(0, x - pad) END AS INTEGER) AS x, CAST(CASE WHEN pad IS NULL THEN 15 ELSE greatest(0, y - pad) END AS INTEGER) AS y,
  CAST(CASE WHEN pad IS NULL THEN 10 ELSE least(40, x + w + pad) - greatest(0, x - pad) END AS INTEGER) AS w, CAST(CASE WHEN pad IS NULL THEN 10 ELSE least(40, y + h + pad) - greatest(0, y - pad) END AS INTEGER) AS h FROM every LEFT JOIN best USING (frame)""").replace("WITH", "WITH RECURSIVE", 1)


_ALL = (
    q100_sequence_tracks, q101_nested_sanitise, q102_latent_components, q103_patch_sweep, q104_sweep_heads, q105_class_separation, q106_comparison_summary, q107_patch_places, q108_case_documents, q109_error_regions, q110_triage_manifest, q111_bright_regions,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "q100_sequence_tracks": Q100, "q101_nested_sanitise": Q101, "q103_patch_sweep": Q103, "q104_sweep_heads": Q104, "q105_class_separation": Q105, "q106_comparison_summary": Q106, "q107_patch_places": Q107, "q108_case_documents": Q108,
    "q109_error_regions": Q109, "q110_triage_manifest": Q110, "q111_bright_regions": Q111,
}
