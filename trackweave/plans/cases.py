"""Queries over boxes, control candidates, batch cases and module records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import geometry as G
from trackweave.functions import numbers as N
from trackweave.operators import controls, joins, metrics, rules, sampling
from trackweave.operators.sampling import hash_order
from trackweave.plans.sql import BOX, CANDIDATE, CASE, MODULE, q
from trackweave.sources import fixtures as X

XYWH = tuple("xywh")


def box():
    return tuple(F.col(c) for c in XYWH)


def named(values, prefix=""):
    return [v.cast("int").alias(prefix + c) for v, c in zip(values, XYWH)]


CLAMP = "greatest(0, least(639, {x})) AS {p}x, greatest(0, least(359, {y})) AS {p}y, greatest(1, least(640 - greatest(0, least(639, {x})), {w})) AS {p}w, greatest(1, least(360 - greatest(0, least(359, {y})), {h})) AS {p}h"
EXPAND = dict(x="x - CAST(round_even(w * 0.25, 0) AS INTEGER)", y="y - CAST(round_even(h * 0.25, 0) AS INTEGER)", w="w + 2 * CAST(round_even(w * 0.25, 0) AS INTEGER)", h="h + 2 * CAST(round_even(h * 0.25, 0) AS INTEGER)")


def q03_dynamic_rois(spark, sf):
    rows = X.boxes(spark, sf)
    inside, wide = G.clamp(box(), X.WIDTH, X.HEIGHT), G.expand(box(), 0.25, X.WIDTH, X.HEIGHT)
    cx, cy = G.centre(inside)
    found = rows.select("frame", "n", F.col("returned"), *named(inside), *named(wide, "expanded_"), cx.alias("cx"), cy.alias("cy"), (inside[2] * inside[3]).alias("area"))
    keep = ["frame", "n", "returned"]
    return found.select(*keep, *[F.when(~F.col("returned"), F.col(c)).alias(c) for c in found.columns if c not in keep])


Q03 = q(BOX, f"""
, c AS (SELECT frame, n, returned, {CLAMP.format(p='', x='x', y='y', w='w', h='h')}, {CLAMP.format(p='expanded_', **EXPAND)} FROM box)
SELECT frame, n, returned, CASE WHEN NOT returned THEN x END AS x, CASE WHEN NOT returned THEN y END AS y, CASE WHEN NOT returned THEN w END AS w, CASE WHEN NOT returned THEN h END AS h, CASE WHEN NOT returned THEN expanded_x END AS expanded_x, CASE WHEN NOT returned THEN expanded_y END AS expanded_y,
  CASE WHEN NOT returned THEN expanded_w END AS expanded_w, CASE WHEN NOT returned THEN expanded_h END AS expanded_h, CASE WHEN NOT returned THEN x + w / 2.0 END AS cx, CASE WHEN NOT returned THEN y + h / 2.0 END AS cy, CASE WHEN NOT returned THEN w * h END AS area FROM c""")


def q04_bbox_iou_overlap(spark, sf):
    rows = X.boxes(spark, sf).select("frame", F.concat_ws("-", "frame", "n", "x", "y", "w").alias("id"), F.greatest(F.lit(0), F.col("x")).alias("x"), F.greatest(F.lit(0), F.col("y")).alias("y"), "w", "h")
    rows = rows.groupBy("frame", "id").agg(*[F.min(c).alias(c) for c in XYWH])
    pairs = joins.overlapping(rows, rows, "frame").where("a_id < b_id")
    a, b = (tuple(F.col(p + c) for c in XYWH) for p in ("a_", "b_"))
    scored = pairs.select("frame", "a_id", "b_id", G.iou(a, b).alias("iou"), G.overlap_of_smaller(a, b).alias("overlap"))
    return scored.groupBy("frame").agg(F.count("*").alias("pairs"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.max("iou"), 6).alias("max_iou"), F.count_if(F.col("overlap") > 0.02).alias("overlapping"))


Q04 = q(BOX, """
, b AS (SELECT frame, concat_ws('-', frame, n, x, y, w) AS id, min(greatest(0, x)) AS x, min(greatest(0, y)) AS y, min(w) AS w, min(h) AS h FROM box GROUP BY 1, 2),
p AS (SELECT a.frame, CAST(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS DOUBLE) AS i, a.w * a.h AS aa, b.w * b.h AS ba FROM b a JOIN b ON a.frame = b.frame AND a.id < b.id)
SELECT frame, count(*) AS pairs, round(avg(i / (aa + ba - i)), 6) AS mean_iou, round(max(i / (aa + ba - i)), 6) AS max_iou, count(*) FILTER (i / greatest(1, least(aa, ba)) > 0.02) AS overlapping FROM p WHERE i > 0 GROUP BY frame""")


def judged(candidates):
    zero = F.lit(0.0)
    reasons = rules.candidate_reasons(F.col("overlap"), F.col("artifact_ratio"), F.when(F.col("luminance") < 12, 1.0).otherwise(0.0), zero, F.col("edge_score"))
    distance = F.abs(F.col("texture") - 20) * 10
    black, draw = F.when(F.col("luminance") < 12, 1.0).otherwise(0.0), hash_order(42, "frame", "ord.l_linenumber", "ord.l_partkey", "ord.l_suppkey")
    return candidates.withColumns({"reasons": reasons, "distance": distance, "black": black, "cyan": zero, "edges": zero, "draw": draw})


def q16_control_quality(spark, sf):
    rows = judged(X.candidates(spark, sf)).withColumn("rejection_reason", F.array_join("reasons", ";"))
    return rows.groupBy("rejection_reason").agg(F.count("*").alias("n"), F.round(F.avg("texture"), 4).alias("mean_texture"), F.round(F.max("overlap"), 4).alias("max_overlap")).withColumn("valid_for_background", F.col("rejection_reason") == "")


JUDGED = CANDIDATE + """,
judged AS (SELECT *, abs(texture - 20) * 10 AS distance, concat_ws(';', CASE WHEN overlap > 0.02 THEN 'overlaps_object' END, CASE WHEN artifact_ratio > 0.005 THEN 'artifact_mask_ratio_high' END, CASE WHEN luminance < 12 THEN 'black_block_ratio_high' END, CASE WHEN edge_score < 0.12 THEN 'too_close_to_edge' END) AS rejection_reason FROM candidate)"""
Q16 = q(JUDGED, "SELECT rejection_reason, count(*) AS n, round(avg(texture), 4) AS mean_texture, round(max(overlap), 4) AS max_overlap, rejection_reason = '' AS valid_for_background FROM judged GROUP BY rejection_reason")
KINDS = list(controls.KINDS)


def picked(spark, sf):
    return rules.pick_controls_of(judged(X.candidates(spark, sf).repartition("frame")), F.size("reasons") == 0, 50.0)


def q17_control_pick(spark, sf):
    show = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("|", f"{c}.l_linenumber", f"{c}.l_partkey", f"{c}.l_suppkey")).alias(c)
    return picked(spark, sf).select("frame", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), *[show(c) for c in KINDS])


PICKED = JUDGED + """,
good AS (SELECT frame, count(*) AS n_valid, arg_min(ord, (abs(distance - 50.0), ord)) AS near_background, arg_min(ord, (-distance, ord)) AS far_background, arg_min(ord, (luminance, ord)) FILTER (luminance < 95) AS dark_region, arg_min(ord, (-luminance, ord)) FILTER (luminance > 90) AS bright_region,
  arg_min(ord, (texture, ord)) FILTER (texture BETWEEN 4 AND 38) AS compression_noise, arg_min(ord, (sha256(concat_ws('|', '42', frame, ord[1], ord[2], ord[3])), ord)) AS random_background FROM judged WHERE rejection_reason = '' GROUP BY frame),
bad AS (SELECT frame, arg_min(ord, (-(artifact_ratio + CASE WHEN luminance < 12 THEN 1.0 ELSE 0.0 END), ord)) FILTER (artifact_ratio > 0.005 OR luminance < 12) AS hud_artifact FROM judged WHERE rejection_reason <> '' GROUP BY frame),
picked AS (SELECT * FROM good FULL JOIN bad USING (frame))"""
Q17 = q(PICKED, "SELECT frame, coalesce(n_valid, 0) AS n_valid, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN concat_ws('|', {c}[1], {c}[2], {c}[3]) END AS {c}" for c in KINDS) + " FROM picked")


def q18_control_metrics(spark, sf):
    picks = picked(spark, sf)
    flat = picks.select("frame", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("ord")) for k in KINDS])).alias("p")).select("frame", "p.kind", "p.ord").where("ord is not null")
    rows = flat.join(X.candidates(spark, sf).select("frame", "ord", "luminance", "texture"), ["frame", "ord"])
    by = rows.groupBy("kind").agg(F.count("*").alias("n"), F.avg("luminance").alias("luminance"), F.avg("texture").alias("texture"))
    base = by.agg(F.avg(F.when(F.col("kind").isin("near_background", "far_background"), F.col("luminance"))).alias("b"))
    frames = picks.agg(F.count("*").alias("frames"))
    return by.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(frames)).select("kind", "n", F.round(F.col("n") / F.col("frames"), 6).alias("clean_ratio"), F.round("luminance", 6).alias("luminance"), F.round("texture", 6).alias("texture"), F.round(N.similarity(F.col("luminance"), F.col("b")), 6).alias("similarity"))


Q18 = q(PICKED, """
, flat AS (""" + " UNION ALL ".join(f"SELECT frame, '{k}' AS kind, {k} AS ord FROM picked WHERE {k} IS NOT NULL" for k in KINDS) + """),
by_ AS (SELECT kind, count(*) AS n, avg(luminance) AS luminance, avg(texture) AS texture FROM flat JOIN candidate USING (frame, ord) GROUP BY kind), base AS (SELECT avg(luminance) FILTER (kind IN ('near_background', 'far_background')) AS b FROM by_)
SELECT kind, n, round(n / (SELECT count(*) FROM picked), 6) AS clean_ratio, round(luminance, 6) AS luminance, round(texture, 6) AS texture, round(greatest(0.0, 1 - abs(luminance - b) / greatest(1.0, abs(luminance), abs(b))), 6) AS similarity FROM by_, base""")


def prioritised(spark, sf):
    roi = F.col("case_id") % 9 != 4
    label = rules.priority(F.col("quality") == "P", roi, *[F.col(c) for c in ("width", "height", "duration", "motion", "saturated", "contrast")])
    return X.cases(spark, sf).withColumn("roi_ok", roi).withColumn("priority", label)


def q31_batch_priority(spark, sf):
    return prioritised(spark, sf).select("case_id", "priority", "hint", F.round("duration", 8).alias("duration"))


PRIORITISED = CASE + """,
prioritised AS (SELECT *, case_id % 9 <> 4 AS roi_ok, CASE WHEN quality = 'P' THEN 'discard_candidate' WHEN case_id % 9 = 4 THEN 'manual_review_required' WHEN width < 320 OR height < 180 OR duration < 1 THEN 'low_priority' WHEN motion > 6 AND contrast > 20 AND saturated < 0.12 THEN 'high_priority'
  WHEN motion > 2 AND contrast > 10 THEN 'medium_priority' ELSE 'low_priority' END AS priority FROM cases)"""
Q31 = q(PRIORITISED, "SELECT case_id, priority, hint, round(duration, 8) AS duration FROM prioritised")


def q32_triage_index(spark, sf):
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(rules.PRIORITIES) for x in (p, i)]), F.col("priority")), F.lit(9))
    rows = prioritised(spark, sf)
    first = rows.orderBy(order, "case_id").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(order, "case_id"))).select(F.lit("top").alias("part"), F.col("rank").cast("long").alias("n"), F.concat_ws(":", "priority", "case_id").alias("what"))
    counts = metrics.counts_with_zeros(rows, "priority", [*rules.PRIORITIES, "unseen"]).select(F.lit("count").alias("part"), "n", F.col("priority").alias("what"))
    return first.unionByName(counts)


Q32 = q(PRIORITISED, """
, ordered AS (SELECT *, CASE priority WHEN 'high_priority' THEN 0 WHEN 'medium_priority' THEN 1 WHEN 'manual_review_required' THEN 2 WHEN 'low_priority' THEN 3 WHEN 'discard_candidate' THEN 4 ELSE 9 END AS o FROM prioritised)
SELECT 'top' AS part, n, what FROM (SELECT row_number() OVER (ORDER BY o, case_id) AS n, concat_ws(':', priority, case_id) AS what FROM ordered) WHERE n <= 10
UNION ALL SELECT 'count', count(p.case_id), v.priority FROM (SELECT unnest(['high_priority', 'medium_priority', 'manual_review_required', 'low_priority', 'discard_candidate', 'unseen']) AS priority) v LEFT JOIN prioritised p USING (priority) GROUP BY v.priority""")


def q33_review_items(spark, sf):
    rows = prioritised(spark, sf)
    k = F.col("case_id")
    warnings = rules.artifact_warnings(*[F.col(c) for c in ("saturated", "motion", "duration", "width", "height", "roi_ok")])
    rows = rows.withColumn("warnings", warnings).withColumn("risk", rules.artifact_risk(F.col("warnings"), F.col("saturated")))
    gate = rules.gate_status(k % 4 != 0, k % 3 != 0, F.lit(True), k % 5 != 0)
    return rows.select("case_id", "risk", F.array_join("warnings", "; ").alias("warnings"), rules.recommendation(gate, F.col("roi_ok"), F.col("risk"), F.col("contrast"), F.col("motion"), F.col("contrast"), F.col("duration")).alias("recommendation"), F.round(N.linear_score(F.col("motion"), 1, 18), 4).alias("motion_score"))


Q33 = q(PRIORITISED, """
, w AS (SELECT *, list_filter([CASE WHEN saturated > 0.18 THEN 'high saturation risk' WHEN saturated > 0.06 THEN 'some saturated highlights' END, CASE WHEN motion > 25 THEN 'large global motion' END, CASE WHEN duration < 6 THEN 'very short clip' END, CASE WHEN width < 640 OR height < 360 THEN 'low resolution' END, CASE WHEN NOT roi_ok THEN 'ROI uncertain' END], lambda x: x IS NOT NULL) AS warnings FROM prioritised),
r AS (SELECT *, CASE WHEN len(warnings) = 0 THEN 'low' WHEN len(warnings) >= 3 OR saturated > 0.18 THEN 'high' ELSE 'medium' END AS risk, CASE WHEN case_id % 4 = 0 THEN 'tracking_required' WHEN case_id % 3 <> 0 AND case_id % 5 <> 0 THEN 'validated' ELSE 'tracking_unvalidated' END AS gate,
  greatest(0.0, least(100.0, 100.0 * (contrast - 8) / 37)) AS visible, greatest(0.0, least(100.0, 100.0 * (motion - 1) / 17)) AS moving, greatest(0.0, least(100.0, 100.0 * (contrast - 10) / 45)) AS clear FROM w)
SELECT case_id, risk, array_to_string(warnings, '; ') AS warnings, CASE WHEN gate <> 'validated' THEN gate WHEN NOT roi_ok THEN 'needs_manual_roi' WHEN risk = 'high' THEN 'likely_artifact' WHEN visible >= 55 AND moving >= 45 AND risk = 'low' AND duration >= 8 THEN 'promote_to_deep_analysis'
  WHEN visible >= 45 AND clear >= 45 AND duration < 30 THEN 'content_candidate' WHEN visible < 25 AND moving < 20 THEN 'low_value_after_review' ELSE 'needs_manual_roi' END AS recommendation, round(moving, 4) AS motion_score FROM r""")


def q42_case_record(spark, sf):
    own = X.modules(spark, sf).where("n is not null").select("case_id", "motion", "spectral")
    kept = X.modules(spark, sf).select("case_id", F.lit(0.5).alias("motion"), F.when(F.col("case_id") % 2 == 0, F.lit(0.25)).alias("spectral"))
    merged = joins.overlay(kept, own, "case_id", ["motion", "spectral"])
    facts = X.read(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), "c_mktsegment", "c_nationkey")
    nation = X.read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return merged.join(facts, "case_id", "left").join(F.broadcast(nation), "c_nationkey", "left").select("case_id", "c_mktsegment", "n_name", F.round("motion", 6).alias("motion"), F.round("spectral", 6).alias("spectral"))


Q42 = q(MODULE, """SELECT case_id, c_mktsegment, n_name, round(coalesce(motion, 0.5), 6) AS motion, round(coalesce(spectral, CASE WHEN case_id % 2 = 0 THEN 0.25 END), 6) AS spectral FROM module JOIN customer ON c_custkey = case_id LEFT JOIN nation ON n_nationkey = c_nationkey""")


def statuses(spark, sf):
    k = F.col("case_id")
    found = rules.module_status(k % 3 != 0, k % 4 != 0)
    return X.modules(spark, sf).select("case_id", F.map_from_arrays(F.array(*[F.lit(n) for n in found]), F.array(*found.values())).alias("status"))


def q43_module_status(spark, sf):
    s = F.col("status")
    return statuses(spark, sf).select("case_id", *[F.element_at(s, m).alias(m) for m in ("tracking", "motion", "thermal_ir", "srv", "controls", "autoencoder")], rules.overall(s).alias("overall"), rules.modules_with(s, "strong").alias("strongest"), rules.modules_with(s, "weak", "missing").alias("weakest"))


def _strength(c, strong=0.75, moderate=0.45):
    return f"CASE WHEN {c} >= {strong} THEN 'strong' WHEN {c} >= {moderate} THEN 'moderate' WHEN {c} > 0 THEN 'weak' ELSE 'missing' END"


STATUS = MODULE + f""",
raw_ AS (SELECT *, {_strength('motion')} AS m, {_strength('anomaly', 0.75, 0.6)} AS a FROM module),
status AS (SELECT case_id, CASE WHEN case_id % 3 <> 0 THEN 'strong' ELSE 'missing' END AS tracking, CASE WHEN case_id % 4 <> 0 THEN 'ready' ELSE 'missing' END AS dynamic_roi, CASE WHEN m = 'strong' AND coalesce(stability, 0.0) < 0.5 THEN 'moderate' ELSE m END AS motion, {_strength('spectral', 0.55, 0.35)} AS spectral,
  {_strength('thermal', 0.12, 0.04)} AS thermal_ir, CASE WHEN n IS NULL THEN 'missing' WHEN n % 3 = 0 THEN 'weak' ELSE 'moderate' END AS srv, {_strength('controls', 0.8, 0.55)} AS controls, {_strength('pca')} AS pca, CASE WHEN a = 'weak' AND coalesce(max_z, 0.0) > 3 THEN 'exploratory' ELSE a END AS autoencoder FROM raw_),
long_ AS (UNPIVOT status ON COLUMNS(* EXCLUDE case_id) INTO NAME module VALUE strength),
counts AS (SELECT case_id, count(*) FILTER (strength = 'strong') AS s, count(*) FILTER (strength = 'moderate') AS m, count(*) FILTER (strength = 'exploratory') AS e, count(*) FILTER (strength = 'missing') AS x, string_agg(module, ',' ORDER BY module) FILTER (strength = 'strong') AS strongest, string_agg(module, ',' ORDER BY module) FILTER (strength IN ('weak', 'missing')) AS weakest FROM long_ GROUP BY case_id),
assessed AS (SELECT case_id, CASE WHEN s >= 3 AND m >= 2 THEN 'usable' WHEN s + m >= 4 THEN 'mixed' WHEN e > 0 AND s + m >= 2 THEN 'exploratory' WHEN x > 4 THEN 'incomplete' ELSE 'limited' END AS overall, coalesce(strongest, '') AS strongest, coalesce(weakest, '') AS weakest FROM counts)"""
Q43 = q(STATUS, "SELECT case_id, tracking, motion, thermal_ir, srv, controls, autoencoder, overall, strongest, weakest FROM status JOIN assessed USING (case_id)")


def q44_control_comparison(spark, sf):
    """Cases of the building segment are the controls of all others."""
    segment = X.read(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_control"))
    rows = X.modules(spark, sf).join(segment, "case_id")
    cases = rows.where("not is_control").select("case_id", F.col("motion").alias("residual_mean"), F.col("pca").alias("corr_mean"), "is_control")
    controls = rows.where("is_control").select("case_id", F.col("motion").alias("residual_mean"), F.col("max_z").alias("zscore_mean"), "is_control")
    both = cases.unionByName(controls, allowMissingColumns=True)
    return both.groupBy("is_control").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("residual_mean", "corr_mean", "zscore_mean")])


Q44 = q(MODULE, """SELECT c_mktsegment = 'BUILDING' AS is_control, count(*) AS n, round(avg(motion), 6) AS residual_mean, round(avg(CASE WHEN c_mktsegment <> 'BUILDING' THEN pca END), 6) AS corr_mean, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN max_z END), 6) AS zscore_mean
FROM module JOIN customer ON c_custkey = case_id GROUP BY 1""")


def q45_status_upsert(spark, sf):
    """Cases not yet open are in the old list, those not finished in the new one; every case is in one at least."""
    rows = prioritised(spark, sf)
    old = rows.where("quality != 'O'").select("case_id", "priority", F.col("hint").alias("note"))
    new = rows.where("quality != 'F'").select("case_id", F.lit("reviewed").alias("priority"), F.when(F.col("motion") > 15, F.lit("again")).alias("note"))
    merged = joins.upsert(old, new, "case_id", ["priority", "note"])
    replaced = joins.replace_by_key(old, new, "case_id").groupBy("case_id").agg(F.count("*").alias("rows_after"))
    return merged.join(replaced, "case_id")


Q45 = q(PRIORITISED, """
, old AS (SELECT case_id, priority, hint AS note FROM prioritised WHERE quality <> 'O'), new AS (SELECT case_id, 'reviewed' AS priority, CASE WHEN motion > 15 THEN 'again' END AS note FROM prioritised WHERE quality <> 'F')
SELECT coalesce(n.case_id, o.case_id) AS case_id, coalesce(n.priority, o.priority) AS priority, coalesce(n.note, o.note) AS note, CAST(1 AS BIGINT) AS rows_after FROM old o FULL JOIN new n ON n.case_id = o.case_id""")


def q60_case_lookup_priority(spark, sf):
    """Finished cases are configured, open ones have a manifest, those between have both."""
    rows = X.cases(spark, sf)
    config = rows.where("quality != 'O'").select("case_id", F.lit("config").alias("origin"), "quality")
    manifests = rows.where("quality != 'F'").select("case_id", F.lit("manifest").alias("origin"), F.lower("quality").alias("quality"))
    return joins.first_of([config, manifests], "case_id", ["origin", "quality"])


Q60 = q(CASE, "SELECT case_id, CASE WHEN quality <> 'O' THEN 'config' ELSE 'manifest' END AS origin, CASE WHEN quality <> 'O' THEN quality ELSE lower(quality) END AS quality, CASE WHEN quality <> 'O' THEN 0 ELSE 1 END AS source_rank FROM cases")


def q62_clip_variants(spark, sf):
    rows = X.boxes(spark, sf)
    moved, cut = G.shift_inside(box(), X.WIDTH, X.HEIGHT), G.clamp_or_null(box(), X.WIDTH, X.HEIGHT)
    shown = [F.bround(c * F.lit(0.75)).cast("int") for c in box()]
    return rows.withColumn("cut", cut).select("frame", "n", *named(moved, "moved_"), *[F.col(f"cut.{c}").alias("cut_" + c) for c in XYWH], *named(shown, "shown_"))


Q62 = q(BOX, """
, m AS (SELECT *, greatest(8, least(w, 640)) AS mw, greatest(8, least(h, 360)) AS mh, greatest(0, x) AS x0, greatest(0, y) AS y0, least(640, x + w) AS x1, least(360, y + h) AS y1 FROM box)
SELECT frame, n, greatest(0, least(640 - mw, x)) AS moved_x, greatest(0, least(360 - mh, y)) AS moved_y, mw AS moved_w, mh AS moved_h, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END AS cut_x, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END AS cut_y, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 - x0 END AS cut_w, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 - y0 END AS cut_h,
  CAST(round_even(x * 0.75, 0) AS INTEGER) AS shown_x, CAST(round_even(y * 0.75, 0) AS INTEGER) AS shown_y, CAST(round_even(w * 0.75, 0) AS INTEGER) AS shown_w, CAST(round_even(h * 0.75, 0) AS INTEGER) AS shown_h FROM m""")


def q63_hud_rule_cascade(spark, sf):
    rows = X.boxes(spark, sf)
    cx, cy = G.centre(box())
    rows = rows.withColumns({"hud": rules.hud_overlap(cx, cy, *box(), X.WIDTH, X.HEIGHT), "line": rules.line_score(F.col("w"), F.col("h"), (F.col("frame") % 30) / 100), "jump": F.hypot(cx - 320, cy - 180), "edge": G.edge_artifact(box(), X.WIDTH, X.HEIGHT)})
    score = F.greatest(F.col("hud") * 0.85, F.col("line"))
    reason = (
        F.when((F.col("jump") > 89.6) & (F.col("hud") > 0.45), "drift_to_hud_jump").when(F.col("jump") > 112.0 * 2, "candidate_jump_too_large").when((F.col("w") * F.col("h") < 100) | (F.col("w") * F.col("h") > 1600), "size_drift")
        .when(score >= 0.8, F.when(F.col("hud") >= F.col("line"), "reticle_hud_overlap").otherwise("thin_linear_shape")).otherwise("accepted_candidate")
    )
    return rows.select("edge", reason.alias("reason"), "hud", score.alias("score")).groupBy("edge", "reason").agg(F.count("*").alias("n"), F.round(F.avg("hud"), 6).alias("mean_hud"), F.round(F.max("score"), 6).alias("max_score"))


Q63 = q(BOX, """
, g AS (SELECT *, x + w / 2.0 AS cx, y + h / 2.0 AS cy, w / greatest(1, h) AS aspect, (frame % 30) / 100 AS edges, w * h / 230400.0 AS share FROM box),
s AS (SELECT *, greatest(greatest(0.0, 1 - sqrt((cx - 320) * (cx - 320) + (cy - 180) * (cy - 180)) / sqrt(640 * 640 + 360 * 360) / 0.16), CASE WHEN abs(cx - 320) < 22.4 OR abs(cy - 180) < 12.6 THEN 0.65 ELSE 0.0 END, CASE WHEN x < 22.4 OR y < 12.6 OR x + w > 617.6 OR y + h > 347.4 THEN 0.75 ELSE 0.0 END) AS hud,
  greatest(CASE WHEN aspect > 5.5 OR aspect < 0.18 THEN 0.78 ELSE 0.0 END, CASE WHEN edges > 0.18 AND (aspect > 3 OR aspect < 0.33) THEN least(1.0, edges * 3) ELSE 0.0 END) AS line, sqrt((cx - 320) * (cx - 320) + (cy - 180) * (cy - 180)) AS jump,
  w * h < 12 OR share > 0.18 OR w > 416 OR h > 234 OR ((x <= 16 OR y <= 9 OR x + w >= 624 OR y + h >= 351) AND share < 0.0003) AS edge FROM g),
r AS (SELECT *, greatest(hud * 0.85, line) AS score FROM s)
SELECT edge, CASE WHEN jump > 89.6 AND hud > 0.45 THEN 'drift_to_hud_jump' WHEN jump > 224.0 THEN 'candidate_jump_too_large' WHEN w * h < 100 OR w * h > 1600 THEN 'size_drift' WHEN score >= 0.8 THEN CASE WHEN hud >= line THEN 'reticle_hud_overlap' ELSE 'thin_linear_shape' END ELSE 'accepted_candidate' END AS reason,
  count(*) AS n, round(avg(hud), 6) AS mean_hud, round(max(score), 6) AS max_score FROM r GROUP BY 1, 2""")


def q64_roi_resolution(spark, sf):
    manual = (F.col("w") > 0) & (F.col("h") > 0) & ~F.col("returned")
    rows = X.boxes(spark, sf)
    mode = F.when(manual, "manual").when(F.col("x") % 2 == 0, "auto_brightness").otherwise("manual_review_required")
    infra = F.when(F.concat(F.lit("clip_"), F.col("frame").cast("string"), F.when(F.col("frame") % 7 == 0, "_thermal").otherwise("")).rlike("flir|thermal|infrared"), "true_ir_unknown_calibration").when(F.abs(F.col("x") - F.col("y")) < 4, "true_ir_unknown_calibration").otherwise("pseudo_intensity_only")
    found = rows.select(mode.alias("mode"), infra.alias("ir_mode"), (F.col("n") > 4).alias("confident"))
    return found.groupBy("mode", "ir_mode", "confident").agg(F.count("*").alias("n"))


Q64 = q(BOX, """SELECT CASE WHEN w > 0 AND h > 0 AND NOT returned THEN 'manual' WHEN x % 2 = 0 THEN 'auto_brightness' ELSE 'manual_review_required' END AS mode, CASE WHEN frame % 7 = 0 OR abs(x - y) < 4 THEN 'true_ir_unknown_calibration' ELSE 'pseudo_intensity_only' END AS ir_mode, n > 4 AS confident, count(*) AS n FROM box GROUP BY 1, 2, 3""")


def q65_case_gates(spark, sf):
    k = F.col("case_id")
    decision = F.when(k % 3 == 0, "accept").when(k % 3 == 1, "reject")
    rows = X.modules(spark, sf).withColumn("decision", decision)
    gates = {"has_track": F.col("n").isNotNull(), "has_motion": F.col("motion").isNotNull(), "validated": F.coalesce(F.col("decision") == "accept", F.lit(False)), "can_report": F.col("n").isNotNull() & F.coalesce(F.col("decision") == "accept", F.lit(False))}
    review = F.when(~gates["has_track"], "needs_track").when(F.col("decision").isNull(), "needs_decision").when(gates["validated"], "ready").otherwise("rejected")
    return rows.select(review.alias("review"), *[v.alias(n) for n, v in gates.items()]).groupBy("review").agg(F.count("*").alias("n"), *[F.count_if(g).alias(g) for g in gates])


Q65 = q(MODULE, """
, d AS (SELECT *, CASE case_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' END AS decision FROM module)
SELECT CASE WHEN n IS NULL THEN 'needs_track' WHEN decision IS NULL THEN 'needs_decision' WHEN decision = 'accept' THEN 'ready' ELSE 'rejected' END AS review, count(*) AS n, count(*) FILTER (n IS NOT NULL) AS has_track, count(*) FILTER (motion IS NOT NULL) AS has_motion, count(*) FILTER (decision = 'accept') AS validated, count(*) FILTER (n IS NOT NULL AND decision = 'accept') AS can_report FROM d GROUP BY 1""")


def q70_ranked_picks(spark, sf):
    rows = judged(X.candidates(spark, sf)).withColumn("weight", (F.col("luminance") + 3) * F.sqrt(F.greatest(F.col("texture"), F.lit(1.0))))
    best = sampling.top(rows, 3, "frame", F.desc("weight"), F.col("ord"))
    return best.select("frame", F.col("rank"), F.col("ord.l_partkey").alias("partkey"), F.round("weight", 4).alias("weight"))


Q70 = q(JUDGED, "SELECT frame, rank, ord[2] AS partkey, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY weight DESC, ord) AS rank FROM (SELECT *, (luminance + 3) * sqrt(greatest(texture, 1.0)) AS weight FROM judged)) WHERE rank <= 3").replace("rank,", "CAST(rank AS INTEGER) AS rank,", 1)


def q79_report_rows(spark, sf):
    s = F.col("status")
    rows = statuses(spark, sf).select("case_id", F.explode(F.map_entries(s)).alias("e"))
    row = F.concat(F.lit("| "), F.col("e.key"), F.lit(" | "), F.col("e.value"), F.lit(" |"))
    table = rows.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("table"))
    return table.withColumn("title", F.concat(F.lit("case_"), F.lpad(F.col("case_id").cast("string"), 6, "0")))


Q79 = q(STATUS, "SELECT case_id, string_agg('| ' || module || ' | ' || strength || ' |', chr(10) ORDER BY '| ' || module || ' | ' || strength || ' |') AS \"table\", 'case_' || lpad(CAST(case_id AS VARCHAR), 6, '0') AS title FROM long_ GROUP BY case_id")

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()}
ORACLE_SQL = {k: globals()["Q" + k[1:3]] for k in QUERIES}
