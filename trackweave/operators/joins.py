"""Joins that a plain equality cannot say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import geometry as G


def nearest_frame(probes: DataFrame, rows: DataFrame, tolerance: int, keep: list[str]) -> DataFrame:
    """Each probe (case_id, frame) with the row of its case nearest in frame, within ``tolerance``; earlier frame on ties.

    Rows are found through frame buckets of the tolerance's width, so the join has equality keys that
    spread a long case; a probe without a row near keeps nulls. Columns ``keep`` come from the row, of rows of one frame any.
    It is the rows that stand in three buckets each; probes, of which there may be far more, are neither multiplied nor sent
    along whole: they are the outer side of the join, each meets one list of the rows of a bucket, and are dealt once.
    """
    width = max(1, tolerance)
    buckets = F.explode(F.array(*[F.floor(F.col("near_frame") / width) + d for d in (-1, 0, 1)]))
    r = rows.groupBy("case_id", F.col("frame").alias("near_frame")).agg(F.any_value(F.struct(*keep)).alias("row"))
    lists = r.select("case_id", buckets.alias("_bucket"), F.struct("near_frame", "row").alias("r")).groupBy("case_id", "_bucket").agg(F.collect_list("r").alias("_near"))
    met = probes.withColumn("_bucket", F.floor(F.col("frame") / width)).join(lists, ["case_id", "_bucket"], "left")
    away = lambda r: F.abs(r["near_frame"] - F.col("frame"))
    best = F.array_min(F.transform(F.filter("_near", lambda r: away(r) <= tolerance), lambda r: F.struct(away(r).alias("gap"), r["near_frame"].alias("near_frame"), r["row"].alias("row"))))
    found = met.withColumn("_best", best)
    return found.select(*[F.col(c) for c in probes.columns], F.col("_best.near_frame").alias("near_frame"), *[F.col(f"_best.row.{c}").alias(c) for c in keep])


def hinted(hints: DataFrame, rows: DataFrame, reach: int = 12) -> DataFrame:
    """Each hint (case_id, hint_frame, hx, hy, hw, hh) with its case's best box within ``reach`` frames.

    Score: the larger of IoU and 0.65 / (1 + centre distance / 80), less 0.01 a frame; only positive scores match,
    the smaller gap and then the earlier frame win ties.
    """
    a, b = tuple(F.col(c) for c in "xywh"), tuple(F.col("h" + c) for c in "xywh")
    (ax, ay), (bx, by) = G.centre(a), G.centre(b)
    gap = F.abs(F.col("frame") - F.col("hint_frame"))
    score = F.greatest(G.iou(a, b), F.lit(0.65) / (1 + F.hypot(ax - bx, ay - by) / 80)) - gap * 0.01
    width = max(1, reach)
    asked = hints.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("hint_frame") / width) + d for d in (-1, 0, 1)])))
    both = rows.withColumn("bucket", F.floor(F.col("frame") / width)).join(asked, ["case_id", "bucket"]).where(gap <= reach).withColumn("score", score).where("score > 0")
    return both.groupBy("case_id", "hint_frame").agg(F.max_by(F.struct("frame", "score"), F.struct("score", -gap, -F.col("frame"))).alias("b")).select("case_id", "hint_frame", "b.frame", "b.score")


def overlapping(a: DataFrame, b: DataFrame, key: str, size: int = 64) -> DataFrame:
    """Pairs of boxes (columns id, x, y, w, h) of equal ``key`` that intersect, through shared grid cells.

    A pair is made in the cell that holds the corner of its intersection alone, so no distinct is needed.
    """
    cells = lambda df, p: df.select(key, *[F.col(c).alias(p + c) for c in ("id", *"xywh")], F.explode(G.grid_cells(tuple(F.col(c) for c in "xywh"), size)).alias("cell"))
    both = cells(a, "a_").join(cells(b, "b_"), [key, "cell"])
    ab, bb = tuple(F.col("a_" + c) for c in "xywh"), tuple(F.col("b_" + c) for c in "xywh")
    first = (F.floor(F.greatest(ab[0], bb[0]) / size) == F.col("cell.i")) & (F.floor(F.greatest(ab[1], bb[1]) / size) == F.col("cell.j"))
    return both.where((G.intersection(ab, bb) > 0) & first).drop("cell")


def overlay(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Both sides by key; a column of ``second`` wins where it is not null."""
    a, b = first.select(key, *columns), second.select(key, *[F.col(c).alias("_" + c) for c in columns])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce("_" + c, c).alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Shallow merge of documents by key, the new value of a column winning where there is one."""
    return overlay(old, new, key, columns)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of ``new``, and the old rows whose key it does not have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_of(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """One row a key from the first source that has it; of several rows there, the least."""
    ranked = [s.select(key, F.lit(i).alias("_rank"), *columns) for i, s in enumerate(sources)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    best = rows.groupBy(key).agg(F.min(F.struct("_rank", *columns)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}") for c in columns], F.col("b._rank").alias("source_rank"))


def gate(df: DataFrame, validations: DataFrame, *flags: str) -> DataFrame:
    """Rows of cases whose validation has every flag true; undecided (null) does not pass."""
    passing = validations
    for f in flags:
        passing = passing.where(F.col(f))
    return df.join(passing.select("case_id").distinct(), "case_id", "left_semi")


def least_by(value: Column, *tie: Column) -> Column:
    return F.struct(value, *tie)


#: Documents of a case's record, in order. Fixed values.
CASE_DOCUMENTS = ("case_status", "batch_source", "track", "tracking_quality", "validation", "motion", "spectral", "thermal", "srv", "srv_core", "controls", "pca", "autoencoder")


def assembled(cases: DataFrame, documents: dict[str, DataFrame], key: str = "case_id") -> DataFrame:
    """``cases`` with a struct column for each of ``documents`` (key, …), null where a case has none, and ``present``, the names of those it has.

    Every document table has one row a case at most. They are put below each other and gathered by one aggregation, so a task sorts at most a few
    tables, not two for each document.
    """
    own = {n: [c for c in part.columns if c != key] for n, part in documents.items()}
    types = {n: dict(part.dtypes) for n, part in documents.items()}
    blank = lambda n, c: F.lit(None).cast(types[n][c]).alias(f"{n}.{c}")
    tall = None
    for i, (name, part) in enumerate(documents.items()):
        rows = part.select(F.col(key), F.lit(i).alias("_document"), *[F.col(c).alias(f"{n}.{c}") if n == name else blank(n, c) for n in documents for c in own[n]])
        tall = rows if tall is None else tall.union(rows)
    if tall is not None:
        gathered = tall.groupBy(key).agg(F.bit_or(F.lit(1).cast("long") * F.pow(F.lit(2), F.col("_document")).cast("long")).alias("_has"), *[F.any_value(f"`{n}.{c}`", F.lit(True)).alias(f"{n}.{c}") for n in documents for c in own[n]])
        held = [F.when(F.col("_has").bitwiseAND(F.lit(1 << i)) != 0, F.struct(*[F.col(f"`{n}.{c}`").alias(c) for c in own[n]])).alias(n) for i, n in enumerate(documents)]
        cases = cases.join(gathered.select(key, *held), key, "left")
    return cases.withColumn("present", F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in documents])))


def with_regions(errors: DataFrame, rois: DataFrame) -> DataFrame:
    """Errors (case_id, frame, class_label, …) with their frame's box, blank without one, and the track's status for objects alone.

    A null frame has no box. An object without one counts as tracked.
    """
    boxes = rois.select("case_id", "frame", *[F.col(c).alias(f"bbox_{c}") for c in "xywh"], F.col("status").alias("roi_status"))
    joined = errors.join(boxes, ["case_id", "frame"], "left")
    status = F.when(F.col("class_label") == "object", F.coalesce("roi_status", F.lit("TRACKING_ACTIVE"))).otherwise("")
    return joined.withColumn("track_status", status).drop("roi_status")


def with_manifest(triage: DataFrame, manifest: DataFrame, key: str = "case_id") -> DataFrame:
    """Triage rows of cases that the manifest names, with its columns; those that both have come from the triage."""
    return triage.join(manifest.drop(*[c for c in manifest.columns if c in triage.columns and c != key]), key)
