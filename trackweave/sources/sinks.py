"""Sinks: fixed-column tables, versioned documents and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of the per-frame tables, in file order.
MOTION_COLUMNS = ["frame", "timestamp", "centroid_x", "centroid_y", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "bbox_area", "velocity_px_per_frame", "acceleration_px_per_frame2", "frame_diff_mean", "optical_flow_mean", "optical_flow_max", "track_status"]
ROI_COLUMNS = ["frame", "status", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "expanded_x", "expanded_y", "expanded_w", "expanded_h", "centroid_x", "centroid_y", "area", "confidence"]

CENTROID_COLUMNS = ["frame", "centroid_x", "centroid_y", "status", "confidence"]
REJECTION_COLUMNS = ["frame", "candidate_x", "candidate_y", "candidate_w", "candidate_h", "overlap_with_object_bbox", "artifact_mask_ratio", "black_block_ratio", "cyan_hud_ratio", "edge_distance_score", "texture_score", "luminance_mean", "luminance_std", "valid_for_background", "rejection_reason"]
VARIANCE_COLUMNS = ["component", "explained_variance_ratio", "cumulative_variance_ratio"]


def centroid_table(track: DataFrame) -> DataFrame:
    """The centroids of a track under their file's columns."""
    return track.select("case_id", "frame", F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), "status", "confidence")


def rejection_table(candidates: DataFrame) -> DataFrame:
    """Measured control candidates (operators.controls) under their file's columns, reasons joined by semicolons."""
    names = {"overlap": "overlap_with_object_bbox", "artifact_ratio": "artifact_mask_ratio", "black": "black_block_ratio", "cyan": "cyan_hud_ratio", "edge_score": "edge_distance_score", "texture": "texture_score", "luminance": "luminance_mean"}
    own = {f"candidate_{c}": F.col(c) for c in "xywh"} | {to: F.col(c) for c, to in names.items()} | {"luminance_std": F.col("texture"), "valid_for_background": F.size("reasons") == 0, "rejection_reason": F.array_join("reasons", ";")}
    return candidates.select("case_id", "frame", *[c.alias(n) for n, c in own.items()])


def score_table(scored: DataFrame, keep: list[str], dims: int = 2) -> DataFrame:
    """Rows with their first scores as columns pc1, pc2 ..., blank where there are fewer."""
    return scored.select(*keep, *[F.get("scores", F.lit(k)).alias(f"pc{k + 1}") for k in range(dims)])


def variance_table(shares: DataFrame) -> DataFrame:
    return shares.select(*[c for c in shares.columns if c == "case_id"], "component", F.col("ratio").alias("explained_variance_ratio"), F.col("cumulative").alias("cumulative_variance_ratio"))


def backfilled(existing: DataFrame, cases: DataFrame, defaults: dict, key: str = "case_id") -> DataFrame:
    """The records of all ``cases``: those there are, with defaults where they have nulls or lack a column, and new ones of defaults alone."""
    rows = cases.select(key).distinct().join(existing, key, "full_outer")
    return with_defaults(rows, defaults)


def motion_table(df: DataFrame) -> DataFrame:
    """The motion series under its file's columns; those a frame has not are blank."""
    names = {"cx": "centroid_x", "cy": "centroid_y", "x": "bbox_x", "y": "bbox_y", "w": "bbox_w", "h": "bbox_h", "velocity": "velocity_px_per_frame", "acceleration": "acceleration_px_per_frame2", "status": "track_status"}
    rows = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    if {"bbox_w", "bbox_h"} <= set(rows.columns):
        rows = rows.withColumn("bbox_area", F.col("bbox_w") * F.col("bbox_h"))
    return rows.select("case_id", *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in MOTION_COLUMNS])


def write_table(df: DataFrame, path: str, columns: list[str], by: str = "case_id") -> None:
    """CSV files of fixed columns, a folder for each case; missing columns and nulls are blank."""
    shown = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(by, *shown).write.mode("overwrite").partitionBy(by).option("header", True).option("nullValue", "").csv(path)


def write_documents(df: DataFrame, path: str, by: str = "case_id") -> None:
    """A JSON document for each row, nulls written out, in a folder for each case."""
    rest = [c for c in df.columns if c != by]
    doc = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    df.select(by, doc.alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def flat_boxes(df: DataFrame, *boxes: str) -> DataFrame:
    """Struct boxes as columns name_x .. name_h."""
    for b in boxes:
        df = df.withColumns({f"{b}_{c}": F.col(f"{b}.{c}") for c in "xywh"}).drop(b)
    return df


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Write a version beside the older ones, which stay; writing a version again replaces that one alone."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_latest(spark, path: str) -> DataFrame:
    """The rows of the highest version; partition pruning reads no other."""
    rows = spark.read.parquet(path)
    latest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == F.lit(latest)).drop("version")


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, after the existing ones."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Missing columns and nulls take their default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row): one table line for each row, doubles with six significant digits, nulls empty."""
    kinds = dict(df.dtypes)
    shown = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.6g", F.col(c))) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("row"))


def public_fields(df: DataFrame, blocked: list[str], renamed: dict[str, str]) -> DataFrame:
    """Without private columns, and ambiguous ones under their public names."""
    return df.drop(*blocked).withColumnsRenamed(renamed)


def tile_layout(df: DataFrame, order: str, columns: int) -> DataFrame:
    """Adds row and column of each tile of a contact sheet, in order."""
    at = F.row_number().over(Window.partitionBy("case_id").orderBy(order)) - 1
    return df.withColumn("tile_row", F.floor(at / columns)).withColumn("tile_column", at % columns)
