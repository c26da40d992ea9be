"""Readers: media listings, ROI tables, JSON documents and text lines, by Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions.geometry import normalized
from trackweave.functions.numbers import fourcc

#: Extensions of media files; the import list has no m4v.
MEDIA = ("mp4", "mov", "mkv", "avi", "webm", "m4v")
IMPORTED = tuple(e for e in MEDIA if e != "m4v")
ROI_SCHEMA = "frame string, status string, bbox_x string, bbox_y string, bbox_w string, bbox_h string, expanded_x string, expanded_y string, expanded_w string, expanded_h string, centroid_x string, centroid_y string, area string, confidence string"
TRACK_SCHEMA = "case_id string, backend_used string, track array<struct<frame:int,bbox:struct<x:int,y:int,w:int,h:int>,bbox_xywh:array<int>,centroid:array<double>,confidence:double,status:string>>, summary map<string,double>, video struct<path:string,fps:double,frame_count:int,width:int,height:int>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_files(spark: SparkSession, folder: str, allowed: tuple[str, ...] = MEDIA) -> DataFrame:
    """(path, size_bytes, modified) of the media files below a folder, any case of the extension; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")).where(extension(F.col("path")).isin(*allowed))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below a folder."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def permissive_int(text: Column) -> Column:
    """Whole number of a text such as '12' or '12.7' (cut, not rounded); blank and broken text is null."""
    return text.try_cast("double").cast("int")


def roi_table(spark: SparkSession, path: str) -> DataFrame:
    """ROI rows of CSV files by header name; blanks are null, numbers are read permissively, columns not known are ignored."""
    raw = spark.read.option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)
    names = [c.split()[0] for c in ROI_SCHEMA.split(", ")]
    have = raw.select(*[F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names])
    ints = [n for n in names if n not in ("status", "centroid_x", "centroid_y", "confidence")]
    return have.select(*[permissive_int(F.col(n)).alias(n) if n in ints else F.col(n) if n == "status" else F.col(n).try_cast("double").alias(n) for n in names])


def last_by_frame(rois: DataFrame, order: str) -> DataFrame:
    """One row a frame, the last in ``order``."""
    rest = [c for c in rois.columns if c != "frame"]
    return rois.groupBy("frame").agg(F.max_by(F.struct(*rest), order).alias("r")).select("frame", *[F.col(f"r.{c}").alias(c) for c in rest])


def track_points(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, frame, status, confidence, x, y, w, h, cx, cy) of track documents, one JSON document a file; boxes as struct or list."""
    docs = spark.read.schema(TRACK_SCHEMA).option("multiLine", True).json(path)
    rows = docs.select("case_id", F.explode("track").alias("t")).select("case_id", "t.*", normalized(F.col("t.bbox"), F.col("t.bbox_xywh")).alias("box"))
    return rows.select("case_id", "frame", "status", "confidence", "box.x", "box.y", "box.w", "box.h", F.get("centroid", F.lit(0)).alias("cx"), F.get("centroid", F.lit(1)).alias("cy"))


def tolerant_documents(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``doc`` (variant) and ``error``: a missing text is an empty document, a broken one an error."""
    text = F.coalesce(F.col(column), F.lit("{}"))
    return lines.withColumn("doc", F.try_parse_json(text)).withColumn("error", F.when(F.col("doc").isNull(), F.lit("invalid JSON")))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, numbered from 1 within each file, whatever their size: a file may be read in many splits.

    A task counts the lines of each split as it reads them in order; the splits' counts, a row each, are summed up before each other split of
    the file, and those sums are added. Lines end as Spark's text reader ends them.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = None, 0
        for b in batches:
            names, starts, no = b.column(0), b.column(1).to_numpy(), np.empty(len(b), np.int64)
            codes = names.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(b)]):
                if hi == lo:
                    continue
                own = (names[lo].as_py(), int(starts[lo]))
                seen = seen if own == split else 0
                no[lo:hi] = np.arange(seen + 1, seen + 1 + hi - lo)
                split, seen = own, seen + hi - lo
            yield pa.RecordBatch.from_arrays([names, b.column(1), pa.array(no), b.column(2)], names=["path", "at", "no", "value"])

    numbered = raw.mapInArrow(number, "path string, at long, no long, value string")
    counts = raw.groupBy("path", "at").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("path", "at", before.alias("before"))
    return numbered.join(starts, ["path", "at"]).select("path", (F.col("before") + F.col("no")).alias("line_no"), F.col("value").alias("line"))


def stream_facts(probe: Column) -> Column:
    """struct(codec, audio, bit_rate) of a probe document: first video stream's codec, any audio stream, the format's bit rate."""
    streams = F.from_json(F.get_json_object(probe, "$.streams"), "array<struct<codec_type:string,codec_name:string>>")
    video = F.filter(streams, lambda s: s["codec_type"] == "video")
    return F.struct(F.get(video, F.lit(0))["codec_name"].alias("codec"), F.coalesce(F.exists(streams, lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("audio"), F.get_json_object(probe, "$.format.bit_rate").alias("bit_rate"))


def frame_facts(probed: DataFrame) -> DataFrame:
    """Adds codec (four letters), fps, and duration (frames over fps) to (path, fps, frames, width, height, code); without a rate there is no duration."""
    rate = F.when(F.col("fps") > 0, F.col("fps"))
    return probed.withColumns({"codec": fourcc(F.col("code")), "fps": F.coalesce(rate, F.lit(0.0)), "duration": F.col("frames") / rate})


def case_configs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(case_id, …) of the JSON configurations below a folder, one a file; one that does not name its case is named by its file."""
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return read.withColumn("case_id", F.coalesce("case_id", stem))


def artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, kind, path, size_bytes): files below folder/<case>/…, kind the folder below the case's or '' for files of its own; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.lit(folder.rstrip("/").rsplit("/", 1)[-1])
    parts = F.split(F.element_at(F.split("path", F.concat(F.lit("/"), F.regexp_replace(root, r"([^A-Za-z0-9_])", r"\\$1"), F.lit("/"))), -1), "/")
    return listed.select(F.element_at(parts, 1).alias("case_id"), F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise("").alias("kind"), "path", F.col("length").alias("size_bytes")).where(F.size(parts) > 1)


def case_ids(artefacts: DataFrame) -> DataFrame:
    """The cases there are, in order."""
    return artefacts.select("case_id").distinct().orderBy("case_id")
