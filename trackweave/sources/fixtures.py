"""Adapters: the driver's tables as tracks, series, crops, boxes and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types as track states.
STATES = {"view": "tracked", "click": "TRACKING_ACTIVE", "purchase": "auto_recovered", "signup": "LOW_CONFIDENCE", "error": "TRACK_LOST"}
VALID_STATES = ("TRACKING_ACTIVE", "TRACKING ACTIVE", "tracked", "auto_recovered")
LOST_STATES = ("TRACK_LOST", "TRACK LOST", "LOW_CONFIDENCE")
CLASSES = ["object", "near_background", "far_background", "compression_noise", "random_background", "hud_artifact", "dark_region", "bright_region"]
WIDTH, HEIGHT = 640, 360


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, frame, cx, cy, status, confidence, x, y, w, h): one row per case and frame, the first event of a minute."""
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 60000000).cast("long")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), minute.alias("frame"), "event_id", "value", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    rows = rows.groupBy("case_id", "frame").agg(F.min_by(F.struct("value", "event_type", "k"), "event_id").alias("e"))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("e.event_type"))
    k = F.col("e.k")
    return rows.select("case_id", "frame", F.col("e.value").alias("cx"), k.cast("double").alias("cy"), status.alias("status"), (1 - F.least(F.col("e.value"), F.lit(500.0)) / 500).alias("confidence"), F.floor("e.value").cast("int").alias("x"), k.alias("y"), (8 + k % 24).alias("w"), (6 + k % 18).alias("h"))


def valid_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).where(F.col("status").isin(*VALID_STATES))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, frame, class_label, v): 8 x 8 crops; labels past the classes are null."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    return read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("case_id"), F.col("vec_id").alias("frame"), F.get(names, F.col("label")).alias("class_label"), F.col("embedding").cast("array<double>").alias("v"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, ord, overlap, artifact_ratio, edge_score, texture, luminance): ord is the full tie-break of a frame's candidates."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("string").alias("shipped"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), order.alias("ord"), (F.col("l_tax") / 2).alias("overlap"), (F.col("l_discount") / 10).alias("artifact_ratio"),
        ((F.col("l_partkey") % 100) / 100).alias("edge_score"), (F.col("l_extendedprice") / 2000).alias("texture"), (F.col("l_quantity") * 5).alias("luminance"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, n, x, y, w, h, returned): boxes that may lie over the frame's edges."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % WIDTH - 20).cast("int").alias("x"), (F.col("l_suppkey") % HEIGHT - 20).cast("int").alias("y"),
        F.col("l_quantity").cast("int").alias("w"), (F.col("l_linenumber") * 8).cast("int").alias("h"), (F.col("l_returnflag") == "R").alias("returned"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, duration, width, height, quality, hint, motion, saturated, contrast) from orders."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_totalprice") / 10000).alias("duration"), (k % 5 * 320).cast("int").alias("width"), (k % 4 * 180).cast("int").alias("height"), F.col("o_orderstatus").alias("quality"),
        F.col("o_orderpriority").alias("hint"), (k % 30).cast("double").alias("motion"), (F.col("o_orderkey") % 25 / F.lit(100.0)).alias("saturated"), (F.col("o_orderkey") % 50).cast("double").alias("contrast"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line), numbered from 1."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, motion, stability, spectral, thermal, controls, pca, anomaly, max_z): module scores of customers, null without orders."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 101).alias("s"), F.max(F.col("o_orderkey") % 97).alias("m"))
    share = lambda a, b: (F.col(a) % b) / F.lit(float(b - 1))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")).join(o, F.col("case_id") == F.col("o_custkey"), "left").select(
        "case_id", "n", share("s", 11).alias("motion"), share("s", 7).alias("stability"), share("m", 13).alias("spectral"), (share("s", 17) / 5).alias("thermal"),
        share("m", 19).alias("controls"), share("s", 23).alias("pca"), share("m", 29).alias("anomaly"), (F.col("m") % 6).cast("double").alias("max_z"),
    )


#: Blocks of a frame along each axis, and pixels of a block along each axis.
BLOCKS, BLOCK = 5, 8


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, frame, height, width, blue, green, red): colour frames put together from embeddings, 25 blocks of 8 x 8 pixels each.

    A block's three base colours are the means of three parts of its vector, its 64 texture values the components; whole numbers throughout.
    """
    side, n = BLOCKS * BLOCK, BLOCKS * BLOCKS
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10000 + 0.5))
    v = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / n).alias("frame"), (F.col("vec_id") % n).cast("int").alias("block"), whole.alias("v"))
    base = [F.floor(F.aggregate(F.slice("v", 21 * k + 1, 21), F.lit(0).cast("long"), lambda a, x: a + x) * 4000 / F.lit(210000.0)) for k in range(3)]
    plane = lambda b: F.transform("v", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), 128 + b + F.floor(x * 150 / F.lit(10000.0)))).cast("int"))
    tiles = v.select("frame", "block", *[plane(b).alias(name) for b, name in zip(base, ("blue", "green", "red"))])
    held = tiles.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct("blue", "green", "red")))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(side * side - 1))

    def laid(name):
        def pixel(i):
            y, x = F.floor(i / side).cast("int"), i % side
            block, inside = F.floor(y / BLOCK).cast("int") * BLOCKS + F.floor(x / BLOCK).cast("int"), (y % BLOCK) * BLOCK + x % BLOCK
            return F.coalesce(F.get(F.element_at("m", block)[name], inside), F.lit(0))

        return F.transform(at, pixel).alias(name)

    return held.select((F.col("frame") % 3).alias("case_id"), "frame", F.lit(side).alias("height"), F.lit(side).alias("width"), laid("blue"), laid("green"), laid("red"))
