"""Rewriting the texts inside nested documents, whatever their shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.sources.shared import Kept


def rewritten(df: DataFrame, key: str, document: str, rewrite: Callable[[Column], Column], deepest: int = 64) -> DataFrame:
    """(key, document): JSON documents with ``rewrite`` applied to each string in them, however deep, in lists and objects alike.

    Keys and other values stay; an object's members come back in order of their keys. A document is taken apart a level at a time into rows (its
    place, its value) by exploding variants, and put together from the deepest level up, each object or list a group of its own members. A text
    that is no JSON gives null; a document deeper than ``deepest`` levels fails. ``key`` must be unique.
    """
    rows = df.select(F.col(key).alias("key"), F.lit("").alias("place"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("name"), F.try_parse_json(document).alias("v"))
    levels: list[DataFrame] = []
    for depth in range(deepest + 1):
        kind, text = F.schema_of_variant("v"), F.to_json("v")
        inner = (kind.startswith("OBJECT<") | kind.startswith("ARRAY<")) & ~text.isin("{}", "[]")
        leaf = F.when(kind == "STRING", F.to_json(F.array(rewrite(F.variant_get("v", "$", "string"))))).otherwise(text)
        level = Kept(rows.select("key", "place", "pos", "name", F.coalesce(inner, F.lit(False)).alias("inner"), kind.startswith("OBJECT<").alias("object"), leaf.alias("text"), (kind == "STRING").alias("quoted"), "v"), "documents").df
        text = F.when(F.col("quoted"), F.substring("text", F.lit(2), F.length("text") - 2)).otherwise(F.col("text"))
        levels.append(level.withColumn("text", text))
        within = level.where("inner")
        if not within.limit(1).count():
            break
        if depth == deepest:
            raise ValueError(f"a document is deeper than {deepest} levels")
        within.createOrReplaceTempView("trackweave_documents")
        rows = df.sparkSession.sql("SELECT d.key, concat(d.place, '/', e.pos) AS place, e.pos, e.key AS name, e.value AS v FROM trackweave_documents d, LATERAL variant_explode(d.v) e")
    made: DataFrame | None = None
    for level in reversed(levels):
        own = level.where("not inner").select("key", "place", "pos", "name", "text")
        if made is not None:
            above = F.regexp_replace("place", "/[0-9]+$", "")
            member = F.when(F.col("name").isNotNull(), F.concat(F.expr("substring(to_json(array(name)), 2, length(to_json(array(name))) - 2)"), F.lit(":"), "text")).otherwise(F.col("text"))
            grouped = made.select("key", above.alias("place"), F.struct("pos", member.alias("m")).alias("m")).groupBy("key", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["m"]), ",").alias("members"))
            outer = level.where("inner").select("key", "place", "pos", "name", "object").join(grouped, ["key", "place"])
            whole = F.when(F.col("object"), F.concat(F.lit("{"), "members", F.lit("}"))).otherwise(F.concat(F.lit("["), "members", F.lit("]")))
            own = own.union(outer.select("key", "place", "pos", "name", whole))
        made = own
    return made.select(F.col("key").alias(key), F.col("text").alias(document))
