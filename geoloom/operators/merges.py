"""Blocks solved on their own, assembled in one frame.

A block (block, ordinal, m0 .. m8, scale, tx, ty, tz) has the rotation (by rows), scale
and shift into the common frame. Rows keep the order of blocks, then of their own ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.control import _finite
from geoloom.operators.sampling import running_total

MATRIX = tuple(f"m{k}" for k in range(9))
SHIFT = ("tx", "ty", "tz")


def merge_problems(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(block, camera, problem) of blocks and their images (block, camera): transforms that are
    not finite or have no positive scale, blocks without images, images without a block, and
    cameras that more than one image or block holds."""
    none = F.lit(None).cast(images.schema["camera"].dataType)
    bad = ~_finite(*MATRIX, "scale", *SHIFT) | (F.col("scale") <= 0)
    out = blocks.where(bad).select("block", none.alias("camera"), F.lit("transform").alias("problem"))
    empty = blocks.join(images.select("block").distinct(), "block", "left_anti").select("block", none.alias("camera"), F.lit("no images").alias("problem"))
    stray = images.join(blocks.select("block"), "block", "left_anti").select("block", "camera", F.lit("no block").alias("problem"))
    shared = images.groupBy("camera").agg(F.count("*").alias("n"), F.min("block").alias("block")).where("n > 1").select("block", "camera", F.lit("overlap").alias("problem"))
    return out.unionByName(empty).unionByName(stray).unionByName(shared).distinct()


def renumbered(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` (block, id, ...) with ``merged``, a number from 1 over all blocks."""
    placed = rows.join(blocks.select("block", "ordinal"), "block").withColumn("_one", F.lit(1).cast("long"))
    return running_total(placed, ["ordinal", "id"], "_one", "merged").drop("_one", "ordinal")


def merged_points(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """``points`` (block, id, x, y, z) in the common frame, with ``merged``."""
    placed = points.join(blocks.drop("ordinal"), "block")
    world = {}
    for k, axis in enumerate("xyz"):
        turned = F.col(f"m{3 * k}") * F.col("x") + F.col(f"m{3 * k + 1}") * F.col("y") + F.col(f"m{3 * k + 2}") * F.col("z")
        world[axis] = F.col("scale") * turned + F.col(SHIFT[k])
    return renumbered(placed.withColumns(world).drop(*MATRIX, "scale", *SHIFT), blocks)


def merged_observations(observations: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """(block, image, point, merged_image, merged_point, problem) of observations (block, image,
    point) and renumbered images and points. A null point stays null; an image or a point
    that is not in the block is a problem."""
    i = images.select("block", F.col("id").alias("image"), F.col("merged").alias("merged_image"))
    p = points.select("block", F.col("id").alias("point"), F.col("merged").alias("merged_point"))
    problem = F.when(F.col("merged_image").isNull(), "image").when(F.col("point").isNotNull() & F.col("merged_point").isNull(), "point")
    return observations.join(i, ["block", "image"], "left").join(p, ["block", "point"], "left").select("block", "image", "point", "merged_image", "merged_point", problem.alias("problem"))
