"""Writers: derived datasets whose manifest is written last."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import batch, stats


def publish(df: DataFrame, root: str, key: str, recipe: dict, source: str) -> str:
    """Writes a dataset under its content id and returns the id.

    Data are committed first, the manifest row (recipe, source, rows,
    fingerprint) after, so a dataset without a manifest is unfinished. The id
    depends on recipe, source and members, so publishing again replaces equal
    content by itself.
    """
    told = stats.fingerprint(df, key).first()
    dataset = hashlib.sha256(batch.canonical([recipe, source, told["n"], told["fingerprint"]]).encode()).hexdigest()
    df.write.mode("overwrite").parquet(f"{root}/{dataset}/data")
    row = [(dataset, batch.canonical(recipe), source, told["n"], told["fingerprint"])]
    df.sparkSession.createDataFrame(row, "dataset string, recipe string, source string, n long, fingerprint string").write.mode("overwrite").parquet(f"{root}/{dataset}/manifest")
    return dataset


def quantised(points: DataFrame, step: float = 0.001) -> DataFrame:
    """Adds integer coordinates qx, qy, qz at a step; out of 32 bits is null."""
    q = {f"q{k}": F.round(F.col(k) / step).cast("long") for k in "xyz"}
    return points.withColumns({n: F.when(F.abs(c) < 2**31, c.cast("int")) for n, c in q.items()})


def elevation_tiles(grid: DataFrame, size: int = 512) -> DataFrame:
    """(tile_col, tile_row, n, valid, low, high) of a height grid's tiles."""
    return grid.groupBy(F.expr(f"col div {size}").alias("tile_col"), F.expr(f"row div {size}").alias("tile_row")).agg(F.count("*").alias("n"), F.count("value").alias("valid"), F.min("value").alias("low"), F.max("value").alias("high"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)
