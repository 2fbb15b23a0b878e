"""Statistics, roll-ups and mesh aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import per_mille

#: Which components each role of a control point uses.
ROLES = {0: ("control", True, True), 1: ("control", True, False), 2: ("control", False, True), 3: ("checkpoint", True, True), 4: ("checkpoint", True, False), 5: ("checkpoint", False, True)}


def role_masked(control: DataFrame) -> DataFrame:
    """Adds ``kind`` and nulls the components that a point's role leaves unused."""
    pick = lambda k: F.coalesce(*[F.when(F.col("role") == r, F.lit(v[k])) for r, v in ROLES.items()])
    return control.withColumns({"kind": pick(0), "east": F.when(pick(1), F.col("east")), "north": F.when(pick(1), F.col("north")), "height": F.when(pick(2), F.col("height"))})


def role_statistics(residuals: DataFrame) -> DataFrame:
    """Root mean square and greatest absolute value of each component, by kind.

    A component's mean is over its own known values.
    """
    return residuals.groupBy("kind").agg(F.count("*").alias("n"), *[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}") for c in ("east", "north", "height")], *[F.max(F.abs(c)).alias(f"max_{c}") for c in ("east", "north", "height")])


def residual_report(residuals: DataFrame) -> DataFrame:
    """Root mean squares of horizontal, vertical and spatial residuals."""
    h = F.col("east") * F.col("east") + F.col("north") * F.col("north")
    v = F.col("height") * F.col("height")
    n = F.greatest(F.count("*"), F.lit(1))
    root = lambda x: F.sqrt(F.coalesce(F.sum(x), F.lit(0.0)) / n)
    return residuals.agg(F.count("*").alias("n"), root(h).alias("rms_h"), root(v).alias("rms_v"), root(h + v).alias("rms_3d"), F.max(F.sqrt(h + v)).alias("max_3d"))


def class_histogram(points: DataFrame, key: str = "cls") -> DataFrame:
    return points.groupBy(key).agg(F.count("*").alias("n"))


def footprint_statistics(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least, median, most) of positive finite values; the upper middle is the median.

    Values are first counted, so a group is sorted as distinct values, and
    the median is found by running counts, without collecting a group.
    """
    c = df.where((F.col(value) > 0) & (F.col(value) < float("inf"))).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    c = c.withColumn("below", F.sum("n").over(w.orderBy(value)) - F.col("n")).withColumn("total", F.sum("n").over(w))
    at = (F.col("below") <= F.expr("total div 2")) & (F.expr("total div 2") < F.col("below") + F.col("n"))
    return c.groupBy(key).agg(F.min(value).alias("least"), F.max(F.when(at, F.col(value))).alias("median"), F.max(value).alias("most"))


def shared_or_mixed(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, state, value): the value if all rows agree (nulls too), else mixed."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    u = df.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.field").agg(F.min("p.value").alias("lo"), F.max("p.value").alias("hi"), F.count("p.value").alias("known"), F.count("*").alias("n"))
    same = (F.col("known") == 0) | ((F.col("known") == F.col("n")) & (F.col("lo") == F.col("hi")))
    return u.select("field", F.when(same, "shared").otherwise("mixed").alias("state"), F.when(same, F.col("lo")).alias("value"))


def edge_uses(triangles: DataFrame) -> DataFrame:
    """(lo, hi, forward, back) of every undirected edge."""
    e = triangles.select(F.explode(F.array(*[F.struct(F.col(p).alias("s"), F.col(q).alias("t")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")).select("e.*")
    return e.groupBy(F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi")).agg(F.count_if(F.col("s") < F.col("t")).alias("forward"), F.count_if(F.col("s") >= F.col("t")).alias("back"))


def manifold_statistics(triangles: DataFrame) -> DataFrame:
    """Boundary, non-manifold and inconsistently turned edges; watertight if there are none."""
    n = F.col("forward") + F.col("back")
    s = edge_uses(triangles).agg(F.count("*").alias("edges"), F.count_if(n == 1).alias("boundary"), F.count_if(n > 2).alias("non_manifold"), F.count_if((n == 2) & (F.col("forward") != F.col("back"))).alias("inconsistent"))
    return s.withColumn("watertight", (F.col("edges") > 0) & (F.col("boundary") + F.col("non_manifold") + F.col("inconsistent") == 0))


def corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners (ax .. cz)."""
    for p in "abc":
        v = vertices.select(F.col("id").alias(f"_{p}"), *[F.col(k).alias(f"{p}{k}") for k in "xyz"])
        triangles = triangles.join(v, F.col(p) == F.col(f"_{p}")).drop(f"_{p}")
    return triangles


def _normal() -> tuple[Column, Column, Column]:
    u = [F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz"]
    v = [F.col(f"c{k}") - F.col(f"a{k}") for k in "xyz"]
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def mesh_volume(meshed: DataFrame) -> DataFrame:
    """The signed volume of triangles with corners, times six."""
    x = F.col("ax") * (F.col("by") * F.col("cz") - F.col("bz") * F.col("cy")) + F.col("ay") * (F.col("bz") * F.col("cx") - F.col("bx") * F.col("cz")) + F.col("az") * (F.col("bx") * F.col("cy") - F.col("by") * F.col("cx"))
    return meshed.agg(F.sum(x).alias("volume6"))


def overhangs(meshed: DataFrame, degrees: float = 45.0, slack: float = 0.01) -> DataFrame:
    """(face, area2, n): doubled areas of triangles that hang over by more than
    an angle from the vertical and don't lie on the plate (z = 0)."""
    n = _normal()
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    down = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(-n[2], length)))))
    on_plate = (F.col("az") <= 0) & (F.col("bz") <= 0) & (F.col("cz") <= 0)
    return meshed.where((down > degrees + slack) & ~on_plate).groupBy("face").agg(F.sum(length).alias("area2"), F.count("*").alias("n"))


#: Fixed values: (verified, inliers, coverage, parallax, cheirality) at least, for each class.
PAIR_CLASSES = {"strong": (40, 300, 500, 1000, 800), "usable": (15, 150, 250, 300, 700)}


def pair_problem() -> Column:
    """Why a pair's counts contradict each other (null: they don't)."""
    counts = (F.col("verified") > F.col("tentative")) | (F.col("homography") > F.col("tentative")) | (F.col("cheirality") > F.col("verified"))
    cells = (F.col("cell_count") == 0) | (F.col("cells") > F.col("cell_count"))
    return F.when(counts, "inlier counts").when(cells, "grid occupancy").when(~F.col("cycle").between(0, 1000), "cycle")


def pair_problems(pairs: DataFrame) -> DataFrame:
    """Pairs whose counts contradict each other, with the reason; the others can be judged."""
    return pairs.withColumn("problem", pair_problem()).where("problem is not null")


def pair_quality(pairs: DataFrame) -> DataFrame:
    """Adds ``score`` (per mille), ``quality`` and the three signs of degeneracy.

    ``pairs``: tentative, verified, homography, cheirality (counts), cells, cell_count,
    parallax (thousandths of a degree), cycle (per mille). Parallax counts in full from
    two degrees. Only integers are compared.
    """
    p = pairs.withColumns({
        "q_inl": per_mille(F.col("verified"), F.col("tentative")),
        "q_cov": per_mille(F.col("cells"), F.col("cell_count")),
        "q_hom": per_mille(F.col("homography"), F.col("verified")),
        "q_che": per_mille(F.col("cheirality"), F.col("verified")),
        "q_par": F.least(F.lit(1000), F.expr("parallax * 1000 div 2000")),
    })
    p = p.withColumns({
        "flat": (F.col("q_hom") >= 900) & (F.col("parallax") < 1000),
        "behind": (F.col("verified") > 0) & (F.col("q_che") < 600),
        "narrow": F.col("parallax") < 150,
    })
    quality = F.when(F.col("flat") | F.col("behind") | F.col("narrow"), "degenerate")
    for name, least in PAIR_CLASSES.items():
        tests = [F.col(c) >= v for c, v in zip(("verified", "q_inl", "q_cov", "parallax", "q_che"), least)]
        quality = quality.when(reduce(lambda a, b: a & b, tests), name)
    score = F.expr("(3 * q_inl + 2 * q_cov + 2 * q_par + 2 * q_che + cycle) div 10")
    p = p.withColumns({"score": score, "quality": quality.otherwise("weak")})
    return p.drop("q_inl", "q_cov", "q_hom", "q_che", "q_par")


#: Conditional backends of each profile, in the order of its passes.
RESCUE_PASSES = {
    "fast": ("aliked", "dedode", "dense"),
    "quality": ("dedode", "dense"),
    "robust": ("dense",),
}


def rescue(pairs: DataFrame) -> DataFrame:
    """Adds the sorted ``reasons`` for a rescue of a judged pair and its ordered ``actions``.

    ``pairs`` also has profile, executed (array of backends), first_degree,
    second_degree, bridge, expected, failed. Actions are the conditional passes that
    have not run yet, then an expansion of the graph for bridges and images of low degree.
    """
    lonely = (F.col("first_degree") < 2) | (F.col("second_degree") < 2)
    reasons = F.array_compact(F.array(
        F.when(F.col("quality") == "weak", "weak_pair_quality"),
        F.when(F.col("quality") == "degenerate", "degenerate_geometry"),
        F.when(lonely, "underconnected_image"),
        F.when(F.col("bridge") & (F.col("quality") != "strong"), "weak_component_bridge"),
        F.when(F.col("expected") & (F.col("verified") < 30), "expected_overlap_missing"),
        F.when(F.col("failed"), "registration_failed"),
    ))
    passes = F.coalesce(*[F.when(F.col("profile") == k, F.array(*map(F.lit, v))) for k, v in RESCUE_PASSES.items()])
    left = F.array_except(passes, "executed")
    more = F.when(F.col("bridge") | lonely, F.array(F.lit("expand_graph"))).otherwise(F.array().cast("array<string>"))
    actions = F.when(F.size("reasons") > 0, F.concat(left, more)).otherwise(F.array().cast("array<string>"))
    return pairs.withColumn("reasons", reasons).withColumn("actions", actions)


def preflight(stages: DataFrame) -> DataFrame:
    """Greatest memory and summed storage over enabled stages."""
    return stages.where("enabled").agg(F.max("ram").alias("ram"), F.max("vram").alias("vram"), F.sum("scratch").alias("scratch"), F.sum("output").alias("output"))


def fingerprint(df: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """An order-independent fingerprint of member ids: sums of hash parts.

    The members are never gathered, so its cost does not depend on a group's size.
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    g = (df.groupBy(group) if group else df.groupBy()).agg(F.count("*").alias("n"), *parts)
    return g.select(*([group] if group else []), "n", F.sha2(F.concat_ws(",", "n", *[f"p{k}" for k in range(4)]), 256).alias("fingerprint"))


def fused(samples: DataFrame, voxel: float, most: int = 64) -> DataFrame:
    """Voxels' samples joined into clusters in order; weighted position and colour.

    Samples of a voxel are one ordered fold: a sample joins the nearest open
    cluster that has no sample of its view, within 1.5 footprints and with a
    normal within 60 degrees; the oldest of over ``most`` clusters is closed.
    """
    import numpy as np
    import pandas as pd

    keep = ["x", "y", "z", "nx", "ny", "nz", "red", "green", "blue"]

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ordinal"])
        every, live = [], []
        for r in g.itertuples(index=False):
            v = np.array([getattr(r, k) for k in keep])
            best = None
            for c in live:
                mean = c["sum"] / c["w"]
                d = float(np.linalg.norm(v[:3] - mean[:3]))
                n = mean[3:6] / max(1e-12, float(np.linalg.norm(mean[3:6])))
                if r.view not in c["views"] and d <= 1.5 * max(c["foot"], r.footprint) and float(v[3:6] @ n) >= 0.5 and (best is None or d < best[0]):
                    best = (d, c)
            if best is None:
                c = {"sum": np.zeros(len(keep)), "w": 0.0, "foot": 0.0, "views": set(), "n": 0}
                every.append(c)
                live = [*live, c][-most:]
            else:
                c = best[1]
            c["sum"] += r.confidence * v
            c["w"] += r.confidence
            c["foot"] = max(c["foot"], r.footprint)
            c["views"].add(r.view)
            c["n"] += 1
        key = g.iloc[0]
        return pd.DataFrame([(key.vx, key.vy, key.vz, i, c["n"], *(c["sum"] / c["w"])) for i, c in enumerate(every)], columns=["vx", "vy", "vz", "cluster", "n", *keep])

    cells = samples.where("confidence > 0").withColumns({f"v{k}": F.floor(F.col(k) / voxel).cast("long") for k in "xyz"})
    return cells.groupBy("vx", "vy", "vz").applyInPandas(fold, "vx long, vy long, vz long, cluster int, n int, " + ", ".join(f"{k} double" for k in keep))


def blended(samples: DataFrame) -> DataFrame:
    """(cell, weighted, best, first): blends of (cell, camera, rank, q, c) samples."""
    return samples.groupBy("cell").agg(F.try_divide(F.sum(F.col("q") * F.col("c")), F.sum("q")).alias("weighted"), F.max_by("c", F.struct("q", (-F.col("rank")).alias("r"))).alias("best"), F.min_by("c", "rank").alias("first"))


def radial_bins(df: DataFrame, radius: str, value: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(radius) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
