"""Least-squares fits: sums in Spark, small systems on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import joins
from geoloom.session import cut

S, T = ("sx", "sy", "sz"), ("tx", "ty", "tz")


def _row(df: DataFrame, **sums: Column) -> dict:
    return df.agg(*[F.sum(c).alias(n) for n, c in sums.items()]).first().asDict()


def plane(points: DataFrame) -> dict:
    """Normal, centroid and planarity of weighted points (x, y, z, w)."""
    w, c = F.col("w"), [F.col(k) for k in "xyz"]
    s = _row(points, n=F.lit(1), w=w, **{k: w * F.col(k) for k in "xyz"})
    if (s["n"] or 0) < 3 or not s["w"] > 0:
        raise ValueError("a plane needs three points of positive weight")
    m = [s[k] / s["w"] for k in "xyz"]
    q = _row(points, **{f"{i}{j}": w * (c[i] - m[i]) * (c[j] - m[j]) for i in range(3) for j in range(i, 3)})
    cov = np.array([[q[f"{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]) / s["w"]
    values, vectors = np.linalg.eigh(cov)
    return {"normal": vectors[:, 0].tolist(), "centroid": m, "planarity": float(values[0] / max(1e-300, values.sum()))}


def similarity_2d(pairs: DataFrame) -> dict:
    """a, b, tx, ty of the weighted best similarity from (sx, sy) to (tx, ty)."""
    w = F.col("w")
    s = _row(pairs, n=F.lit(1), w=w, **{k: w * F.col(k) for k in ("sx", "sy", "tx", "ty")})
    if (s["n"] or 0) < 2:
        raise ValueError("a similarity needs two pairs")
    m = {k: s[k] / s["w"] for k in ("sx", "sy", "tx", "ty")}
    dx, dy, ex, ey = (F.col(k) - m[k] for k in ("sx", "sy", "tx", "ty"))
    q = _row(pairs, d=w * (dx * dx + dy * dy), a=w * (dx * ex + dy * ey), b=w * (dx * ey - dy * ex))
    a, b = q["a"] / q["d"], q["b"] / q["d"]
    return {"a": a, "b": b, "tx": m["tx"] - a * m["sx"] + b * m["sy"], "ty": m["ty"] - b * m["sx"] - a * m["sy"]}


def circle(points: DataFrame) -> dict:
    """Centre, radius (mean distance) and height of the algebraic circle."""
    m = points.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n")).first()
    if m["n"] < 3:
        raise ValueError("a circle needs three points")
    x, y = F.col("x") - m["x"], F.col("y") - m["y"]
    r = x * x + y * y
    s = _row(points, xx=x * x, xy=x * y, yy=y * y, xr=x * r, yr=y * r)
    c = np.linalg.solve([[s["xx"], s["xy"]], [s["xy"], s["yy"]]], [s["xr"] / 2, s["yr"] / 2])
    radius = points.agg(F.avg(F.sqrt((x - float(c[0])) * (x - float(c[0])) + (y - float(c[1])) * (y - float(c[1]))))).first()[0]
    return {"x": float(c[0] + m["x"]), "y": float(c[1] + m["y"]), "z": m["z"], "radius": radius}


def horn(pairs: DataFrame, scale: bool = True, w: Column | None = None) -> dict:
    """Rotation, scale and shift that best map sources to targets (unit quaternion)."""
    w = F.col("w") if w is None else w
    s = _row(pairs, n=F.lit(1), w=w, **{k: w * F.col(k) for k in (*S, *T)})
    if (s["n"] or 0) < 3 or not s["w"] > 0:
        raise ValueError("a rotation needs three pairs")
    p, t = (np.array([s[k] / s["w"] for k in side]) for side in (S, T))
    d = [F.col(k) - float(v) for k, v in zip(S, p)]
    e = [F.col(k) - float(v) for k, v in zip(T, t)]
    q = _row(pairs, v=w * (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), **{f"m{i}{j}": w * d[i] * e[j] for i in range(3) for j in range(3)})
    m = np.array([[q[f"m{i}{j}"] for j in range(3)] for i in range(3)])
    skew = np.array([m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]])
    k = np.zeros((4, 4))
    k[0, 0], k[0, 1:], k[1:, 0], k[1:, 1:] = np.trace(m), skew, skew, m + m.T - np.trace(m) * np.eye(3)
    a, b, c, f = np.linalg.eigh(k)[1][:, -1]
    r = np.array([[a * a + b * b - c * c - f * f, 2 * (b * c - a * f), 2 * (b * f + a * c)], [2 * (b * c + a * f), a * a - b * b + c * c - f * f, 2 * (c * f - a * b)], [2 * (b * f - a * c), 2 * (c * f + a * b), a * a - b * b - c * c + f * f]])
    size = float((r * m.T).sum() / q["v"]) if scale and q["v"] > 0 else 1.0
    return {"rotation": r, "scale": size, "shift": t - size * r @ p}


def _residual(fit: dict) -> Column:
    r, s, t = fit["rotation"], fit["scale"], fit["shift"]
    out = F.lit(0.0)
    for k in range(3):
        d = s * (float(r[k][0]) * F.col("sx") + float(r[k][1]) * F.col("sy") + float(r[k][2]) * F.col("sz")) + float(t[k]) - F.col(T[k])
        out = out + d * d
    return F.sqrt(out)


def robust_pairs(pairs: DataFrame, delta: float, scale: bool = True, rounds: int = 20, stop: float = 1e-10) -> dict:
    """Horn's fit reweighted by Huber weights of the residuals; prior weights multiply.

    One aggregate over the pairs for each round.
    """
    fit = horn(pairs, scale)
    for k in range(rounds):
        r = _residual(fit)
        new = horn(pairs, scale, F.col("w") * F.when(r <= delta, F.lit(1.0)).otherwise(F.try_divide(F.lit(delta), r)))
        moved = max(np.abs(new["rotation"] - fit["rotation"]).max(), abs(new["scale"] - fit["scale"]), np.abs(new["shift"] - fit["shift"]).max())
        fit = new | {"rounds": k + 1}
        if moved < stop:
            break
    return fit


def robust_translation(pairs: DataFrame, delta: float, rounds: int = 20, stop: float = 1e-10) -> dict:
    """The shift alone, by the same reweighting; one pair is enough."""
    fit, w = None, F.col("w")
    for _ in range(rounds + 1):
        s = _row(pairs, w=w, **{k: w * (F.col(b) - F.col(a)) for k, a, b in zip("xyz", S, T)})
        if not (s["w"] or 0) > 0:
            raise ValueError("a shift needs a pair of positive weight")
        shift = np.array([s[k] / s["w"] for k in "xyz"])
        if fit is not None and np.abs(shift - fit["shift"]).max() < stop:
            break
        fit = {"rotation": np.eye(3), "scale": 1.0, "shift": shift}
        r = _residual(fit)
        w = F.col("w") * F.when(r <= delta, F.lit(1.0)).otherwise(F.try_divide(F.lit(delta), r))
    return fit


def icp(source: DataFrame, target: DataFrame, reach: float, rounds: int = 30, least_overlap: float = 0.2, stop: tuple[float, float] = (1e-4, 1e-5), normals: bool = False, delta: float = 0.1) -> dict:
    """Iterated nearest correspondences and rigid fits.

    ``normals``: targets have nx, ny, nz and distances count along them; the
    small-angle step adds to the pose's angles. Distances over ``delta`` have Huber
    weights in both kinds of step. Too few matches or too little
    overlap are errors.
    """
    if normals and not {"nx", "ny", "nz"} <= set(target.columns):
        raise ValueError("distances along normals need normals")
    n, rotation, shift, done = source.count(), np.eye(3), np.zeros(3), False
    for k in range(rounds):
        moved = source.select("id", *[(float(rotation[i][0]) * F.col("x") + float(rotation[i][1]) * F.col("y") + float(rotation[i][2]) * F.col("z") + float(shift[i])).alias("xyz"[i]) for i in range(3)])
        m = joins.nearest_correspondence(moved, target, reach)
        t = target.select(F.col("id").alias("tid"), *[F.col(a).alias(b) for a, b in zip("xyz", T)], *(["nx", "ny", "nz"] if normals else []))
        pairs = m.join(t, "tid").join(moved.select(F.col("id").alias("sid"), *[F.col(a).alias(b) for a, b in zip("xyz", S)]), "sid").withColumn("w", F.lit(1.0)).transform(cut)
        got = pairs.agg(F.count("*").alias("n"), F.sqrt(F.avg("d2")).alias("rms")).first()
        overlap = got["n"] / max(1, n)
        if got["n"] < 3 or overlap < least_overlap:
            raise ValueError(f"{got['n']} matches, overlap {overlap:.3f}")
        if normals:
            nrm, d = [F.col(c) for c in ("nx", "ny", "nz")], [F.col(a) - F.col(b) for a, b in zip(S, T)]
            p = [F.col(c) for c in S]
            j = [p[1] * nrm[2] - p[2] * nrm[1], p[2] * nrm[0] - p[0] * nrm[2], p[0] * nrm[1] - p[1] * nrm[0], *nrm]
            e = d[0] * nrm[0] + d[1] * nrm[1] + d[2] * nrm[2]
            w = F.when(F.abs(e) <= delta, F.lit(1.0)).otherwise(F.try_divide(F.lit(delta), F.abs(e)))
            q = _row(pairs, **{f"a{a}{b}": w * j[a] * j[b] for a in range(6) for b in range(a, 6)}, **{f"g{a}": -w * j[a] * e for a in range(6)})
            x = np.linalg.lstsq(np.array([[q[f"a{min(a, b)}{max(a, b)}"] for b in range(6)] for a in range(6)]), np.array([q[f"g{a}"] for a in range(6)]), rcond=None)[0]
            from geoloom.functions.geometry import euler_zyx

            dr, dt = np.array(euler_zyx(*x[:3])), x[3:]
        else:
            r = F.sqrt("d2")
            f = horn(pairs, False, F.when(r <= delta, F.lit(1.0)).otherwise(F.try_divide(F.lit(delta), r)))
            dr, dt = f["rotation"], f["shift"]
        rotation, shift = dr @ rotation, dr @ shift + dt
        angle = float(np.arccos(np.clip((np.trace(dr) - 1) / 2, -1, 1)))
        done = float(np.linalg.norm(dt)) < stop[0] and angle < stop[1]
        if done:
            break
    return {"rotation": rotation, "shift": shift, "matched": got["n"], "overlap": overlap, "rms": got["rms"], "rounds": k + 1, "accepted": done}
