"""Structured Streaming forms: positions, progress, journal tail, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds for which a correction counts, metres below which a fix of two
#: frequencies is fine, and the bounds of sigma with and without it.
CORRECTION_AGE, FINE = 10.0, 1.5
FINE_SIGMA, COARSE_SIGMA = (0.15, 0.9), (0.25, 1.5)
_GAP_MS = 100


def position_tiers(fixes: DataFrame) -> DataFrame:
    """Adds fix, tier, sigma_h and sigma_v (stateless, so the same for streams and tables).

    ``fixes``: accuracy (metres; not positive: unknown), correction_age (seconds,
    null: no corrections), dual_frequency. Without a fresh correction a fix is single,
    and an accuracy under two metres is not believed; with one it is a float solution.
    """
    corrected = F.coalesce(F.col("correction_age") < CORRECTION_AGE, F.lit(False))
    h = F.when(F.col("accuracy") > 0, F.col("accuracy")).otherwise(5.0)
    fine = corrected & F.col("dual_frequency") & (h < FINE)
    within = lambda b: F.greatest(F.lit(b[0]), F.least(h, F.lit(b[1])))
    sigma_h = F.when(fine, within(FINE_SIGMA)).when(corrected, within(COARSE_SIGMA)).when(h < 2, 3.0).otherwise(h)
    sigma_v = F.when(fine, within(FINE_SIGMA) * 1.9).when(corrected, within(COARSE_SIGMA) * 2.0).otherwise(h * 1.8)
    tier = F.when(corrected, "ntrip_float").when(F.col("dual_frequency"), "dual_frequency").otherwise("consumer")
    return fixes.withColumns({"fix": F.when(corrected, "float").otherwise("single"), "tier": tier, "sigma_h": sigma_h, "sigma_v": sigma_v})


def quality_summary(fixes: DataFrame) -> DataFrame:
    """Mean sigmas and the shares of fixed and float fixes."""
    share = lambda v: F.avg((F.col("fix") == v).cast("int"))
    return position_tiers(fixes).agg(F.avg("sigma_h").alias("mean_sigma_h"), F.avg("sigma_v").alias("mean_sigma_v"), share("fixed").alias("fixed_share"), share("float").alias("float_share"))


def coalesced_progress(events: DataFrame, gap_ms: int = _GAP_MS) -> DataFrame:
    """(key, ms, phase, done): at most one row for each key and gap, unless the phase changes."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, phase = state.get if state.exists else (None, None)
        rows = []
        for g in groups:
            for r in g.sort_values(["ms", "done"]).itertuples(index=False):
                if last is None or r.phase != phase or r.ms - last >= gap_ms:
                    last, phase = int(r.ms), r.phase
                    rows.append((key[0], last, phase, int(r.done)))
        if last is not None:
            state.update((last, phase))
        yield pd.DataFrame(rows, columns=["key", "ms", "phase", "done"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, ms long, phase string, done long", "last long, phase string", "append", GroupStateTimeout.NoTimeout)


def journal_tail(spark: SparkSession, path: str, schema: str, after: int = -1) -> DataFrame:
    """New journal rows past a cursor, as files arrive."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("sequence") > after)


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Capture fixes from a folder of JSON lines."""
    return spark.readStream.schema("t timestamp, lat double, lon double, h double, sigmaH double, sigmaV double, fix string").json(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """(start, key, n) of event-time windows; rows later than the watermark are dropped by streams."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    return e.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
