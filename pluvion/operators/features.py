"""Hydraulic loads, scaling and model features of node-hours."""

from __future__ import annotations

from collections.abc import Sequence
from math import e

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import excess_ramp, trailing_sums


def drain_capacity(distance: Column, near: float, far: float, decay: float) -> Column:
    """far + (near - far) e^(-d / decay); without a distance, far."""
    return F.coalesce(F.lit(far) + (near - far) * F.pow(F.lit(e), -distance / decay), F.lit(float(far)))


def release_fraction(slope: Column, is_sink: Column, rate: float, floor: float) -> Column:
    share = F.least(rate * F.greatest(slope, F.lit(floor)) / 0.01, F.lit(1.0))
    return F.when(is_sink, 0.0).otherwise(share)


def runoff_m3(rain: Column, wetness: Column, infiltration: float, area: Column, dry: float, wet: float) -> Column:
    """Runoff of an hour: a coefficient between dry and wet by wetness (0 to 1), of the rain that does not sink in."""
    c = F.lit(dry) + (wet - dry) * wetness
    return c * F.greatest(rain - infiltration, F.lit(0.0)) * area / 1000.0


def flood_probability(depth: Column, threshold: float, softness: float) -> Column:
    return 1 / (1 + F.exp(-(F.coalesce(depth, F.lit(0.0)) - threshold) / softness))


def stratiform_share(areal: Column, base: float, r0: float) -> Column:
    return F.lit(base) * r0 / (r0 + areal)


def window_excess(df: DataFrame, keys: Sequence[str], value: str, window: int, threshold: float, ramp: float) -> DataFrame:
    """df with excess: how far the trailing sum over `window` steps lies above the threshold, 0 to 1."""
    return trailing_sums(df, keys, value, [window], "_sum").withColumn("excess", excess_ramp(F.col("_sum"), threshold, ramp)).drop("_sum")


def log_scaled(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def fit_scaler(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """One row, a struct (mean, std, n) per column: over finite values, log1p first where the flag says so.

    std is the population's, at least 1e-6; a column without values gets (0, 1).
    """
    out = []
    for name, log in columns.items():
        raw = F.col(name).cast("double")
        ok = F.when(~F.isnan(raw) & (F.abs(raw) < float("inf")), raw)
        x = log_scaled(ok) if log else ok
        n = F.count(x)
        out.append(
            F.struct(
                F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
                F.when(n == 0, 1.0).otherwise(F.greatest(F.stddev_pop(x), F.lit(1e-6))).alias("std"),
                n.alias("n"),
            ).alias(name)
        )
    return df.agg(*out)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """df with its columns as z-scores; what is not finite is 0. The scaler is one row."""
    joined = df.join(F.broadcast(scaler.select(*[F.col(c).alias(f"_s_{c}") for c in columns])), on=F.lit(True))
    for name, log in columns.items():
        raw = F.col(name).cast("double")
        ok = F.when(~F.isnan(raw) & (F.abs(raw) < float("inf")), raw)
        x = log_scaled(ok) if log else ok
        joined = joined.withColumn(name, F.coalesce((x - F.col(f"_s_{name}.mean")) / F.col(f"_s_{name}.std"), F.lit(0.0)))
    return joined.drop(*[f"_s_{c}" for c in columns])


def node_features(static: DataFrame, rain: DataFrame, key: str, windows: Sequence[int], scaler: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """(key, t, static z-scores, rain and its trailing sums as z-scores)."""
    sums = trailing_sums(rain, [key], "rain", windows)
    return apply_scaler(sums.join(static, key), scaler, columns)


def store_step(inflow: Column, capacity: Column, cap: float) -> Column:
    """struct(store, spill) after each step of a leaky store: it takes the inflow, leaks up to its capacity, spills above cap."""
    start = F.struct(F.lit(0.0).alias("store"), F.lit(0.0).alias("spill"), F.array().cast("array<struct<store:double,spill:double>>").alias("path"))

    def step(acc: Column, x: Column) -> Column:
        full = acc["store"] + x
        left = full - F.least(full, capacity)
        kept = F.least(left, F.lit(float(cap)))
        now = F.struct(kept.alias("store"), (left - kept).alias("spill"))
        return F.struct(kept.alias("store"), (left - kept).alias("spill"), F.concat(acc["path"], F.array(now)).alias("path"))

    return F.aggregate(inflow, start, step)["path"]


def water_budget(fluxes: DataFrame) -> DataFrame:
    """One row: inflow - change of storage - drained - outflow, and its share of the inflow, of a flux table."""
    residual = F.sum("inflow") - F.sum("d_storage") - F.sum("drained") - F.sum("outflow")
    return fluxes.agg(residual.alias("residual"), F.when(F.sum("inflow") != 0, residual / F.sum("inflow")).otherwise(0.0).alias("relative"))


def cell_intensity(nodes: DataFrame, hours: DataFrame, cells: DataFrame) -> DataFrame:
    """(t, node_id, intensity): 1 - product of (1 - a e g) over the moving Gaussian cells of an hour's event.

    cells(event_id, slot, peak_x, peak_y, radius, amplitude, vx, vy, t0, life): a cell moves with (vx, vy) and its
    envelope rises and falls over its life. The nodes of a region and the cells of an event are small tables.
    """
    met = hours.join(cells, "event_id").withColumn("_age", F.col("t") - F.col("t0"))
    live = met.where((F.col("_age") >= 0) & (F.col("_age") < F.col("life")))
    envelope = F.pow(F.sin(3.141592653589793 * (F.col("_age") + 0.5) / F.col("life")), F.lit(2))
    placed = live.select(
        "t", "amplitude", "radius", envelope.alias("_e"), (F.col("peak_x") + F.col("vx") * F.col("_age")).alias("_px"),
        (F.col("peak_y") + F.col("vy") * F.col("_age")).alias("_py"), (F.floor("t") % 64).alias("_k"),
    )
    spread = nodes.select("node_id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(63))).cast("long").alias("_k"))
    d2 = F.pow(F.col("x") - F.col("_px"), F.lit(2)) + F.pow(F.col("y") - F.col("_py"), F.lit(2))
    g = F.exp(-d2 / (2 * F.pow(F.col("radius"), F.lit(2))))
    term = F.least(F.col("amplitude") * F.col("_e") * g, F.lit(1 - 1e-12))
    got = placed.join(spread, "_k").groupBy("t", "node_id").agg(F.sum(F.log1p(-term)).alias("_l"))
    return got.select("t", "node_id", (1 - F.exp("_l")).alias("intensity"))


def mean_preserving_clip(df: DataFrame, key: str, value: str, lo: float, hi: float, rounds: int = 12) -> DataFrame:
    """Multipliers of mean 1 per key, cut to [lo, hi] and scaled back to mean 1, `rounds` times at most.

    All rounds share the partitioning by key, so they cost one shuffle.
    """
    out, per = df, Window.partitionBy(key)
    for _ in range(rounds):
        mean = F.avg(value).over(per)
        out = out.withColumn(value, F.least(F.greatest(F.when(mean > 0, F.col(value) / mean).otherwise(1.0), F.lit(lo)), F.lit(hi)))
    return out


def scaled_clip(df: DataFrame, key: str, value: str, lo: float, hi: float) -> DataFrame:
    """Multipliers min(max(s x, lo), hi) of mean 1 per key, s found exactly; x not negative, lo below 1 and hi above it.

    The mean of the clipped values rises with s along straight pieces that bend where s x meets lo or hi. The bends of a key
    are sorted once; running counts and sums behind each give the piece's line and so the s at which it reaches 1. Where a
    mean of 1 can't be reached (too many zeros) values take the bound that comes nearest; null and negative values count as
    0, and where all are 0 all become 1.
    """
    x = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumn(value, x)
    bends = rows.where(F.col(value) > 0).select(
        F.col(key).alias("_key"), F.col(value).alias("_x"), F.inline(F.array(
            F.struct((lo / F.col(value)).alias("_at"), F.lit(-1).alias("_low"), F.lit(0).alias("_high"), F.col(value).alias("_mid")),
            F.struct((hi / F.col(value)).alias("_at"), F.lit(0).alias("_low"), F.lit(1).alias("_high"), (-F.col(value)).alias("_mid")),
        )),
    )
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.count(F.when(F.col(value) > 0, 1)).alias("_pos"))
    upto = Window.partitionBy("_key").orderBy("_at", "_low", "_x").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("_key").orderBy("_at", "_low", "_x")
    lines = bends.join(sizes, "_key").select(
        "_key", "_at", "_n", (F.col("_n") + F.sum("_low").over(upto)).alias("_l"), F.sum("_high").over(upto).alias("_h"),
        F.sum("_mid").over(upto).alias("_m"), F.lead("_at").over(onward).alias("_to"),
    )
    open_ = F.col("_n") - F.col("_l") - F.col("_h") > 0  # some value lies between the bounds
    s = F.when(open_, (F.col("_n") - F.col("_l") * lo - F.col("_h") * hi) / F.col("_m"))
    inside = (s >= F.col("_at") * (1 - 1e-12)) & (F.col("_to").isNull() | (s <= F.col("_to") * (1 + 1e-12)))
    scales = lines.withColumn("_s", s).where(inside).groupBy("_key").agg(F.min("_s").alias("_s"))
    met = sizes.join(scales, "_key", "left")
    joined = rows.join(met, F.col(key).eqNullSafe(F.col("_key")), "left")
    cut_ = F.least(F.greatest(F.col("_s") * F.col(value), F.lit(float(lo))), F.lit(float(hi)))
    far = F.when(F.col(value) > 0, float(hi)).otherwise(float(lo))
    out = F.when(F.col("_pos") == 0, 1.0).when(F.col("_s").isNotNull(), cut_).otherwise(far)
    return joined.withColumn(value, out).drop("_key", "_n", "_pos", "_s")
