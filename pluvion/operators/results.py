"""Tables of a predicted scenario: rows of (member, t, node_id, p, rain, depth)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tiers' names and lower bounds.
TIERS = (("Low", 0.0), ("Moderate", 0.25), ("High", 0.5), ("Severe", 0.75))


def risk_tier(p: Column, tiers: Sequence[tuple[str, float]] = TIERS) -> Column:
    """The tier with the largest bound at or below p; null and NaN are the lowest."""
    out = F.lit(tiers[0][0])
    for name, bound in tiers[1:]:
        out = F.when(F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0)) >= bound, name).otherwise(out)
    return out


def ensemble(df: DataFrame) -> DataFrame:
    """(t, node_id, p, spread, rain, depth): mean over members, population spread of p."""
    return df.groupBy("t", "node_id").agg(
        F.avg("p").alias("p"), F.coalesce(F.stddev_pop("p"), F.lit(0.0)).alias("spread"), F.avg("rain").alias("rain"), F.avg("depth").alias("depth")
    )


def members_at_risk(df: DataFrame, threshold: float) -> DataFrame:
    """(node_id, members, at_risk, share): members whose highest p reaches the threshold."""
    per = df.groupBy("node_id", "member").agg(F.max("p").alias("p"))
    return per.groupBy("node_id").agg(
        F.count("*").alias("members"), F.count_if(F.col("p") >= threshold).alias("at_risk"), F.avg((F.col("p") >= threshold).cast("double")).alias("share")
    )


def risk_range(df: DataFrame, threshold: float) -> DataFrame:
    """One row: the least and greatest number of nodes at risk over the members."""
    per = df.groupBy("member", "node_id").agg(F.max("p").alias("p"))
    counts = per.groupBy("member").agg(F.count_if(F.col("p") >= threshold).alias("n"))
    return counts.agg(F.min("n").alias("least"), F.max("n").alias("most"))


def horizon_max(df: DataFrame, first: int, hours: int) -> DataFrame:
    """(node_id, p, peak_t): the highest p of the first `hours` steps and its first step."""
    inside = df.where(F.col("t").between(first, first + hours - 1))
    return inside.groupBy("node_id").agg(F.max("p").alias("p"), F.min_by("t", F.struct(-F.col("p"), F.col("t"))).alias("peak_t"))


def node_table(mean: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """One row per node: highest p, its spread, step and rain, tier, alert, total rain, greatest depth, share of members.

    mean: ensemble(); members: members_at_risk().
    """
    rank = F.struct(-F.col("p"), F.col("t"))
    per = mean.groupBy("node_id").agg(
        F.max("p").alias("max_p"), F.min_by("spread", rank).alias("spread_at_peak"), F.min_by("t", rank).alias("peak_t"),
        F.min_by("rain", rank).alias("peak_rain"), F.sum("rain").alias("total_rain"), F.max("depth").alias("max_depth"),
    )
    joined = per.join(members.select("node_id", F.col("share").alias("member_share")), "node_id", "left")
    return joined.withColumn("tier", risk_tier(F.col("max_p"))).withColumn("alert", F.col("max_p") >= threshold)


def top_nodes(table: DataFrame, k: int) -> DataFrame:
    """The k riskiest nodes with their rank: by p, then depth, then peak rain, nulls last, then id."""
    order = [F.desc_nulls_last("max_p"), F.desc_nulls_last("max_depth"), F.desc_nulls_last("peak_rain"), F.asc("node_id")]
    best = table.orderBy(*order).limit(k)
    keys = [x for c in ("max_p", "max_depth", "peak_rain") for x in (F.isnull(c).alias(f"no_{c}"), (-F.col(c)).alias(c))]
    rows = F.sort_array(F.collect_list(F.struct(*keys, "node_id")))
    ranked = best.agg(rows.alias("r")).select(F.posexplode("r").alias("pos", "x"))  # k rows at most
    return best.join(ranked.select((F.col("pos") + 1).alias("rank"), F.col("x.node_id").alias("node_id")), "node_id")


def tier_counts(table: DataFrame, p: str = "max_p") -> DataFrame:
    """(tier, nodes): every tier listed."""
    got = table.groupBy(risk_tier(F.col(p)).alias("tier")).agg(F.count("*").alias("nodes"))
    names = table.sparkSession.createDataFrame([(n,) for n, _ in TIERS], "tier string")
    return names.join(got, "tier", "left").select("tier", F.coalesce("nodes", F.lit(0)).alias("nodes"))


def horizon_counts(mean: DataFrame, first: int, horizons: Sequence[int], threshold: float) -> DataFrame:
    """(horizon, nodes_at_risk, max_p) for each of the horizons."""
    hs = F.array(*[F.lit(h) for h in horizons])
    inside = mean.select("t", "node_id", "p", F.explode(F.filter(hs, lambda h: F.col("t") < F.lit(first) + h)).alias("horizon"))
    per = inside.where(F.col("t") >= first).groupBy("horizon", "node_id").agg(F.max("p").alias("p"))
    return per.groupBy("horizon").agg(F.count_if(F.col("p") >= threshold).alias("nodes_at_risk"), F.max("p").alias("max_p"))


def peak_hour(mean: DataFrame, threshold: float) -> DataFrame:
    """One row: the first step with most nodes at risk; if none is, the step of the highest p."""
    per = mean.groupBy("t").agg(F.count_if(F.col("p") >= threshold).alias("n"), F.max("p").alias("p"))
    return per.agg(
        F.when(F.max("n") > 0, F.min_by("t", F.struct(-F.col("n"), F.col("t")))).otherwise(F.min_by("t", F.struct(-F.col("p"), F.col("t")))).alias("peak_t"),
        F.max("n").alias("nodes_at_risk"),
    )


def junction_timeline(mean: DataFrame, node_id=None) -> DataFrame:
    """The steps of one node, or of all, with p, its band of one spread, rain and depth."""
    own = mean if node_id is None else mean.where(F.col("node_id") == node_id)
    return own.select(
        "node_id", "t", "p", F.greatest(F.col("p") - F.col("spread"), F.lit(0.0)).alias("p_low"), F.least(F.col("p") + F.col("spread"), F.lit(1.0)).alias("p_high"), "rain", "depth"
    )


def ramp(fraction: Column, stops: Sequence[tuple[float, float]]) -> Column:
    """A piecewise linear scale through (position, value) stops."""
    x = F.least(F.greatest(fraction, F.lit(stops[0][0])), F.lit(stops[-1][0]))
    out = F.lit(float(stops[-1][1]))
    for (a, va), (b, vb) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(x <= b, va + (vb - va) * (x - a) / (b - a)).otherwise(out)
    return out


def street_values(segments: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """segments(a, b) with the mean of their two junctions' values."""
    a = values.select(F.col("node_id").alias("a"), F.col(value).alias("_a"))
    b = values.select(F.col("node_id").alias("b"), F.col(value).alias("_b"))
    return segments.join(a, "a").join(b, "b").withColumn(value, (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def feature_json(table: DataFrame, properties: Sequence[str], timeline: DataFrame | None = None) -> DataFrame:
    """(node_id, feature): a GeoJSON point per node of table(node_id, lon, lat, ...), with its hourly p if given."""
    rows = table
    if timeline is not None:
        line = F.transform(F.array_sort(F.collect_list(F.struct("t", F.round(F.nanvl("p", F.lit(None).cast("double")), 4).alias("p")))), lambda x: x["p"])
        rows = table.join(timeline.groupBy("node_id").agg(line.alias("prob_timeline")), "node_id", "left")
        properties = [*properties, "prob_timeline"]
    kinds = dict(rows.dtypes)
    clean = [F.nanvl(c, F.lit(None).cast("double")).alias(c) if kinds[c] == "double" else F.col(c) for c in properties]
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    whole = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*clean).alias("properties"))
    return rows.select("node_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("feature"))


def metric_table(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long (model, metric, value) rows as one wide row per model."""
    return rows.groupBy("model").pivot("metric", list(names)).agg(F.first("value"))


def strongest(rows: DataFrame, against: str) -> DataFrame:
    """One row: the model of the highest value apart from `against`, and that model's lead over it."""
    other = rows.where(F.col("model") != against)
    mine = rows.where(F.col("model") == against).agg(F.max("value").alias("_mine"))
    best = other.agg(F.max_by("model", F.struct("value", "model")).alias("strongest"), F.max("value").alias("value"))
    return best.join(F.broadcast(mine), on=F.lit(True)).select("strongest", "value", (F.col("_mine") - F.col("value")).alias("delta"))
