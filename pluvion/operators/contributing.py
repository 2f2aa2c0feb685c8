"""What a node's upstream areas add up to, pushed down a directed acyclic graph of outflow shares, one row a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut

#: Layers that one job pushes before lineage is cut.
LAYERS_A_JOB = 5


def contributing_areas(shares: DataFrame, areas: DataFrame, max_layers: int = 100_000) -> DataFrame:
    """(i, area, layer): a node's own area and what flows in from above, for areas(node_id, area) and shares(u, v, share).

    A node hands on its sum once all that flow into it have done so, so every share is used once and every round settles one
    layer (0: no inflow). The state is a row a node. Shares that run in a circle never settle and raise, as do shares of
    nodes without an area. Null areas count as 0; parallel shares add up.
    """
    known = areas.select("node_id", F.coalesce("area", F.lit(0.0)).cast("double").alias("area"))
    one = shares.groupBy("u", "v").agg(F.sum("share").alias("share"))
    ends = one.select(F.col("u").alias("node_id")).union(one.select("v"))
    if not ends.join(known, "node_id", "left_anti").isEmpty():
        raise ValueError("contributing_areas: shares name nodes without an area")
    inflows = one.groupBy(F.col("v").alias("node_id")).agg(F.count("*").alias("need"))
    state = known.join(inflows, "node_id", "left").select(
        "node_id", "area", F.coalesce("need", F.lit(0)).alias("need"), F.lit(0).cast("long").alias("got"), F.lit(None).cast("int").alias("layer")
    )
    one, state = cut(one), cut(state.withColumn("layer", F.when(F.col("need") == 0, 0)))
    for layer in range(0, max_layers, LAYERS_A_JOB):
        for k in range(layer, layer + LAYERS_A_JOB):
            ready = state.where(F.col("layer") == k).select(F.col("node_id").alias("u"), F.col("area").alias("_a"))
            pushed = one.join(ready, "u").groupBy(F.col("v").alias("node_id")).agg(F.sum(F.col("share") * F.col("_a")).alias("_more"), F.count("*").alias("_n"))
            got = F.col("got") + F.coalesce("_n", F.lit(0))
            now = F.when(F.col("layer").isNull() & (got == F.col("need")), k + 1).otherwise(F.col("layer"))
            state = state.join(pushed, "node_id", "left").select(
                "node_id", (F.col("area") + F.coalesce("_more", F.lit(0.0))).alias("area"), "need", got.alias("got"), now.alias("layer")
            )
        state = cut(state)
        top, left = state.agg(F.max("layer"), F.count(F.when(F.col("layer").isNull(), 1))).first()
        if not left:
            return state.select(F.col("node_id").alias("i"), "area", "layer")
        if top is None or top < layer + LAYERS_A_JOB:  # the last round settled nothing
            break
    raise RuntimeError("contributing_areas: the shares run in a circle")
