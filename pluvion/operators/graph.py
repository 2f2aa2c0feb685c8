"""Street graphs: nodes(node_id, lon, lat, ...) and directed edges(u, v, length, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components, cut


def indexed(nodes: DataFrame) -> DataFrame:
    """nodes with idx, their order by the string form of the id.

    Ids are dealt by range and numbered inside each range from the counts before it.
    """
    ranged = cut(
        nodes.withColumn("_s", F.col("node_id").cast("string")).repartitionByRange("_s").withColumn("_part", F.spark_partition_id())
    )
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_s")) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(first), "_part").withColumn(
        "idx", F.col("_first") + F.col("_place")
    ).drop("_part", "_s", "_first", "_place")


def indexed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src and dst, the indexes of their ends."""
    src = nodes.select(F.col("node_id").alias("u"), F.col("idx").alias("src"))
    dst = nodes.select(F.col("node_id").alias("v"), F.col("idx").alias("dst"))
    return edges.join(src, "u").join(dst, "v")


def numeric_attributes(df: DataFrame, candidates: list[str]) -> list[str]:
    """The columns that are numbers on every row."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.expr(f"try_cast(`{c}` as double)")).alias(c) for c in candidates]).first()
    return [c for c in candidates if counts[c] == counts["n"]]


def street_grid(spark: SparkSession, rows: int, cols: int, first_id: int = 1000, step: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Junctions on a grid, two-way streets between neighbours; every fifth line is a secondary street."""
    cells = spark.range(rows * cols).select(
        (F.col("id") + first_id).alias("node_id"), F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c")
    )
    right = cells.where(F.col("c") < cols - 1).select(F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"), F.col("r").alias("line"))
    down = cells.where(F.col("r") < rows - 1).select(F.col("node_id").alias("u"), (F.col("node_id") + cols).alias("v"), F.col("c").alias("line"))
    one = right.unionByName(down).select(
        "u", "v", F.lit(step).alias("length"), F.when(F.col("line") % 5 == 0, "secondary").otherwise("residential").alias("highway")
    )
    edges = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", "highway"))
    degree = edges.groupBy(F.col("u").alias("node_id")).agg(F.count("*").cast("int").alias("street_count"))
    return cells.join(degree, "node_id", "left"), edges


def resolve_length(raw: Column, haversine: Column, least: float, default: float) -> Column:
    """The smallest positive value of a list, else the haversine length, else the default; at least `least`."""
    good = F.array_min(F.filter(raw, lambda v: v > 0))
    return F.greatest(F.coalesce(good, haversine, F.lit(float(default))), F.lit(float(least)))


def parse_oneway(values: Column) -> Column:
    """True if any of a list of strings says one way."""
    return F.coalesce(F.exists(values, lambda x: F.lower(F.trim(x)).isin("yes", "true", "1", "-1", "reverse", "t", "y")), F.lit(False))


def shortest_parallel(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge for each (u, v), the shortest; of equals the first by `order`. Loops stay out."""
    rank = F.struct("length", *([order] if order else []))
    row = F.struct(*[c for c in edges.columns if c not in ("u", "v")])
    got = edges.where("u <> v").groupBy("u", "v").agg(F.min_by(row, rank).alias("_e"))
    return got.select("u", "v", "_e.*").select(*edges.columns)


def with_reverse(edges: DataFrame) -> DataFrame:
    """Every edge in both directions (reverse_added tells the new ones); both take the shorter length."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edges.columns if c not in ("u", "v")])
    added = back.join(edges.select("u", "v"), ["u", "v"], "left_anti").withColumn("reverse_added", F.lit(True))
    both = edges.withColumn("reverse_added", F.lit(False)).unionByName(added)
    other = both.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("length").alias("_l"))
    return both.join(other, ["u", "v"], "left").withColumn("length", F.least("length", "_l")).drop("_l")


def undirected_segments(edges: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, with the shortest length of either direction."""
    return (
        edges.where("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("length").alias("length"))
    )


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node_id")).union(edges.select("v")).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest weakly connected component; of equals, that of the smallest node."""
    comps = connected_components(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    best = comps.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    member = comps.join(F.broadcast(best), "component").select(F.col("node").alias("node_id"))
    return nodes.join(member, "node_id", "left_semi")


def attach_ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """edges with columns of both ends, prefixed u_ and v_."""
    u = nodes.select(F.col("node_id").alias("u"), *[F.col(c).alias(f"u_{c}") for c in columns])
    v = nodes.select(F.col("node_id").alias("v"), *[F.col(c).alias(f"v_{c}") for c in columns])
    return edges.join(u, "u").join(v, "v")


def steepest_receivers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, receiver): of a node's strictly lower neighbours the one down the largest slope; ties to the smaller id."""
    ends = attach_ends(undirected_both(edges), nodes, ["elevation"])
    slope = (F.col("u_elevation") - F.col("v_elevation")) / F.greatest("length", F.lit(1.0))
    down = ends.where("v_elevation < u_elevation")
    return down.groupBy(F.col("u").alias("node_id")).agg(F.min_by("v", F.struct(-slope, F.col("v"))).alias("receiver"))


def undirected_both(edges: DataFrame) -> DataFrame:
    s = undirected_segments(edges)
    return s.select(F.col("a").alias("u"), F.col("b").alias("v"), "length").unionByName(
        s.select(F.col("b").alias("u"), F.col("a").alias("v"), "length")
    )


def flow_accumulation(nodes: DataFrame, receivers: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node_id, accumulation): nodes whose path of descent passes through each, itself included.

    Pointer doubling: counts are pushed 1, 2, 4, ... receivers ahead, so the rounds grow with the log of the longest path.
    """
    state = cut(nodes.select("node_id").join(receivers, "node_id", "left").select("node_id", F.col("receiver").alias("jump"), F.lit(1).cast("long").alias("acc")))
    for _ in range(max_rounds):
        if state.where("jump is not null").isEmpty():
            return state.select("node_id", F.col("acc").alias("accumulation"))
        pushed = state.where("jump is not null").groupBy(F.col("jump").alias("node_id")).agg(F.sum("acc").alias("more"))
        ahead = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("next"))
        state = cut(
            state.join(pushed, "node_id", "left").join(ahead, "jump", "left")
            .select("node_id", F.col("next").alias("jump"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"))
        )
    raise RuntimeError("flow_accumulation: descent does not end; elevations must fall along receivers")


def outflow_shares(edges: DataFrame, nodes: DataFrame, exponent: float) -> DataFrame:
    """(u, v, slope, share) of downhill edges: shares go as (slope / steepest slope)^exponent and sum to 1 per node."""
    ends = attach_ends(undirected_both(edges), nodes, ["elevation"])
    slope = (F.col("u_elevation") - F.col("v_elevation")) / F.greatest("length", F.lit(1.0))
    down = ends.withColumn("slope", slope).where("slope > 0").select("u", "v", "slope")
    per = Window.partitionBy("u")
    weighted = down.withColumn("_w", F.pow(F.col("slope") / F.max("slope").over(per), F.lit(exponent)))
    return weighted.select("u", "v", "slope", (F.col("_w") / F.sum("_w").over(per)).alias("share"))


def downhill_slope(nodes: DataFrame, shares: DataFrame) -> DataFrame:
    """(node_id, slope, is_sink): the shares' mean slope; a sink has no downhill edge."""
    got = shares.groupBy(F.col("u").alias("node_id")).agg(F.sum(F.col("share") * F.col("slope")).alias("slope"))
    return nodes.select("node_id").join(got, "node_id", "left").select(
        "node_id", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.col("slope").isNull().alias("is_sink")
    )


def catchment_area(nodes: DataFrame, edges: DataFrame, width: float) -> DataFrame:
    """(node_id, area): width times half the length of the segments that meet there, at least 1."""
    s = undirected_segments(edges)
    ends = s.select(F.col("a").alias("node_id"), "length").union(s.select("b", "length"))
    half = ends.groupBy("node_id").agg((F.sum("length") * (width / 2)).alias("area"))
    joined = nodes.select("node_id").join(half, "node_id", "left")
    return joined.select("node_id", F.greatest(F.coalesce("area", F.lit(1.0)), F.lit(1.0)).alias("area"))


def upstream_operator(shares: DataFrame, nodes: DataFrame, max_rounds: int = 512) -> DataFrame:
    """(i, j, w): the share of j's water that passes i, itself included: the sum of all powers of the routing.

    Ends as water only runs downhill; a longer series is an error.
    """
    step = cut(nodes.select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(1.0).alias("w")))
    total = step
    routing = shares.select(F.col("u").alias("i"), F.col("v").alias("to"), "share")
    for k in range(max_rounds):
        step = cut(
            step.join(routing, "i").groupBy(F.col("to").alias("i"), "j").agg(F.sum(F.col("w") * F.col("share")).alias("w")).where("w <> 0")
        )
        if step.isEmpty():
            return total.groupBy("i", "j").agg(F.sum("w").alias("w"))
        total = total.unionByName(step)
        total = cut(total.groupBy("i", "j").agg(F.sum("w").alias("w"))) if k % 8 == 7 else total
    raise RuntimeError("upstream_operator: the routing does not run dry")


def contributing_operator(upstream: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, j, share) with rows that sum to 1, and (i, area): what upstream areas add up to."""
    weighted = upstream.join(areas.select(F.col("node_id").alias("j"), "area"), "j").withColumn("_wa", F.col("w") * F.col("area"))
    total = weighted.groupBy("i").agg(F.sum("_wa").alias("area"))
    rows = weighted.select("i", "j", "_wa").join(total, "i").select("i", "j", (F.col("_wa") / F.col("area")).alias("share"))
    return rows, total


def sparse_apply(operator: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(i, t, out): operator(i, j, share) times values(j, t, value) for every step."""
    return operator.join(values, "j").groupBy("i", "t").agg(F.sum(F.col("share") * F.col(value)).alias("out"))


def propagate(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(node_id, out): one symmetric normalised step over edges(u, v, w) with self-loops of weight 1."""
    loops = values.select(F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.lit(1.0).alias("w"))
    arcs = edges.select("u", "v", F.col("w").cast("double").alias("w")).unionByName(loops)
    degree = arcs.groupBy("v").agg(F.sum("w").alias("deg"))
    du, dv = degree.select(F.col("v").alias("u"), F.col("deg").alias("du")), degree.select("v", F.col("deg").alias("dv"))
    x = values.select(F.col("node_id").alias("u"), F.col(value).alias("_x"))
    flow = arcs.join(du, "u").join(dv, "v").join(x, "u")
    return flow.groupBy(F.col("v").alias("node_id")).agg(F.sum(F.col("w") * F.col("_x") / F.sqrt(F.col("du") * F.col("dv"))).alias("out"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean length, elevations, components."""
    n = nodes.agg(
        F.count("*").alias("nodes"), F.min("elevation").alias("min_elevation"), F.avg("elevation").alias("mean_elevation"),
        F.max("elevation").alias("max_elevation"),
    )
    e = edges.agg(F.count("*").alias("edges"), F.avg("length").alias("mean_length"))
    comps = connected_components(
        edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(nodes.select("node_id", "node_id"))
    ).agg(F.count_distinct("component").alias("components"))
    return n.join(F.broadcast(e), on=F.lit(True)).join(F.broadcast(comps), on=F.lit(True))


def fingerprint(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """One row (rows, digest): a sum of row hashes, so order and partitions don't matter; -0 counts as 0."""
    kinds = dict(df.dtypes)
    parts = [F.round(F.col(c), digits) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c) for c in sorted(columns)]
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).cast("string").alias("digest"))


def clean_network(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The largest component with valid nodes, one edge a pair, and every street in both directions."""
    from ..functions.geo import valid_coordinates

    good = nodes.where(valid_coordinates(F.col("lon"), F.col("lat")))
    ids = good.select(F.col("node_id"))
    kept = edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")
    single = cut(shortest_parallel(kept.select(*edges.columns)))
    core = cut(largest_component(good, single))
    inside = single.join(core.select(F.col("node_id").alias("u")), "u", "left_semi")
    return core, with_reverse(inside.select(*edges.columns))
