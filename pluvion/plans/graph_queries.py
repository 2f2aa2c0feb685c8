"""Queries of street graphs and of joins by place."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import bbox_area_km2, fallback_elevation, grade, grown_extent, haversine_m, utm_zone
from ..operators import contributing as C
from ..operators import features as X
from ..operators import graph as G
from ..operators import labels as L
from ..operators import spatial as P
from . import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.with_views(sql)
        return f

    return add


SEG = "seg AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(length) AS length FROM edges WHERE u <> v GROUP BY 1, 2)"
BOTH = f"{SEG}, two AS (SELECT a AS u, b AS v, length FROM seg UNION ALL SELECT b, a, length FROM seg)"
DOWN = (
    f"{BOTH}, down AS (SELECT u, v, (a.elevation - b.elevation) / greatest(length, 1.0) AS slope FROM two "
    "JOIN nodes a ON u = a.node_id JOIN nodes b ON v = b.node_id WHERE b.elevation < a.elevation)"
)
RECEIVERS = f"{DOWN}, rec AS MATERIALIZED (SELECT u AS node_id, v AS receiver FROM down QUALIFY row_number() OVER (PARTITION BY u ORDER BY slope DESC, v) = 1)"
SHARES = (
    f"{DOWN}, wt AS (SELECT u, v, slope, pow(slope / max(slope) OVER (PARTITION BY u), 1.1) AS w FROM down), "
    "sh AS (SELECT u, v, slope, w / sum(w) OVER (PARTITION BY u) AS share FROM wt)"
)


@query(f"WITH {SEG} SELECT a, b, length FROM seg")
def undirected_segments(spark, d):
    return G.undirected_segments(A.edges(spark, d))


@query("SELECT u, v, min(length) AS length FROM edges WHERE u <> v GROUP BY u, v")
def shortest_parallel_edges(spark, d):
    return G.shortest_parallel(A.edges(spark, d))


@query(
    "WITH e AS (SELECT u, v, min(length) AS length FROM edges WHERE u <> v GROUP BY u, v), "
    "b AS (SELECT u, v, length, false AS reverse_added FROM e UNION ALL SELECT v, u, length, true FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.u = x.v AND y.v = x.u)) "
    "SELECT b.u, b.v, least(b.length, o.length) AS length, b.reverse_added FROM b JOIN b o ON o.u = b.v AND o.v = b.u"
)
def reverse_completed_edges(spark, d):
    return G.with_reverse(G.shortest_parallel(A.edges(spark, d)))


@query(
    "SELECT u, v, length, round(least(greatest((b.elevation - a.elevation) / length, -0.3), 0.3), 8) AS grade FROM edges "
    "JOIN nodes a ON u = a.node_id JOIN nodes b ON v = b.node_id WHERE u <> v"
)
def edge_grades(spark, d):
    ends = G.attach_ends(A.edges(spark, d).where("u <> v"), A.nodes(spark, d), ["elevation"])
    return ends.select("u", "v", "length", F.round(grade(F.col("u_elevation"), F.col("v_elevation"), F.col("length"), 0.3), 8).alias("grade"))


@query(f"WITH {RECEIVERS} SELECT * FROM rec")
def steepest_receivers(spark, d):
    return G.steepest_receivers(A.edges(spark, d), A.nodes(spark, d))


@query(
    "WITH RECURSIVE " + f"{RECEIVERS}, path AS (SELECT node_id AS start, node_id AS pos FROM nodes UNION ALL SELECT start, receiver FROM path JOIN rec ON node_id = pos) "
    "SELECT pos AS node_id, count(*) AS accumulation FROM path GROUP BY pos"
)
def flow_accumulation(spark, d):
    points = A.nodes(spark, d)
    return G.flow_accumulation(points, G.steepest_receivers(A.edges(spark, d), points))


@query(f"WITH {SHARES} SELECT u, v, round(slope, 8) AS slope, round(share, 8) AS share FROM sh")
def outflow_shares(spark, d):
    out = G.outflow_shares(A.edges(spark, d), A.nodes(spark, d), 1.1)
    return out.select("u", "v", F.round("slope", 8).alias("slope"), F.round("share", 8).alias("share"))


@query(
    f"WITH {SHARES}, s AS (SELECT u, sum(share * slope) AS slope FROM sh GROUP BY u) "
    "SELECT node_id, round(coalesce(slope, 0.0), 8) AS slope, slope IS NULL AS is_sink, round(CASE WHEN slope IS NULL THEN 0.0 ELSE least(0.4 * greatest(slope, 0.001) / 0.01, 1.0) END, 8) AS release "
    "FROM nodes LEFT JOIN s ON u = node_id"
)
def node_release(spark, d):
    out = G.downhill_slope(A.nodes(spark, d), G.outflow_shares(A.edges(spark, d), A.nodes(spark, d), 1.1))
    release = X.release_fraction(F.col("slope"), F.col("is_sink"), 0.4, 0.001)
    return out.select("node_id", F.round("slope", 8).alias("slope"), "is_sink", F.round(release, 8).alias("release"))


@query(
    f"WITH {SEG}, h AS (SELECT n, sum(length) * 10 AS area FROM (SELECT a AS n, length FROM seg UNION ALL SELECT b, length FROM seg) GROUP BY n) "
    "SELECT node_id, round(greatest(coalesce(area, 1.0), 1.0), 4) AS area FROM nodes LEFT JOIN h ON n = node_id"
)
def catchment_areas(spark, d):
    out = G.catchment_area(A.nodes(spark, d), A.edges(spark, d), 20.0)
    return out.select("node_id", F.round("area", 4).alias("area"))


@query(
    "WITH RECURSIVE k AS (SELECT u, v FROM edges WHERE length < 500), b AS (SELECT u AS x, v AS y FROM k UNION SELECT v, u FROM k), "
    "r AS (SELECT x AS node, x AS seen FROM b UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node"
)
def street_components(spark, d):
    """Weak components of the short streets."""
    from ..operators.components import connected_components

    return connected_components(A.edges(spark, d).where("length < 500").select(F.col("u").alias("src"), F.col("v").alias("dst")))


@query("SELECT node_id, lon, lat, elevation, row_number() OVER (ORDER BY node_id::VARCHAR) - 1 AS idx FROM nodes")
def node_order(spark, d):
    return G.indexed(A.nodes(spark, d)).select("node_id", "lon", "lat", "elevation", "idx")


@query(
    f"WITH {SHARES}, rain AS (SELECT n.node_id AS j, t, h.rain FROM nodes n JOIN node_hours h ON n.node_id % 50 = h.node_id) "
    "SELECT v AS i, t, round(sum(share * rain), 4) AS out FROM sh JOIN rain ON u = j GROUP BY 1, 2"
)
def routed_rain(spark, d):
    rain = A.node_hours(spark, d)
    wide = A.nodes(spark, d).select(F.col("node_id").alias("j"), (F.col("node_id") % A.NODES).alias("k")).join(rain.withColumnRenamed("node_id", "k"), "k")
    shares = G.outflow_shares(A.edges(spark, d), A.nodes(spark, d), 1.1)
    op = shares.select(F.col("v").alias("i"), F.col("u").alias("j"), "share")
    return G.sparse_apply(op, wide.select("j", "t", "rain"), "rain").select("i", "t", F.round("out", 4).alias("out"))


@query(
    "WITH arc AS (SELECT u, v, 1.0::DOUBLE AS w FROM edges UNION ALL SELECT node_id, node_id, 1.0 FROM nodes), deg AS (SELECT v, sum(w) AS d FROM arc GROUP BY v) "
    "SELECT arc.v AS node_id, round(sum(w * elevation / sqrt(a.d * b.d)), 6) AS out FROM arc JOIN deg a ON a.v = arc.u JOIN deg b ON b.v = arc.v JOIN nodes ON node_id = arc.u GROUP BY 1"
)
def propagated_elevation(spark, d):
    arcs = A.edges(spark, d).select("u", "v", F.lit(1.0).alias("w"))
    return G.propagate(arcs, A.nodes(spark, d), "elevation").select("node_id", F.round("out", 6).alias("out"))


@query(
    f"WITH RECURSIVE {SHARES}, sm AS MATERIALIZED (SELECT u, v, share FROM sh), term AS (SELECT 0 AS k, node_id AS i, node_id AS j, 1.0::DOUBLE AS w FROM nodes "
    "UNION ALL SELECT k + 1, v, j, sum(w * share) FROM term JOIN sm ON u = i GROUP BY k, v, j) SELECT i, j, round(sum(w), 8) AS w FROM term GROUP BY i, j"
)
def upstream_shares(spark, d):
    """Which part of each node's water passes every other node."""
    points = A.nodes(spark, d)
    out = G.upstream_operator(G.outflow_shares(A.edges(spark, d), points, 1.1), points)
    return out.select("i", "j", F.round("w", 8).alias("w"))


@query(
    f"WITH RECURSIVE {SHARES}, h AS (SELECT n, sum(length) * 10 AS area FROM (SELECT a AS n, length FROM seg UNION ALL SELECT b, length FROM seg) GROUP BY n), "
    "ar AS MATERIALIZED (SELECT node_id, greatest(coalesce(area, 1.0), 1.0) AS area FROM nodes LEFT JOIN h ON n = node_id), sm AS MATERIALIZED (SELECT u, v, share FROM sh), "
    "term AS (SELECT 0 AS k, node_id AS i, area AS w FROM ar UNION ALL SELECT k + 1, v, sum(w * share) FROM term JOIN sm ON u = i GROUP BY k, v) "
    "SELECT i, round(sum(w), 3) AS area FROM term GROUP BY i"
)
def contributing_areas(spark, d):
    """Every node's own area and what upstream areas send it, pushed down layer by layer."""
    points, links = A.nodes(spark, d), A.edges(spark, d)
    out = C.contributing_areas(G.outflow_shares(links, points, 1.1), G.catchment_area(points, links, 20.0))
    return out.select("i", F.round("area", 3).alias("area"))


@query()
def cleaned_network(spark, d):
    return G.clean_network(A.nodes(spark, d), A.edges(spark, d))[1]


@query(
    "WITH RECURSIVE b AS (SELECT u AS x, v AS y FROM edges UNION SELECT v, u FROM edges UNION SELECT node_id, node_id FROM nodes), "
    "r AS (SELECT x AS node, x AS seen FROM b UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node) "
    "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT round(avg(length), 3) FROM edges) AS mean_length, "
    "(SELECT min(elevation) FROM nodes) AS min_elevation, (SELECT max(elevation) FROM nodes) AS max_elevation, (SELECT count(DISTINCT component) FROM c) AS components"
)
def graph_summary(spark, d):
    out = G.graph_summary(A.nodes(spark, d), A.edges(spark, d))
    return out.select("nodes", "edges", F.round("mean_length", 3).alias("mean_length"), "min_elevation", "max_elevation", "components")


@query()
def graph_fingerprint(spark, d):
    return G.fingerprint(A.nodes(spark, d), ["node_id", "lon", "lat", "elevation"])


@query("SELECT greatest(min(lon) - 0.001, -180) AS west, greatest(min(lat) - 0.001, -90) AS south, least(max(lon) + 0.001, 180) AS east, least(max(lat) + 0.001, 90) AS north FROM nodes")
def node_extent(spark, d):
    return grown_extent(A.nodes(spark, d))


@query(
    "SELECT node_id, 32600 + (least(floor((lon + 180) / 6) + 1, 60))::INTEGER AS zone, round(880.0 + 30.0 * sin(100 * lat) + 15.0 * cos(100 * lon), 6) AS fallback FROM nodes"
)
def node_zones(spark, d):
    return A.nodes(spark, d).select(
        "node_id", utm_zone(F.col("lon"), F.col("lat")).alias("zone"), F.round(fallback_elevation(F.col("lon"), F.col("lat")), 6).alias("fallback")
    )


@query("SELECT a.node_id AS a, b.node_id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS d FROM nodes_xy a JOIN nodes_xy b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 100")
def node_pairs_within(spark, d):
    p = A.nodes_xy(spark, d).select(F.col("node_id").alias("id"), "x", "y")
    return P.radius_pairs(p, p, 100.0).select("a", "b", F.round("d", 4).alias("d"))


@query("SELECT a.node_id, round(a.elevation - avg(b.elevation), 6) AS tpi FROM nodes_xy a JOIN nodes_xy b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 300 GROUP BY a.node_id, a.elevation")
def topographic_position(spark, d):
    p = A.nodes_xy(spark, d).select(F.col("node_id").alias("id"), "x", "y", "elevation")
    got = P.mean_within(p, "elevation", 300.0)
    return p.join(got, "id").select(F.col("id").alias("node_id"), F.round(F.col("elevation") - F.col("mean"), 6).alias("tpi"))


NEAR = (
    "near AS (SELECT a.node_id AS a, b.node_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, b.elevation FROM nodes_xy a JOIN nodes_xy b ON a.elevation < 876 AND b.elevation >= 876 "
    "QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY d, b.node_id) <= 4)"
)


def _voids(spark, d):
    p = A.nodes_xy(spark, d).select(F.col("node_id").alias("id"), "x", "y", "elevation")
    return p.where("elevation < 876"), p.where("elevation >= 876")


@query(
    "SELECT a.node_id AS a, b.node_id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS d, row_number() OVER (PARTITION BY a.node_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.node_id)::INTEGER AS rank "
    "FROM nodes_xy a JOIN nodes_xy b ON a.node_id <> b.node_id QUALIFY rank <= 4"
)
def nearest_nodes(spark, d):
    p = A.nodes_xy(spark, d).select(F.col("node_id").alias("id"), "x", "y")
    found = P.nearest_k(p, p, 5, 200.0).where("a <> b")  # a node is among its own five
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return found.select("a", "b", F.round("d", 4).alias("d"), rank.alias("rank")).where("rank <= 4")


@query(f"WITH {NEAR} SELECT a AS id, round(sum(elevation / pow(greatest(d, 1e-6), 2)) / sum(1 / pow(greatest(d, 1e-6), 2)), 6) AS filled FROM near GROUP BY a")
def filled_voids(spark, d):
    voids, rest = _voids(spark, d)
    return P.inverse_distance_fill(voids, rest, "elevation", 4, 200.0).select("id", F.round("filled", 6).alias("filled"))


SEGS = (
    "dr AS (SELECT node_id AS k, x, y FROM nodes_xy), "
    "sg AS (SELECT p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM dr p JOIN dr q ON q.k = p.k + 1)"
)


def _drains(spark, d):
    p = A.nodes_xy(spark, d).select("node_id", "x", "y")
    q = p.select((F.col("node_id") - 1).alias("node_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return p.join(q, "node_id").select(F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


DISTANCE = (
    "t AS (SELECT node_id, x, y, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0 ELSE least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0.0), 1.0) END AS f FROM nodes_xy, sg), "
    "ds AS (SELECT node_id, least(min(sqrt(pow(x - x1 - f * (x2 - x1), 2) + pow(y - y1 - f * (y2 - y1), 2))), 400.0) AS d FROM t GROUP BY node_id)"
)


@query(f"WITH {SEGS}, {DISTANCE} SELECT node_id AS id, round(d, 4) AS d, round(0.6 + (0.1 - 0.6) * pow(2.718281828459045, -d / 150), 6) AS capacity FROM ds")
def drain_distance(spark, d):
    p = A.nodes_xy(spark, d).select(F.col("node_id").alias("id"), "x", "y")
    out = P.nearest_segment(p, _drains(spark, d), 400.0)
    return out.select("id", F.round("d", 4).alias("d"), F.round(X.drain_capacity(F.col("d"), 0.1, 0.6, 150.0), 6).alias("capacity"))


REPORTS = "rep AS (SELECT event_id AS report, t, (event_id * 13) % n AS place, CASE WHEN event_id % 2 = 0 THEN 250.0 END AS radius_m FROM events_t, (SELECT count(*) AS n FROM nodes) WHERE event_type = 'error' AND value > 150)"


def _reports(spark, d):
    points = A.nodes_xy(spark, d)
    n = points.count()
    raw = A.events(spark, d).where("event_type = 'error' and value > 150")
    rows = raw.select(F.col("event_id").alias("report"), "t", ((F.col("event_id") * 13) % n).alias("node_id"), F.when(F.col("event_id") % 2 == 0, 250.0).alias("radius_m"))
    return rows.join(points.select("node_id", "x", "y"), "node_id").select("report", "t", "radius_m", "x", "y")


SNAPPED = "sn AS (SELECT report, t, b.node_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM rep JOIN nodes_xy a ON a.node_id = place JOIN nodes_xy b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= greatest(coalesce(radius_m, 0.0), 120.0))"


@query(f"WITH {REPORTS}, {SNAPPED} SELECT report, node_id, round(d, 4) AS d FROM sn")
def snapped_reports(spark, d):
    return L.snap_reports(_reports(spark, d), A.nodes_xy(spark, d), 120.0).select("report", "node_id", F.round("d", 4).alias("d"))


@query(f"WITH {REPORTS}, {SNAPPED} SELECT DISTINCT unnest(range(t - 3, t + 4))::BIGINT AS t, node_id FROM sn")
def observed_flood_hours(spark, d):
    return L.observed_labels(_reports(spark, d), A.nodes_xy(spark, d), 120.0, 3)


@query(
    f"WITH {REPORTS}, {SNAPPED}, ob AS (SELECT DISTINCT unnest(range(t - 3, t + 4))::BIGINT AS t, node_id FROM sn) "
    "SELECT h.t, h.node_id, CASE WHEN rain > 300 OR ob.t IS NOT NULL THEN 1 ELSE 0 END AS y FROM node_hours h LEFT JOIN ob ON ob.t = h.t AND ob.node_id = h.node_id"
)
def fused_flood_labels(spark, d):
    labels = A.node_hours(spark, d).select("t", "node_id", F.when(F.col("rain") > 300, 1).otherwise(0).alias("y"))
    nodes = A.nodes_xy(spark, d).join(labels.select("node_id").distinct(), "node_id", "left_semi")  # others have no label to fuse
    return L.fuse_labels(labels, L.observed_labels(_reports(spark, d), nodes, 120.0, 3), "hybrid")


@query("SELECT a.node_id AS a, b.node_id AS b, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS metres FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 1")
def neighbour_distances(spark, d):
    a = A.nodes(spark, d)
    b = a.select((F.col("node_id") - 1).alias("node_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    m = haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return a.join(b, "node_id").select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b"), F.round(m, 3).alias("metres"))


@query("SELECT round(radians(max(lon) - min(lon)) * 6371008.8 * cos(radians((min(lat) + max(lat)) / 2)) * radians(max(lat) - min(lat)) * 6371008.8 / 1e6, 6) AS km2 FROM nodes")
def region_area(spark, d):
    e = A.nodes(spark, d).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return e.select(F.round(bbox_area_km2(F.col("w"), F.col("s"), F.col("e"), F.col("n")), 6).alias("km2"))
