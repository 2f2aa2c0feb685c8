"""Queries of digests, interval lookups, exact draws and clips, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import draws as W
from ..operators import features as X
from ..operators import series as S
from ..operators import signatures as D
from ..operators import spatial as P
from ..operators import records as C
from ..operators.components import shared_dir
from ..sources import datasets
from . import adapters as A
from .composed_queries import DATASET, _dataset
from .graph_queries import SEGS, _drains

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = A.with_views(sql)
        return f

    return add


def digest_sql(rows: str, key: str, bucket: int, fan: int) -> str:
    """Common table expressions that end in dg(key, rows, digest), as ordered_digest makes it of rows(key, pl, line)."""
    return (
        f"d0 AS (SELECT {key}, floor(pl / {bucket}.0)::BIGINT AS pl, count(*) AS rows, sha256(string_agg(line, chr(10) ORDER BY pl, line)) AS line FROM {rows} GROUP BY ALL), "
        f"d1 AS (SELECT {key}, floor(pl / {fan}.0)::BIGINT AS pl, sum(rows)::BIGINT AS rows, sha256(string_agg(line, '' ORDER BY pl, line)) AS line FROM d0 GROUP BY ALL), "
        f"dg AS (SELECT {key}, sum(rows)::BIGINT AS rows, sha256(string_agg(line, '' ORDER BY pl, line)) AS digest FROM d1 GROUP BY ALL)"
    )


@query(
    "WITH rec AS (SELECT t, user_id % 50 AS node_id, round(sum(value), 4) AS rain, max(event_type) AS source FROM events_t GROUP BY 1, 2), "
    "ln AS (SELECT node_id, t AS pl, t || '|' || rain::DECIMAL(30,6) AS line FROM rec), " + digest_sql("ln", "node_id", 24, 64) + ", "
    "kd AS (SELECT node_id, string_agg(source || '=' || n, ',' ORDER BY source || '=' || n) AS kinds FROM (SELECT node_id, source, count(*) AS n FROM rec GROUP BY 1, 2) GROUP BY 1) "
    "SELECT node_id, rows, substr(sha256(digest || kinds), 1, 16) AS fingerprint FROM dg JOIN kd USING (node_id)"
)
def series_fingerprints(spark, d):
    """The fingerprint of every station's record: steps, rain and counts of its sources."""
    per = A.events(spark, d).groupBy("t", (F.col("user_id") % A.NODES).alias("node_id"))
    record = per.agg(F.round(F.sum("value"), 4).alias("rain"), F.max("event_type").alias("source"))
    return D.series_fingerprint(record, ["node_id"], "rain", "source")


VARIANTS = ("as given", "a street less", "a metre higher", "a nanometre higher")


def _variant(spark, d, variant: str):
    nodes, edges = A.nodes(spark, d), A.edges(spark, d)
    if variant == "a street less":
        edges = edges.where("not (u = 0 and v = 1)")
    up = {"a metre higher": 1.0, "a nanometre higher": 1e-9}.get(variant, 0.0)
    return nodes.withColumn("elevation", F.col("elevation") + F.when(F.col("node_id") == 0, up).otherwise(0.0)), edges


@query(
    "WITH vr AS (SELECT unnest(['as given', 'a street less', 'a metre higher', 'a nanometre higher']) AS variant), "
    "nv AS (SELECT variant, node_id, lon, lat, elevation + CASE WHEN node_id <> 0 THEN 0.0 WHEN variant = 'a metre higher' THEN 1.0 WHEN variant = 'a nanometre higher' THEN 1e-9 ELSE 0.0 END AS elevation, "
    "row_number() OVER (PARTITION BY variant ORDER BY node_id::VARCHAR) - 1 AS idx FROM nodes, vr), "
    "ev AS (SELECT e.variant, a.idx AS src, lpad(a.idx::VARCHAR, 12, '0') || '|' || lpad(b.idx::VARCHAR, 12, '0') AS pair, length FROM (SELECT * FROM edges, vr WHERE NOT (variant = 'a street less' AND u = 0 AND v = 1)) e "
    "JOIN nv a ON a.node_id = u AND a.variant = e.variant JOIN nv b ON b.node_id = v AND b.variant = e.variant), "
    "ln AS (SELECT variant || ':ids' AS k, idx AS pl, node_id::VARCHAR AS line FROM nv UNION ALL SELECT variant || ':pairs', src, pair FROM ev "
    "UNION ALL SELECT variant || ':nv', idx, elevation::DECIMAL(30,6) || '|' || lat::DECIMAL(30,6) || '|' || lon::DECIMAL(30,6) FROM nv "
    "UNION ALL SELECT variant || ':ev', src, pair || '|' || length::DECIMAL(30,6) FROM ev), " + digest_sql("ln", "k", 1024, 64) + ", "
    "tp AS (SELECT variant, a.rows AS nodes, b.rows AS edges, sha256(a.digest || b.digest) AS t FROM vr JOIN dg a ON a.k = variant || ':ids' JOIN dg b ON b.k = variant || ':pairs') "
    "SELECT variant, nodes, edges, substr(t, 1, 16) AS topology, substr(sha256(t || 'elevation,lat,lon,/,length' || a.digest || b.digest), 1, 16) AS attributes "
    "FROM tp JOIN dg a ON a.k = variant || ':nv' JOIN dg b ON b.k = variant || ':ev'"
)
def graph_signature_changes(spark, d):
    """Which of a graph's two signatures a change moves."""
    out = None
    for variant in VARIANTS:
        nodes, edges = _variant(spark, d, variant)
        one = D.graph_signatures(nodes, edges, ["lon", "lat", "elevation"], ["length"]).select(F.lit(variant).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "WITH i AS (SELECT node_id, t, t - row_number() OVER (PARTITION BY node_id ORDER BY t) AS island FROM node_hours), "
    "sp AS (SELECT node_id, min(t) AS first_t, max(t) AS last_t FROM i GROUP BY node_id, island), "
    "lim AS (SELECT node_id, min(first_t) AS a, max(last_t) AS b FROM sp GROUP BY node_id), "
    "rq AS (SELECT event_id, (user_id + 1) % 50 AS node_id, t FROM events_t) "
    "SELECT rq.node_id, event_id, rq.t, first_t AS block_id, first_t, last_t, CASE WHEN first_t IS NOT NULL THEN 'block' WHEN rq.t > a AND rq.t < b THEN 'gap' ELSE 'outside' END AS place "
    "FROM rq LEFT JOIN sp ON sp.node_id = rq.node_id AND rq.t BETWEEN first_t AND last_t LEFT JOIN lim ON lim.node_id = rq.node_id"
)
def blocks_of_events(spark, d):
    """The stored block of the next station that holds each event's hour, or why none does."""
    asked = A.events(spark, d).select("event_id", ((F.col("user_id") + 1) % A.NODES).alias("node_id"), "t")
    return S.blocks_holding(asked, A.node_hours(spark, d), ["node_id"])


@query(
    "WITH w AS (SELECT t, floor(mm)::BIGINT AS w FROM hourly), c AS (SELECT t, w, sum(w) OVER (ORDER BY t)::BIGINT AS hi, sum(w) OVER ()::BIGINT AS total FROM w), "
    "dr AS (SELECT least(floor(('0x' || substr(md5(concat_ws('|', id, 17)), 1, 8))::BIGINT / 4294967296.0 * total), total - 1)::BIGINT AS place "
    "FROM (SELECT unnest(range(2 * count(*)))::BIGINT AS id, max(total) AS total FROM c)) "
    "SELECT t, count(*) AS copies FROM c JOIN dr ON place >= hi - w AND place < hi GROUP BY t"
)
def exact_weighted_draws(spark, d):
    """Twice as many draws as hours, with replacement, an hour's weight being its whole millimetres."""
    hours = A.hourly(spark, d)
    out = W.exact_draws(hours, "t", F.floor("mm"), 2 * hours.count(), 17)
    return out.select("t", "copies")


@query(
    f"WITH {SEGS}, rg AS (SELECT k AS ring, x + 30 AS ax, y + 10 AS ay, x + 90 AS bx, y + 10 AS by_, x + 60 AS cx, y + 70 AS cy FROM dr), "
    "re AS (SELECT ring, ax AS x1, ay AS y1, bx AS x2, by_ AS y2 FROM rg UNION ALL SELECT ring, bx, by_, cx, cy FROM rg UNION ALL SELECT ring, cx, cy, ax, ay FROM rg), "
    "ls AS (SELECT * FROM sg UNION ALL SELECT x1, y1, x2, y2 FROM re), "
    "t AS (SELECT node_id, x, y, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0 ELSE least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 0.0), 1.0) END AS f FROM nodes_xy, ls), "
    "ds AS (SELECT node_id, least(min(sqrt(pow(x - x1 - f * (x2 - x1), 2) + pow(y - y1 - f * (y2 - y1), 2))), 400.0) AS d FROM t GROUP BY node_id), "
    "ins AS (SELECT DISTINCT node_id FROM (SELECT node_id, ring FROM nodes_xy, re WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)) "
    "SELECT node_id AS id, round(CASE WHEN ins.node_id IS NOT NULL THEN 0.0 ELSE d END, 4) AS d FROM ds LEFT JOIN ins USING (node_id)"
)
def drain_and_pond_distance(spark, d):
    """Metres to the nearest drain or pond, 0 in a pond; a pond lies beside every node."""
    p = A.nodes_xy(spark, d).select(F.col("node_id").alias("id"), "x", "y")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    a, b, c = corner(30, 10), corner(90, 10), corner(60, 70)
    side = lambda s, e: F.struct(s["x"].alias("x1"), s["y"].alias("y1"), e["x"].alias("x2"), e["y"].alias("y2"))
    rings = p.select(F.col("id").alias("ring"), F.inline(F.array(side(a, b), side(b, c), side(c, a))))
    return P.nearest_segment(p, _drains(spark, d), 400.0, rings).select("id", F.round("d", 4).alias("d"))


@query(
    "WITH x AS (SELECT t, node_id, greatest(rain, 0.0) AS x FROM node_hours), n AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE x > 0) AS pos FROM x GROUP BY t), "
    "ev AS (SELECT t, 0.5 / x AS pl, -1 AS lo, 0 AS hi, x AS mid FROM x WHERE x > 0 UNION ALL SELECT t, 2.0 / x, 0, 1, -x FROM x WHERE x > 0), "
    "ln AS (SELECT t, pl, n, n + sum(lo) OVER w AS l, sum(hi) OVER w AS h, sum(mid) OVER w AS m, lead(pl) OVER (PARTITION BY t ORDER BY pl, lo, mid) AS til FROM ev JOIN n USING (t) "
    "WINDOW w AS (PARTITION BY t ORDER BY pl, lo, mid ROWS UNBOUNDED PRECEDING)), "
    "sc AS (SELECT t, min((n - l * 0.5 - h * 2.0) / m) AS s FROM ln WHERE n - l - h > 0 AND (n - l * 0.5 - h * 2.0) / m >= pl * (1 - 1e-12) AND (til IS NULL OR (n - l * 0.5 - h * 2.0) / m <= til * (1 + 1e-12)) GROUP BY t) "
    "SELECT x.t, node_id, round(CASE WHEN pos = 0 THEN 1.0 WHEN s IS NOT NULL THEN least(greatest(s * x, 0.5), 2.0) WHEN x > 0 THEN 2.0 ELSE 0.5 END, 6) AS multiplier FROM x JOIN n USING (t) LEFT JOIN sc ON sc.t = x.t"
)
def rain_multipliers(spark, d):
    """An hour's rain as multipliers between a half and two whose mean is one exactly."""
    out = X.scaled_clip(A.node_hours(spark, d), "t", "rain", 0.5, 2.0)
    return out.select("t", "node_id", F.round("rain", 6).alias("multiplier"))


@query(
    f"WITH {DATASET}, s AS (SELECT split, round(avg(scaled), 6) AS mean, count(DISTINCT start) AS windows FROM ds WHERE step >= 0 GROUP BY split) "
    "SELECT split, start, step, t, mm, round(scaled, 6) AS scaled, windows, mean FROM ds JOIN s USING (split)"
)
def committed_datasets(spark, d):
    """The split datasets written, committed with sizes, digests and statistics, verified and read back."""
    rows, at = _dataset(spark, d).select("split", "start", "step", "t", "mm", F.round("scaled", 6).alias("scaled")), f"{shared_dir(spark)}/datasets-{uuid.uuid4().hex}"
    datasets.commit(rows, at, "a", C.dataset_statistics(_dataset(spark, d)), 20_000)
    back = datasets.read(spark, at, "a", ["t", "mm", "scaled"], ["start"], "step")
    said = datasets.manifest_of(spark, at, "a").groupBy("split").agg(F.first("statistics").alias("s"))
    said = said.select("split", F.get_json_object("s", "$.windows").cast("long").alias("windows"), F.round(F.get_json_object("s", "$.mean").cast("double"), 6).alias("mean"))
    return back.withColumn("split", F.col("split").cast("string")).join(said, "split").select("split", "start", "step", "t", "mm", "scaled", "windows", "mean")


CELL = 120.0


@query(
    f"WITH px AS (SELECT floor(y / {CELL})::BIGINT AS row, floor(x / {CELL})::BIGINT AS col, avg(elevation) AS e FROM nodes_xy GROUP BY 1, 2), "
    f"p AS (SELECT node_id, y / {CELL} - 0.5 AS r, x / {CELL} - 0.5 AS c FROM nodes_xy), "
    "k AS (SELECT node_id, (floor(r) + dr)::BIGINT AS row, (floor(c) + dc)::BIGINT AS col, CASE WHEN dr = 0 THEN 1 - (r - floor(r)) ELSE r - floor(r) END * CASE WHEN dc = 0 THEN 1 - (c - floor(c)) ELSE c - floor(c) END AS w "
    "FROM p, (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc)), "
    "g AS (SELECT node_id, sum(w * e) / sum(w) AS elev FROM k JOIN px USING (row, col) WHERE w > 0 GROUP BY node_id) "
    "SELECT node_id, round(elev, 5) AS elevation FROM nodes LEFT JOIN g USING (node_id)"
)
def sampled_elevations(spark, d):
    """A raster of the nodes' mean heights, sampled back at every node from the four pixels around it; void pixels don't count."""
    p = A.nodes_xy(spark, d)
    pixels = p.groupBy(F.lit(0).alias("tile"), F.floor(F.col("y") / CELL).alias("row"), F.floor(F.col("x") / CELL).alias("col")).agg(F.avg("elevation").alias("elev"))
    places = p.select(F.col("node_id").alias("id"), F.lit(0).alias("tile"), (F.col("y") / CELL - 0.5).alias("r"), (F.col("x") / CELL - 0.5).alias("c"))
    return P.bilinear(places, pixels).select(F.col("id").alias("node_id"), F.round("elev", 5).alias("elevation"))
