"""Metrics, graphs, places, results, labels, scenarios, sources and streams on small frames."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.operators import diagnostics as D
from pluvion.operators import features as X
from pluvion.operators import graph as G
from pluvion.operators import labels as L
from pluvion.operators import learn as K
from pluvion.operators import metrics as M
from pluvion.operators import results as R
from pluvion.operators import scenarios as C
from pluvion.operators import spatial as P
from pluvion.operators.components import connected_components
from pluvion.sources import files
from pluvion.streaming import readings

# metrics


@pytest.fixture(scope="module")
def nine(spark):
    rows = list(zip([1, 0, 1, 1, 0, 0, 1, 0, 0], [0.81, 0.77, 0.64, 0.33, 0.52, 0.12, 0.08, 0.46, 0.21]))
    return spark.createDataFrame(rows, "y int, p double")


def test_confusion(nine):
    r = M.confusion(nine, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.csi) == (2, 2, 2, 3, pytest.approx(1 / 3))
    assert M.confusion(nine.where("y = 0"), 0.99, (), None).first().recall is None
    assert M.confusion(nine.where("y = 0"), 0.99).first().recall == 0.0


def test_ranking_with_ties_against_brute_force(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(3000) < 0.1).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(3000) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").repartition(5)
    r = M.ranking_metrics(df).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    ap = sum((y[p == t].sum() / y.sum()) * (y[p >= t].sum() / (p >= t).sum()) for t in np.unique(p))
    assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)
    assert M.ranking_metrics(df.where("y = 0")).first().roc_auc is None


def test_best_threshold(nine):
    r = M.best_threshold(nine, "csi", [0.1, 0.5, 0.8]).first()
    best = max((sum((p >= c) & (y == 1) for y, p in rows) / max(1, sum((p >= c) | (y == 1) for y, p in rows)), c) for rows in [[(r.y, r.p) for r in nine.collect()]] for c in (0.1, 0.5, 0.8, 0.81, 0.64, 0.33, 0.08))
    assert r.score == pytest.approx(best[0])
    assert tuple(M.best_threshold(nine.where("y = 1"), "f1", [0.5]).first()) == (0.5, 0.0)


def test_reliability_against_numpy(spark):
    rng = np.random.default_rng(21)
    p, y = np.round(rng.random(400), 3), rng.integers(0, 2, 400)
    p[:3] = (0.0, 1.0, 0.4)
    p = np.where((p >= 0.6) & (p < 0.8), 0.55, p)  # the fourth of five bins stays empty
    got = M.reliability(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double"), 5).orderBy("bin").collect()
    bins = np.minimum((p * 5).astype(int), 4)
    assert [r.n for r in got] == np.bincount(bins, minlength=5).tolist() and got[3].n == 0 and got[3].observed is None
    for k in (0, 1, 2, 4):
        assert (got[k].mean_p, got[k].observed) == pytest.approx((p[bins == k].mean(), y[bins == k].mean()))


# graphs


def line_graph(spark, elevation):
    nodes = spark.createDataFrame([(i, 77.0 + i / 1000, 12.9, float(e)) for i, e in enumerate(elevation)], "node_id long, lon double, lat double, elevation double")
    edges = spark.createDataFrame([(i, i + 1, 100.0) for i in range(len(elevation) - 1)], "u long, v long, length double")
    return nodes, edges


@pytest.mark.parametrize("elevation,want", [([12.0, 11, 7, 4, 9], [1, 2, 3, 5, 1]), ([3.0, 8, 6, 9, 2, 5], [2, 1, 1, 1, 3, 1])])
def test_flow_accumulation(spark, elevation, want):
    nodes, edges = line_graph(spark, elevation)
    got = G.flow_accumulation(nodes, G.steepest_receivers(edges, nodes))
    assert [r.accumulation for r in got.orderBy("node_id").collect()] == want


def test_shares_and_upstream_against_matrices(spark):
    rng = np.random.default_rng(22)
    n = 14
    height = rng.permutation(n) * 1.7
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (30, 2)) if a != b})
    length = {q: float(rng.integers(20, 90)) for q in pairs}
    nodes = spark.createDataFrame([(i, 0.0, 0.0, float(h)) for i, h in enumerate(height)], "node_id long, lon double, lat double, elevation double")
    edges = spark.createDataFrame([(*q, length[q]) for q in pairs], "u long, v long, length double")
    routing = np.zeros((n, n))
    for exponent in (0.7, 1.6):
        routing[:] = 0
        for a, b in pairs:
            u, v = (a, b) if height[a] > height[b] else (b, a)
            routing[v, u] = ((height[u] - height[v]) / length[a, b]) ** exponent
        routing /= np.where(routing.sum(0) > 0, routing.sum(0), 1)
        shares = G.outflow_shares(edges, nodes, exponent)
        got = {(r.v, r.u): r.share for r in shares.collect()}
        assert got == {(int(i), int(j)): pytest.approx(routing[i, j]) for i, j in np.argwhere(routing > 0)}
    whole = np.linalg.inv(np.eye(n) - routing)
    up = {(r.i, r.j): r.w for r in G.upstream_operator(shares, nodes).collect()}
    assert up == {(int(i), int(j)): pytest.approx(whole[i, j]) for i, j in np.argwhere(whole > 1e-15)}
    areas = G.catchment_area(nodes, edges, 10.0)
    rows, total = G.contributing_operator(G.upstream_operator(shares, nodes), areas)
    assert all(r.s == pytest.approx(1.0) for r in rows.groupBy("i").agg(F.sum("share").alias("s")).collect())
    area = np.array([r.area for r in areas.orderBy("node_id").collect()])
    assert [r.area for r in total.orderBy("i").collect()] == pytest.approx(whole @ area)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(8)
    e = rng.integers(0, 300, (220, 2))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([(int(a), int(b)) for a, b in e], "src long, dst long")).collect()}
    root = {int(x): int(x) for x in e.ravel()}
    changed = True
    while changed:
        changed = False
        for a, b in e.tolist():
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == root


def test_network_cleaning(spark):
    nodes, edges = G.street_grid(spark, 4, 5)
    nodes = nodes.withColumn("lon", 77 + F.col("c") / 1000).withColumn("lat", 12 + F.col("r") / 1000).select("node_id", "lon", "lat")
    stray = spark.createDataFrame([(1, 77.0, 12.0), (2, 77.0, 12.0), (3, float("nan"), 12.0)], "node_id long, lon double, lat double")
    more = spark.createDataFrame([(1, 2, 5.0, "x"), (1000, 1001, 3.0, "x"), (1000, 3, 1.0, "x")], "u long, v long, length double, highway string")
    core, streets = G.clean_network(nodes.union(stray), edges.union(more))
    assert core.count() == 20 and streets.count() == edges.count()
    assert {r.length for r in streets.where("u = 1000 and v = 1001 or u = 1001 and v = 1000").collect()} == {3.0}


# places


def test_radius_and_nearest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((60, 2)) * 1000, rng.random((80, 2)) * 1000
    fa = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], "id long, x double, y double")
    fb = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(b)], "id long, x double, y double")
    d = np.sqrt(((a[:, None] - b) ** 2).sum(2))
    assert {(r.a, r.b) for r in P.radius_pairs(fa, fb, 150.0).collect()} == {(i, j) for i, j in zip(*np.nonzero(d <= 150))}
    near = P.nearest_k(fa, fb, 3, 20.0).collect()
    for i in range(60):
        assert [r.b for r in sorted((r for r in near if r.a == i), key=lambda r: r.rank)] == list(np.argsort(d[i])[:3])
    segments = spark.createDataFrame([(0.0, 0.0, 1000.0, 0.0), (500.0, 500.0, 500.0, 500.0)], "x1 double, y1 double, x2 double, y2 double")
    for r in P.nearest_segment(fa, segments, 300.0).collect():
        x, y = a[r.id]
        assert r.d == pytest.approx(min(300.0, y, math.hypot(x - 500, y - 500)))


def test_bilinear_on_a_plane_and_rings(spark):
    pixels = spark.createDataFrame([("t", r, c, 2.0 * r + 3.0 * c if (r, c) != (2, 2) else None) for r in range(4) for c in range(4)], "tile string, row long, col long, elev double")
    points = spark.createDataFrame([(0, "t", 0.25, 0.5), (1, "t", 1.0, 1.0), (2, "t", 9.0, 9.0), (3, "t", 2.0, 2.0)], "id long, tile string, r double, c double")
    got = {r.id: r.elev for r in P.bilinear(points, pixels).collect()}
    assert got[0] == pytest.approx(2.0) and got[1] == pytest.approx(5.0) and got[2] is None and got[3] is None
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    edges = spark.createDataFrame([(1, *map(float, p), *map(float, q)) for p, q in zip(ring, ring[1:] + ring[:1])], "ring int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(0, 5.0, 5.0), (1, 15.0, 5.0), (2, 5.0, 12.0)], "id long, x double, y double")
    assert [r.id for r in P.points_in_rings(pts, edges, 4.0).collect()] == [0]


# results and labels


def test_tiers(spark):
    ps = [-0.3, 0.1, 0.249, 0.3, 0.51, 0.74, 0.76, 1.5, float("nan"), None]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select(R.risk_tier(F.col("p")).alias("t"))
    assert [r.t for r in df.collect()] == ["Low", "Low", "Low", "Moderate", "High", "High", "Severe", "Severe", "Low", "Low"]


def test_reports(spark):
    rows = [
        (2, "2022-09-03 10:00:00", "12.9", "77.6", "", "", "a"), (3, "2022-09-03 10:00:00", "12.9", "77.6", "30", "3", "dup"),
        (4, "bad", "x", "77", "-5", "huge", "b"), (5, "2022-09-04 11:00:00", "95", "77", "12.5", "knee", "c"), (6, "2022-09-05 11:00:00", "12", "77", "9", "2", "d"),
    ]
    good, bad = L.split_reports(spark.createDataFrame(rows, "line long, timestamp string, lat string, lon string, radius_m string, severity string, description string"))
    assert [(r.line, r.severity, r.radius_m) for r in good.orderBy("line").collect()] == [(2, 1, None), (6, 2, 9.0)]
    assert {r.line: len(r.reasons) for r in bad.collect()} == {4: 4, 5: 1}


def test_report_hours_and_fusion(spark):
    rng = np.random.default_rng(23)
    at = rng.uniform(0, 900, (40, 2))
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "node_id long, x double, y double")
    told = [(k, int(rng.integers(0, 60)), float(rng.uniform(0, 900)), float(rng.uniform(0, 900)), [None, 90.0, 210.0][k % 3]) for k in range(12)]
    hits = L.observed_labels(spark.createDataFrame(told, "report long, t long, x double, y double, radius_m double"), nodes, 130.0, 2)
    want = {
        (t + dt, i) for _, t, x, y, r in told for i, (a, b) in enumerate(at) if np.hypot(a - x, b - y) <= max(r or 0, 130.0) for dt in range(-2, 3)
    }
    assert {(r.t, r.node_id) for r in hits.collect()} == want and want
    y = {(t, i): int(rng.random() < 0.3) for t in range(-2, 62) for i in range(40)}
    labels = spark.createDataFrame([(t, i, v) for (t, i), v in y.items()], "t long, node_id long, y int")
    rule = {"simulated": lambda k: y[k], "observed": lambda k: int(k in want), "hybrid": lambda k: max(y[k], int(k in want))}
    for mode, of in rule.items():
        assert {(r.t, r.node_id): r.y for r in L.fuse_labels(labels, hits, mode).collect()} == {k: of(k) for k in y}


def test_feature_json(spark):
    table = spark.createDataFrame([(1, 77.0, 12.0, float("nan"))], "node_id long, lon double, lat double, max_p double")
    line = spark.createDataFrame([(2, 1, 0.123456), (1, 1, float("nan"))], "t long, node_id long, p double")
    got = json.loads(R.feature_json(table, ["max_p"], line).first().feature)
    assert got["properties"] == {"max_p": None, "prob_timeline": [None, 0.1235]} and got["geometry"]["coordinates"] == [77.0, 12.0]


def test_rank_one_share(spark):
    y = np.outer([1, 0, 1, 1], [1, 1, 0])
    df = spark.createDataFrame([(t, n, int(y[t, n])) for t in range(4) for n in range(3)], "t long, node_id long, y int")
    n, ss = y.sum(), y.sum() - y.sum() ** 2 / y.size
    want = 1 - (n - np.linalg.eigvalsh(y.T @ y).max()) / ss
    assert D.rank_one_share(df) == pytest.approx(want)
    assert D.rank_one_share(df.where("y = 0")) is None


def test_clip_keeps_means_and_store_matches_the_stream(spark, tmp_path):
    df = spark.createDataFrame([(k, float(v)) for k in range(3) for v in (0.01, 1, 2, 9)], "t long, m double")
    out = X.mean_preserving_clip(df, "t", "m", 0.2, 3.0, rounds=12).groupBy("t").agg(F.avg("m").alias("a"), F.max("m").alias("x")).collect()
    assert all(abs(r.a - 1) < 0.02 and r.x <= 3.0 for r in out)
    rain = [float(v) for v in (10, 0, 500, 0, 300, 20)]
    path = spark.createDataFrame([(rain,)], "r array<double>").select(X.store_step(F.col("r"), F.lit(60.0), 200.0).alias("p")).first().p
    spark.createDataFrame([(1, f"2024-01-01 0{i}:00:00", v) for i, v in enumerate(rain)], "station long, ts string, mm double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station long, ts string, mm double").parquet(str(tmp_path / "in"))
    readings.run_to_memory(readings.leaky_store(readings.readings(stream), 60.0, 200.0), "stores", str(tmp_path / "ck"))
    got = spark.table("stores").orderBy("ts").collect()
    assert [(r.store, r.spill) for r in got] == [(p.store, p.spill) for p in path]


def test_design_storm_conserves(spark):
    for shape in ("uniform", "triangular", "chicago"):
        rows = C.design_storm(spark, 80.0, 6, shape, lead=3, horizon=15).orderBy("t").collect()
        assert sum(r.mm for r in rows) == pytest.approx(80.0) and len(rows) == 15 and not any(r.mm for r in rows[:3] + rows[9:])


def test_replay_moves_to_the_event(spark):
    rows = [(t, 5.0 if t in (10, 11, 13) else 0.0) for t in range(0, 40)]
    df = spark.createDataFrame(rows, "t long, mm double")
    got = C.replay(df, 13, 4, 6, 0.0, 2).collect()
    assert sorted(r.t for r in got if r.is_target) == [10, 11, 12, 13] and min(r.t for r in got) == 4
    with pytest.raises(ValueError):
        C.block_containing(df, 99)


def test_platt_recovers_a_line(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000) * 2
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z - 0.3)))
    df = spark.createDataFrame([(int(a), float(1 / (1 + np.exp(-b)))) for a, b in zip(y, z)], "y int, p double")
    slope, intercept = K.fit_platt(df)
    assert slope == pytest.approx(0.5, abs=0.08) and intercept == pytest.approx(-0.3, abs=0.12)
    assert K.fit_platt(df.where("y = 1")) == (1.0, 0.0)


# sources


def test_weather_round_trip(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("timestamp,precipitation_mm,is_imputed,source\n2024-01-01T05:30:00+05:30,1.5,no,a\n2024-01-01 05:30:00,9,yes,b\nbad,1,no,a\n2024-01-01T05:30:00+05:30,2.5,1,c\n")
    df = files.read_weather(spark, str(p), "UTC")
    assert sorted((r.mm, r.is_imputed, r.source) for r in df.collect()) == [(2.5, True, "c"), (9.0, True, "b")]
    files.write_weather(df, str(tmp_path / "out"))
    again = files.read_weather(spark, str(tmp_path / "out"))
    assert sorted(r.t for r in again.collect()) == sorted(r.t for r in df.collect())
    (tmp_path / "x.csv").write_text("timestamp,source\n1,2\n")
    with pytest.raises(ValueError):
        files.read_weather(spark, str(tmp_path / "x.csv"))


def test_payloads_and_waterways(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [1.0, None]}}))
    (tmp_path / "p/b.json").write_text(json.dumps({"hourly": {"time": ["2024-01-01T00:00"], "precipitation": []}}))
    rows, bad = files.read_payloads(spark, str(tmp_path / "p"))
    assert sorted((r.ts.hour, r.mm) for r in rows.collect()) == [(0, 1.0), (1, None)] and bad.count() == 1
    line = {"type": "Feature", "properties": {"waterway": "drain", "water": "pond;moat"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]}}
    lake = {"type": "Feature", "properties": {"natural": "water"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    (tmp_path / "w.json").write_text(json.dumps({"type": "FeatureCollection", "features": [line, lake, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    water = files.read_waterways(spark, str(tmp_path / "w.json"))
    assert sorted((r.kind, len(r.points)) for r in water.collect()) == [("line", 2), ("line", 3), ("polygon", 4)]
    assert files.segments_of(water).count() == 6 and files.without_excluded_water(water, ["moat"]).count() == 1


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<graphml><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="length"/>'
        '<graph edgedefault="undirected"><node id="1"><data key="d0">77.5</data><data key="d1">12.9</data></node><node id="2"><data key="d0">77.6</data><data key="d1">12.8</data></node>'
        '<edge source="1" target="2"><data key="d2">30</data></edge><edge source="1" target="2"><data key="d2">20</data></edge></graph></graphml>'
    )
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted((r.node_id, r.lon) for r in nodes.collect()) == [("1", 77.5), ("2", 77.6)]
    assert sorted((r.u, r.v, r.length) for r in edges.collect()) == [("1", "2", 20.0), ("2", "1", 20.0)]


def test_tiles_and_splits(spark, tmp_path):
    n = 1201
    grid = np.arange(n * n, dtype=np.int64) % 1000
    grid[5] = -32768
    (tmp_path / "N12E077.hgt").write_bytes(struct.pack(f">{n * n}h", *grid.tolist()))
    tiles = files.read_tiles(spark, str(tmp_path / "N12E077.hgt"))
    assert tiles.count() == n * n and tiles.where("elev is null").count() == 1 and tiles.where("row = 1 and col = 0").first().elev == 1201 % 1000
    rows = spark.createDataFrame([("train", 1), ("train", 2), ("val", 3)], "split string, x int")
    files.commit_splits(rows, str(tmp_path / "ds"), "b1")
    assert files.read_split(spark, str(tmp_path / "ds"), "b1", "train", ["x"]).count() == 2
    with pytest.raises(ValueError):
        files.read_split(spark, str(tmp_path / "ds"), "b1", "train", ["nope"])
